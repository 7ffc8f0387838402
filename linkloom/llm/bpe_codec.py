"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

A gear rolling hash cuts texts into chunks that depend on their content alone,
so copies and shared passages give equal chunks. Each worker encodes a chunk
once and remembers its ids under a digest, within ``REMEMBERED_BYTES``, the
least recently used going first; nothing is shuffled. A join of two chunks is
repaired by encoding its surroundings anew, widened on both sides to the nearest
place at which every encoding of the text must agree: after a visible ASCII
character that a blank or line feed follows. No match of the splitting pattern
reaches from such a character into the white space, so the ids on either side
are exactly those of the whole text. A chunk without such a place, as in scripts
that set no blanks, is kept with the ends of its words (matches of the splitting
pattern): the text before it is split anew into the chunk until a word ends where
one of the chunk's ends. From there both splits agree, as a match depends on what
follows alone, so the chunk's ids hold from there to the last word that no text
behind the chunk can change. A chunk that never agrees joins the repair as a whole.

Defined cases: a null text is encoded as an empty one and gives no ids.
Strings of special tokens become their ids, as in the library. Ids beyond the
vocabulary decode to nothing. Repeated rows
each get their row; other columns of the input are never looked at.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .runtime import bounded
from .tokenizers_io import byte_bpe

#: Chunks have about 2 ** CHUNK_BITS bytes.
CHUNK_BITS = 10
REMEMBERED_BYTES = 48 << 20
#: The words at a chunk's end that what follows could change.
_OPEN_WORDS = 2
_FIRST = re.compile(rb"[!-~](?=[ \n])")
_LAST = re.compile(rb"(?s:.*)[!-~](?=[ \n])")


def _settled(text: str) -> bool:
    """Whether all characters are of a class that has not changed since Unicode 3.2, so that pattern engines agree on them."""
    old = unicodedata.ucd_3_2_0.category
    return all(old(c) != "Cn" and old(c)[0] == unicodedata.category(c)[0] for c in set(text))


class Split:
    """A chunk by its words: places (bytes) where words end, ids up to the last of these, and the places where ids end."""

    def __init__(self, ends: np.ndarray, ids: bytes, id_ends: np.ndarray):
        self.ends, self.ids, self.id_ends = ends, ids, id_ends
        self.size = ends.nbytes + len(ids) + id_ends.nbytes

    def from_(self, place: int) -> bytes:
        """The ids behind a place where a word ends."""
        return self.ids[4 * (int(np.searchsorted(self.id_ends, place)) + 1) :]


class ChunkEncoder:
    """Encodes texts chunk by chunk; ``encoded`` and ``reused`` count chunks."""

    def __init__(self, path: str, remembered: int = REMEMBERED_BYTES):
        self.bpe = byte_bpe(path)
        self.special = re.compile("(" + "|".join(map(re.escape, self.bpe.special)) + ")") if self.bpe.special else None
        self.known: OrderedDict[bytes, tuple[bytes, bytes, bytes] | Split | None] = OrderedDict()
        self.held, self.most = 0, remembered
        self.encoded = self.reused = 0

    def _ids(self, raw: bytes) -> bytes:
        return np.array(self.bpe.encode_ordinary(raw.decode("utf-8", "surrogatepass")), "<u4").tobytes() if raw else b""

    def _word_ends(self, text: str) -> np.ndarray:
        return np.cumsum([len(w.encode("utf-8", "surrogatepass")) for w in self.bpe.split.findall(text)], dtype=np.int64)

    def _split(self, raw: bytes) -> Split | None:
        """A chunk by its words; None if it has too few, or characters on which engines could differ."""
        text = raw.decode("utf-8", "surrogatepass")
        if not _settled(text):
            return None
        ends = self._word_ends(text)[:-_OPEN_WORDS]
        if not len(ends):
            return None
        ids = self._ids_until(raw, ends[-1])
        return Split(ends, ids, np.cumsum(self.bpe.sizes[np.frombuffer(ids, "<u4")]))

    def _ids_until(self, raw: bytes, place: int) -> bytes:
        """The ids of ``raw`` up to a place where a word ends: of the whole, as a text that ends there could be split otherwise."""
        ids = self._ids(raw)
        return ids[: 4 * int(np.searchsorted(np.cumsum(self.bpe.sizes[np.frombuffer(ids, "<u4")]), place, "right"))]

    def _agreement(self, seam: bytes, chunk: bytes, known: Split) -> tuple[int, int] | None:
        """The first place in the chunk where the split of seam and chunk has a word's end that the chunk's own split has, and one behind the open words that follow."""
        text = (seam + chunk).decode("utf-8", "surrogatepass")
        if seam and not _settled(seam.decode("utf-8", "surrogatepass")):
            return None
        ends = self._word_ends(text) - len(seam)
        both = np.intersect1d(ends, known.ends, assume_unique=True)
        if not len(both):
            return None
        return int(both[0]), int(ends[min(np.searchsorted(ends, both[0]) + _OPEN_WORDS, len(ends) - 1)])

    def _chunk(self, raw: bytes) -> tuple[bytes, bytes, bytes] | Split | None:
        """Head, ids of the middle, tail; the chunk by its words if no place in it is certain; None if that can't be."""
        key = hashlib.blake2b(raw, digest_size=16).digest()
        if key in self.known:
            self.known.move_to_end(key)
            self.reused += 1
            return self.known[key]
        self.encoded += 1
        first = _FIRST.search(raw)
        if first is None:
            found = self._split(raw)
        else:
            a, b = first.end(), _LAST.match(raw).end()
            found = raw[:a], self._ids(raw[a:b]), raw[b:]
        self.known[key] = found
        self.held += self._size(found)
        while self.held > self.most:
            _, old = self.known.popitem(last=False)
            self.held -= self._size(old)
        return found

    @staticmethod
    def _size(found) -> int:
        return 300 + (0 if found is None else found.size if isinstance(found, Split) else sum(map(len, found)))

    def _plain(self, raw: bytes, cuts: np.ndarray) -> bytes:
        out, seam, at = [], b"", 0
        for cut in [*cuts.tolist(), len(raw)]:
            while cut < len(raw) and raw[cut] & 0xC0 == 0x80:  # never within a character
                cut += 1
            if cut <= at:
                continue
            chunk = raw[at:cut]
            at = cut
            parts = self._chunk(chunk)
            if isinstance(parts, Split):
                agreed = self._agreement(seam, chunk, parts)
                if agreed is None:
                    seam += chunk
                else:
                    place, behind = agreed
                    out.append(self._ids_until(seam + chunk[:behind], len(seam) + place))
                    out.append(parts.from_(place))
                    seam = chunk[parts.ends[-1] :]
            elif parts is None:
                seam += chunk
            else:
                out.append(self._ids(seam + parts[0]))
                out.append(parts[1])
                seam = parts[2]
        out.append(self._ids(seam))
        return b"".join(out)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        pieces, of = [], []
        for i, t in enumerate(texts):
            for part in self.special.split(t) if t and self.special else [t or ""]:
                pieces.append(part)
                of.append(i)
        raws = [p.encode("utf-8", "surrogatepass") for p in pieces]
        out: list[list[bytes]] = [[] for _ in texts]
        for i, p, raw, cuts in zip(of, pieces, raws, K.gear_cuts(raws, CHUNK_BITS) if raws else [], strict=True):
            special = self.bpe.special.get(p)
            out[i].append(self._plain(raw, cuts) if special is None else int(special).to_bytes(4, "little"))
        return [b"".join(x) for x in out]

    def decode(self, ids: bytes | None) -> bytes:
        """UTF-8 bytes of the text of ``ids``; what is not UTF-8 becomes U+FFFD."""
        raw = self.bpe.decode(np.frombuffer(ids, "<u4").tolist()) if ids else b""
        return raw.decode("utf-8", "replace").encode()


_encoders: dict[str, ChunkEncoder] = {}


def _forget() -> None:
    _encoders.clear()
    byte_bpe.cache_clear()


K.MEMORIES["bytes"] = _forget


def _encoder(path: str) -> ChunkEncoder:
    """One per worker process, so that chunks are reused across its tasks."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ``ids``: binary, little-endian unsigned 32-bit."""

    def run(batches):
        encoder = _encoder(tokenizer)
        for batch in K.small_batches(batches, "text", 2 << 20, "bytes"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encoder.encode(K.column(batch, "text")), pa.binary())], names=["doc_id", "ids"])

    return bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, ids binary")


def decode(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ``text`` from doc_id and ``ids``; null ids give an empty text."""

    def run(batches):
        encoder = _encoder(tokenizer)
        for batch in K.small_batches(batches, "ids", 2 << 20, "bytes"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encoder.decode(x).decode() for x in K.column(batch, "ids")], pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``encode`` then ``decode`` in one pass over Arrow batches; only digests leave the workers."""

    def run(batches):
        encoder = _encoder(tokenizer)
        for batch in K.small_batches(batches, "text", 2 << 20, "bytes"):
            ids = encoder.encode(K.column(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                names=[f.split()[0] for f in DIGEST_SCHEMA.split(", ")],
            )

    return bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, DIGEST_SCHEMA)
