"""Substring dedup: passages of content-defined chunks, deduplicated by digest.

A gear rolling hash over 16 bytes cuts texts into chunks of about
2 ** CHUNK_BITS bytes, each cut moved on to the next word, so that an insertion
changes only the chunks around it. A span is a row of chunks with ``LEAST_WORDS``
words or more that has fewer without its last or without its first chunk. The
first document that holds a span (least doc_id, then place) keeps it; elsewhere it
is a repeat and removed. Spans cover every row of chunks with as many words that
an earlier document holds, and nothing else, so chunks that repeat one by one in
several documents stay.

Each batch sorts its own digests and sends on one place per digest, so a span
that a third of all documents hold reaches its bucket once per batch; the other
places in the batch are known repeats already. Places travel packed, in buckets
whose number follows the bytes of the table. Digests have 64 bits.

Defined cases: null and empty texts have no chunks and stay as they are. Rows
that repeat a doc_id and text are one document: none repeats the other. A null
doc_id comes before all others. Trailing white space of a chunk is no part of
what is compared. Other columns are carried along, never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .runtime import bounded, written

CHUNK_BITS = 5
LEAST_WORDS = 14
#: Spans in a bucket, about.
BUCKET_SPANS = 400_000
NO_ID = np.iinfo(np.int64).min
PLACE = np.dtype([("digest", "<u8"), ("doc", "<i8"), ("mark", "<u4"), ("pos", "<u4")])
REPEATS_SCHEMA = "doc long, mark long, pos array<int>, earlier array<long>"


class Chunks:
    """The chunks of the texts of a block: which words each begins and ends with, its digest and its text; and their spans."""

    def __init__(self, b: K.Block, least: int = LEAST_WORDS):
        b.find_words()
        cuts = K.gear_cuts(b.raws, CHUNK_BITS)
        heads = b.words[:-1][b.n_words > 0]
        at = np.concatenate([c + s for c, s in zip(cuts, b.starts_of, strict=True)]) if cuts else np.zeros(0, np.int64)
        first = np.unique(np.concatenate((heads, np.searchsorted(b.starts, at))))
        first = first[first < len(b.starts)]
        self.first, self.last = first, (np.append(first[1:], len(b.starts)) - 1)[: len(first)]
        self.of = np.searchsorted(b.words, first, "right") - 1
        self.digest = b.hashes(b.starts[self.first], b.ends[self.last])
        self.words = self.last - self.first + 1
        #: Number of the first chunk of each text.
        self.base = np.searchsorted(self.of, np.arange(b.n + 1))
        # spans: the fewest chunks from each on, and up to each, that have enough words
        n = np.append(0, np.cumsum(self.words))
        at = np.arange(len(first))
        up_to = np.searchsorted(n, n[:-1] + least) - 1
        since = np.searchsorted(n, n[1:] - least, "right") - 1
        on, back = up_to < self.base[self.of + 1], since >= self.base[self.of]
        both = np.unique(np.concatenate((at[on] * (len(first) + 1) + up_to[on], since[back] * (len(first) + 1) + at[back])))
        self.span_first, self.span_last = both // (len(first) + 1), both % (len(first) + 1)
        self.span_of = self.of[self.span_first]
        self.span_digest = K.row_hashes(self.digest, self.span_first, self.span_last + 1)
        #: Number of the first span of each text.
        self.span_base = np.searchsorted(self.span_of, np.arange(b.n + 1))
        self.span_pos = np.arange(len(both)) - self.span_base[self.span_of]


def _grouped(doc, mark, pos, earlier) -> pa.RecordBatch:
    """One row per document from places sorted by document."""
    edge = np.flatnonzero((np.diff(doc) != 0) | (np.diff(mark.astype(np.int64)) != 0)) + 1
    starts = np.concatenate(([0], edge)) if len(doc) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(starts, len(doc)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(doc[starts]), pa.array(mark[starts].astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(pos.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(earlier))], names=["doc", "mark", "pos", "earlier"])


def _repeats(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort places; the first of each digest, and a batch of the others (an equal document is no repeat)."""
    places = places[np.lexsort((places["pos"], places["mark"], places["doc"], places["digest"]))]
    new = np.ones(len(places), bool)
    new[1:] = places["digest"][1:] != places["digest"][:-1]
    first = places[new][np.cumsum(new) - 1]
    again = ~new & ((places["doc"] != first["doc"]) | (places["mark"] != first["mark"]) | (places["pos"] != first["pos"]))
    rest, kept = places[again], first[again]
    order = np.lexsort((rest["pos"], rest["mark"], rest["doc"]))
    return places[new], (rest[order], kept["doc"][order])


def _mark():
    """32 bits of a text, for rows that repeat a doc_id with another text."""
    return F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF))


def repeats(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc, mark, pos, earlier): per document the numbers of its repeated spans and a document before it that holds each."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, int(total / (1 << CHUNK_BITS) / BUCKET_SPANS) + 1)
    schema = "bucket int, places binary, doc long, mark long, pos array<int>, earlier array<long>"

    def local(batches):
        for batch in K.small_batches(batches, "text"):
            ids, marks = batch.column(0).fill_null(NO_ID).to_numpy(), batch.column(2).to_numpy()
            parts = []
            for at, b in K.blocks(K.column(batch, "text")):
                c = Chunks(b, least)
                p = np.zeros(len(c.span_first), PLACE)
                p["digest"], p["doc"], p["mark"], p["pos"] = c.span_digest, ids[at : at + b.n][c.span_of], marks[at : at + b.n][c.span_of], c.span_pos
                parts.append(p)
            if not parts:
                continue
            first, (rest, earlier) = _repeats(np.concatenate(parts))
            bucket = (first["digest"] >> np.uint64(33)).astype(np.int64) * buckets >> 31
            edges = np.searchsorted(bucket, np.arange(buckets + 1))  # sorted, as digests are
            rows = [(k, first[a:z].tobytes()) for k, (a, z) in enumerate(zip(edges, edges[1:], strict=False)) if z > a]
            n = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([r for _, r in rows], pa.binary()), *(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())))], names=["bucket", "places", "doc", "mark", "pos", "earlier"])
            if len(rest):
                found = _grouped(rest["doc"], rest["mark"], rest["pos"], earlier)
                yield pa.RecordBatch.from_arrays([pa.nulls(found.num_rows, pa.int32()), pa.nulls(found.num_rows, pa.binary()), *found.columns], names=["bucket", "places", "doc", "mark", "pos", "earlier"])

    sent = written(bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _mark())).mapInArrow(local, schema), "chunks")

    def across(batches):
        # the rows of a task are sorted by bucket; one bucket is held at a time
        held, of = [], None

        def close():
            _, (rest, earlier) = _repeats(np.frombuffer(b"".join(held), PLACE))
            if len(rest):
                yield _grouped(rest["doc"], rest["mark"], rest["pos"], earlier)

        for batch in batches:
            for k, places in zip(K.column(batch, "bucket"), K.column(batch, "places"), strict=True):
                if k != of and held:
                    yield from close()
                    held = []
                of = k
                held.append(places)
        if held:
            yield from close()

    met = sent.filter("bucket is not null").select("bucket", "places").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(across, REPEATS_SCHEMA)
    return met.unionByName(sent.filter("bucket is null").select("doc", "mark", "pos", "earlier"))


def removed_runs(c: Chunks, i: int, pos: np.ndarray) -> list[tuple[int, int, int]]:
    """(first word, last word, number of its first span) of each run of repeated spans in text i."""
    out = []
    for p in np.unique(pos).tolist():  # by first chunk
        first, last = int(c.span_first[c.span_base[i] + p]), int(c.span_last[c.span_base[i] + p])
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last, p])
    return [(int(c.first[first]), int(c.last[last]), p) for first, last, p in out]


def _with_repeats(docs: DataFrame, least: int) -> DataFrame:
    """``docs`` with its columns in a struct, its text's mark, and the places of its repeated spans."""
    found = repeats(docs, least).groupBy("doc", "mark").agg(F.flatten(F.collect_list(F.arrays_zip("pos", "earlier"))).alias("repeated"))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("_doc"), F.col("text").alias("text"), _mark().alias("_mark"))
    return rows.join(found.select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark"), "repeated"), ["_doc", "_mark"], "left").select("row", "text", "repeated")


def _scan(batch: pa.RecordBatch, least: int):
    """(number of the row, block, place in it, runs, earlier documents by span) of each row with repeats in a batch."""
    repeated = batch.column(batch.schema.get_field_index("repeated"))
    texts = K.column(batch, "text")
    has = [i for i in range(batch.num_rows) if repeated[i].is_valid]
    for at, b in K.blocks([texts[i] for i in has]):
        c = Chunks(b, least)
        for k in range(b.n):
            i = has[at + k]
            rows = repeated[i].values
            pos, earlier = rows.field(0).to_numpy(), rows.field(1).to_numpy()
            yield i, b, k, removed_runs(c, k, pos), dict(zip(pos.tolist(), earlier.tolist(), strict=True))


SPANS_SCHEMA = "doc_id long, start long, end long, n_words long, earlier_doc_id long, passage_sha256 string"


def repeated_passages(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """One row per removed passage: its document, code points (end exclusive), words, and a document before it that holds its first span."""
    import hashlib

    def run(batches):
        for batch in K.small_batches(batches, "text"):
            ids, out = K.column(batch, "doc_id"), []
            for i, b, k, runs, earlier in _scan(batch, least):
                raw, base = b.raws[k], b.starts_of[k]
                for first, last, span in runs:
                    s, e = int(b.starts[first] - base), int(b.ends[last] - base)
                    start = len(raw[:s].decode("utf-8", "surrogatepass"))
                    other = earlier[span]
                    out.append((ids[i], start, start + len(raw[s:e].decode("utf-8", "surrogatepass")), last - first + 1, None if other == NO_ID else other, hashlib.sha256(raw[s:e]).hexdigest()))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.string())], names=[f.split()[0] for f in SPANS_SCHEMA.split(", ")])

    rows = _with_repeats(docs.select("doc_id", "text"), least).filter("repeated is not null")
    return bounded(rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), "text", "repeated")).mapInArrow(run, SPANS_SCHEMA)


def deduplicate(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without its repeated passages; ``n_chars`` (if there) is made to fit; a text with nothing else becomes empty."""

    def run(batches):
        for batch in K.small_batches(batches, "text"):
            texts = K.column(batch, "text")
            for i, b, k, runs, _ in _scan(batch, least):
                if runs:
                    raw, base, kept, at = b.raws[k], int(b.starts_of[k]), [], 0
                    for first, last, _ in runs:
                        kept.append(raw[at : int(b.starts[first]) - base])
                        at = int(b.starts[last + 1]) - base if last + 1 < b.words[k + 1] else len(raw)
                    texts[i] = b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("row")), pa.array(texts, pa.string())], names=["row", "new"])

    joined = _with_repeats(docs, least)
    schema = f"row {docs.schema.simpleString()}, new string"
    done = bounded(joined).mapInArrow(run, schema)
    changed = {"text": F.col("new"), "n_chars": F.when(F.col("new").isNull(), F.col("row.n_chars")).otherwise(F.length("new")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": F.col("new")}
    return done.select(*[changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns])
