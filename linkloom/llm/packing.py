"""Packing token sequences: first-fit decreasing in randomised groups of documents.

A document's ids (with its closing id) are cut into pieces of at most
``capacity``; all but its last piece fill a sequence of their own. Pieces are
placed longest first into the first sequence with room, found with a tournament
tree of remaining capacities, within groups of about ``GROUP_ROWS`` rows that a
hash forms. Only lengths are shuffled, never ids.

Defined cases: a null or empty text is a document of its closing id alone.
Repeated rows are packed each; the group of a row also depends on its place in
its Arrow batch, so that a repeated row spreads over groups. An empty table
gives an empty result; other columns of the input are never looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .runtime import bounded
from .tokenizers_io import word_bpe

CAPACITY = 4096
#: Rows in a group of documents, about.
GROUP_ROWS = 4096
PIECES_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"
PACKED_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class TournamentTree:
    """Bins with remaining capacities; each inner node holds the larger of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < max(1, bins):
            self.leaves *= 2
        self.best = [capacity] * (2 * self.leaves)

    def first_fit(self, need: int) -> int:
        """The first bin with room for ``need``; its capacity is taken."""
        best, at = self.best, 1
        while at < self.leaves:
            at *= 2
            if best[at] < need:
                at += 1
        best[at] -= need
        place = at - self.leaves
        while at > 1:
            at //= 2
            left, right = best[2 * at], best[2 * at + 1]
            best[at] = left if left > right else right
        return place


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece and its offset there. Ties keep the given order."""
    order = np.argsort(-lengths, kind="stable")
    tree = TournamentTree(len(lengths), capacity)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: dict[int, int] = {}
    for i, need in zip(order.tolist(), lengths[order].tolist(), strict=True):
        b = tree.first_fit(need)
        bins[i], offsets[i] = b, used.get(b, 0)
        used[b] = used.get(b, 0) + need
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, closing_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: where it starts in its document, its length, the checksum of its ids, the document's tokens."""
    closing = int(closing_id).to_bytes(4, "little")

    def run(batches):
        names, model = [f.split()[0] for f in PIECES_SCHEMA.split(", ")], word_bpe(tokenizer)
        for batch in K.small_batches(batches, "text", 2 << 20, "words"):
            out = []
            for place, (doc, ids) in enumerate(zip(K.column(batch, "doc_id"), model.encode_many(K.column(batch, "text")), strict=True)):
                ids += closing
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    out.append((doc, start, len(part) // 4, zlib.crc32(part), n, place))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * len(names), names=names)

    return bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, PIECES_SCHEMA)


def pack(cut: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """Place pieces into sequences, each of ``groups`` on its own; sequence_id holds the group and the bin."""

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(rows.column("length").to_numpy(), capacity)
        ids = (rows.column("part").to_numpy().astype(np.int64) << 32) + bins
        return rows.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    part = F.pmod(F.xxhash64("doc_id", "salt", F.lit("pack")), F.lit(groups))
    return cut.withColumn("part", part).groupBy("part").applyInArrow(place, PACKED_SCHEMA)


def pack_documents(docs: DataFrame, tokenizer: str, closing_id: int = 2, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Encode, cut and pack ``docs``; the number of groups follows the number of rows."""
    groups = max(1, -(-docs.count() // group_rows))
    return pack(pieces(docs, tokenizer, closing_id, capacity), groups, capacity)
