"""Exact top-k search by inner product with a bit-sliced index.

Vectors are quantised to integers and kept in blocks. Within a block every
attribute is a set of bit slices: bitmaps over the block's rows, one for each
bit of the attribute's distance from its least value in the block. For a query
the weighted slices of one significance are added with bitmap arithmetic
(carry-save adders), from the most significant slice downward; a negative weight
adds the complement. After each slice the sum's own bit slices give the k-th
best lower bound, and rows whose upper bound is below it are out. When few rows
are left, or no slice, these boundary rows are scored exactly.

Blocks of queries meet blocks of rows in tiles of a grid (an equi-join on the
tile), so neither side is broadcast or collected.

Vectors with a component of ``LARGEST`` or more in size after quantising are kept
in blocks of their own and scored in whole numbers of any size, as are blocks
whose scores could leave 64 bits; their index would have too many slices.

Defined cases: a vector that is null, empty, or holds a null or non-finite
component takes no part. A score beyond 64 bits counts as the nearest number
within. Vectors meet only vectors of their length. Rows with the query's id are not its candidates. A
repeated row is a candidate each time. Ties go to the smaller id.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .runtime import written

SCALE = 1024
LARGEST = 1 << 26
BLOCK_ROWS = 1 << 14
BLOCK_QUERIES = 1 << 11
BLOCK_SCHEMA = "dim int, wide boolean, ids binary, vals binary"
FOUND_SCHEMA = "query_id long, vec_id long, score long"


def finite(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and ``x``, components as doubles; rows that take no part are left out."""
    x = F.transform(F.col(embedding), lambda e: e.cast("double"))
    fit = lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & (F.size("x") > 0) & F.forall("x", fit))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows of each length packed into blocks of at most ``size``: quantised to 32 bits, or, of wide vectors, as they are."""

    def run(batches):
        held: dict[tuple, list] = {}

        def flush(kind: tuple, n: int):
            ids, vals = (np.concatenate(x) for x in zip(*held[kind], strict=True))
            held[kind] = [(ids[n:], vals[n:])] if n < len(ids) else []
            return pa.RecordBatch.from_arrays([pa.array([kind[0]], pa.int32()), pa.array([kind[1]]), pa.array([ids[:n].tobytes()], pa.binary()), pa.array([vals[:n].tobytes()], pa.binary())], names=["dim", "wide", "ids", "vals"])

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            dims = np.diff(offsets)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = flat[offsets[at][:, None] + np.arange(dim)]
                large = (np.abs(x) >= LARGEST / SCALE).any(1)
                for wide in (False, True):
                    own = large == wide
                    if own.any():
                        held.setdefault((dim, wide), []).append((ids[at[own]], x[own] if wide else np.floor(x[own] * SCALE).astype(np.int32)))
                        while sum(len(y[0]) for y in held[dim, wide]) >= size:
                            yield flush((dim, wide), size)
        for kind in list(held):
            if held[kind]:
                yield flush(kind, sum(len(y[0]) for y in held[kind]))

    return rows.mapInArrow(run, BLOCK_SCHEMA)


def _floor(x: float) -> int:
    """floor(SCALE * x) of any finite number."""
    return int(x) * SCALE if abs(x) >= 1 << 53 else math.floor(x * SCALE)


def unpacked(dim: int, wide: bool, ids: bytes, vals: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and rows of whole numbers of a block; Python's own numbers if 64 bits could be too few for a row."""
    ids_ = np.frombuffer(ids, np.int64)
    if not wide:
        return ids_, np.frombuffer(vals, np.int32).reshape(-1, dim)
    x = np.frombuffer(vals, np.float64)
    if np.abs(x).max() < 1 << 40:
        return ids_, np.floor(x * SCALE).astype(np.int64).reshape(-1, dim)
    return ids_, np.array([_floor(v) for v in x.tolist()], object).reshape(-1, dim)


def plain_top(ids: np.ndarray, vals: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``BitSliced.top``, by exact scores of all rows in whole numbers of any size."""
    bound = np.iinfo(np.int64)
    score = [min(max(int(x), bound.min), bound.max) for x in vals.astype(object) @ query.astype(object)]
    best = heapq.nsmallest(k, (i for i in range(len(ids)) if ids[i] != own), key=lambda i: (-score[i], ids[i]))
    return np.array(best, np.int64), np.array([score[i] for i in best], np.int64)


def _add(by_weight: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """The bit slices, least first, of a sum of bitmaps by the power of two each counts for (carry-save adders)."""
    out, w = [], 0
    top = max(by_weight, default=-1)
    while w <= top or by_weight.get(w):
        parts = by_weight.pop(w, [])
        x = np.concatenate(parts) if parts else None
        carries = []
        while x is not None and len(x) > 1:
            if len(x) == 2:
                carries.append(x[:1] & x[1:])
                x = x[:1] ^ x[1:]
                break
            n = len(x) // 3
            a, b, c = x[:n], x[n : 2 * n], x[2 * n : 3 * n]
            ab = a ^ b
            carries.append((a & b) | (c & ab))
            x = np.concatenate((ab ^ c, x[3 * n :])) if len(x) > 3 * n else ab ^ c
        out.append(x[0] if x is not None else None)
        if carries:
            by_weight.setdefault(w + 1, []).extend(carries)
        w += 1
    return out


class BitSliced:
    """The index of one block of rows."""

    def __init__(self, ids: np.ndarray, vals: np.ndarray):
        self.ids, self.vals, self.n = ids, vals.astype(np.int64), len(ids)
        above = self.vals - self.vals.min(0)
        self.bits = max(1, int(above.max()).bit_length())
        self.words = -(-self.n // 64)
        pad = np.zeros((self.words * 64, vals.shape[1]), np.int64)
        pad[: self.n] = above
        #: slices[b, d]: bitmap of bit b of attribute d.
        self.slices = np.stack([np.ascontiguousarray(np.packbits(((pad >> b) & 1).astype(np.uint8).T, axis=1, bitorder="little")).view(np.uint64) for b in range(self.bits)])
        alive = np.zeros(self.words * 64, np.uint8)
        alive[: self.n] = 1
        self.alive = np.packbits(alive, bitorder="little").view(np.uint64)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best rows but ``own``: higher score first, then smaller id."""
        weight = np.abs(query.astype(np.int64))
        used = np.flatnonzero(weight)
        flip = np.where(query[used] < 0, ~np.uint64(0), np.uint64(0))[:, None]
        by_bit = [(j, np.flatnonzero((weight[used] >> j) & 1)) for j in range(int(weight.max()).bit_length())] if used.size else []
        alive = self.alive.copy()
        for own_at in np.flatnonzero(self.ids == own).tolist():
            alive[own_at // 64] &= ~(np.uint64(1) << np.uint64(own_at % 64))
        left = int(np.bitwise_count(alive).sum())
        few = max(4 * k, self.n // 16)
        total, slack = [], int(weight.sum())
        for b in range(self.bits - 1, -1, -1):
            if left <= few or not used.size:
                break
            level = self.slices[b, used] ^ flip
            by_weight = {j: [level[at]] for j, at in by_bit if at.size}
            for i, s in enumerate(total):  # the sum so far counts twice
                if s is not None:
                    by_weight.setdefault(i + 1, []).append(s[None])
            total = _add(by_weight)
            if self.bits - b >= 3 or b == 0:
                worst = self._kth(total, alive, k) - slack * ((1 << b) - 1) // (1 << b) - 1
                if worst > 0:
                    alive &= self._at_least(total, worst)
                    left = int(np.bitwise_count(alive).sum())
        at = np.flatnonzero(np.unpackbits(alive.view(np.uint8), bitorder="little"))
        score = self.vals[at] @ query.astype(np.int64)
        best = np.lexsort((self.ids[at], -score))[:k]
        return at[best], score[best]

    @staticmethod
    def _kth(total: list, alive: np.ndarray, k: int) -> int:
        """The k-th largest sum of the rows alive (0 if fewer), from its most significant slice downward."""
        sure, maybe, value = 0, alive, 0
        for i in range(len(total) - 1, -1, -1):
            if total[i] is None:
                continue
            ones = maybe & total[i]
            n = int(np.bitwise_count(ones).sum())
            if sure + n >= k:
                maybe, value = ones, value + (1 << i)
            else:
                sure, maybe = sure + n, maybe & ~total[i]
        return value

    def _at_least(self, total: list, least: int) -> np.ndarray:
        """Bitmap of the rows whose sum is ``least`` or more."""
        if least >= 1 << len(total):
            return np.zeros(self.words, np.uint64)
        more, equal = np.zeros(self.words, np.uint64), np.full(self.words, ~np.uint64(0))
        for i in range(len(total) - 1, -1, -1):
            s = total[i]
            if least >> i & 1:
                equal = equal & s if s is not None else np.zeros(self.words, np.uint64)
            elif s is not None:
                more |= equal & s
                equal = equal & ~s
        return more | equal


def top_k(vectors: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best rows; ``is_query`` is over ``vec_id``."""
    rows = finite(vectors, vec_id, embedding)
    base = written(blocks(rows, BLOCK_ROWS), "vectors")
    asked = written(blocks(rows.filter(is_query), BLOCK_QUERIES), "queries")
    grid = max(1, min(base.count(), 4096))
    queries = max(1, asked.count())
    # every block of queries meets every block of rows in one tile of a grid of rows' parts and queries' parts
    tiles = min(queries, 1024)
    left = base.withColumn("_r", F.pmod(F.xxhash64("ids"), F.lit(grid))).select("*", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("_q"))
    right = asked.select(F.col("dim").alias("q_dim"), F.col("wide").alias("q_wide"), F.col("ids").alias("q_ids"), F.col("vals").alias("q_vals"), F.pmod(F.xxhash64("ids"), F.lit(tiles)).cast("int").alias("_q")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid - 1).cast("long"))).alias("_r"))
    tiled = left.join(right.hint("shuffle_merge"), ["_r", "_q"]).filter("dim = q_dim").select("dim", "wide", "ids", "vals", "q_wide", "q_ids", "q_vals")

    def run(batches):
        last, index = None, None  # successive tiles of one block of rows share its index
        for batch in batches:
            out = []
            for dim, wide, ids, vals, q_wide, q_ids, q_vals in zip(*(K.column(batch, c) for c in batch.schema.names), strict=True):
                at_ids, rows_ = unpacked(dim, wide, ids, vals)
                asked_ids, asked_rows = unpacked(dim, q_wide, q_ids, q_vals)
                small = not wide and not q_wide and dim * int(np.abs(rows_.astype(np.int64)).max()) * int(np.abs(asked_rows.astype(np.int64)).max()) < 1 << 60
                if small and last != (ids, vals):
                    last, index = (ids, vals), BitSliced(at_ids, rows_)
                for own, query in zip(asked_ids.tolist(), asked_rows, strict=True):
                    at, score = index.top(query, own, k) if small else plain_top(at_ids, rows_, query, own, k)
                    out.append((np.full(len(at), own), at_ids[at], score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    found = tiled.mapInArrow(run, FOUND_SCHEMA)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
