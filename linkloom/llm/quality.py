"""Quality rules: base counts of every whole text and a calibrated n-gram classifier.

The classifier is a logistic regression on hashed word and character n-grams,
trained on a bounded sample of labelled rows (``SAMPLE`` at most, chosen by a
hash of doc_id, of texts of up to ``SAMPLE_BYTES``), calibrated on a held-out part, and scored in Arrow batches
against fixed thresholds.

Defined cases: a null or empty text has zero counts and fails the base rule
(fewer than 20 words). Null labels take no part in training. Without labels of
both classes the classifier keeps every document. Repeated rows each get their
row; other columns of the input are never looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .runtime import bounded, released, unit

BITS = 16
#: The bound of the labelled sample, in rows, and in bytes of each text that may be in it.
SAMPLE, SAMPLE_BYTES = 1500, 1 << 18
#: A text is rejected if its calibrated probability of being good is below this.
LEAST_PROBABILITY = 0.3
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 20, 30, 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_FAMILIES = 4

FEATURES_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double"


def base_counts(b: K.Block) -> dict[str, np.ndarray]:
    """The base counts of each text of a block; leaves the block's words and their hashes."""
    b.find_words()
    bounds = np.append(b.starts_of, b.data.size)
    starts_character = (b.data & 0xC0) != 0x80
    word_chars = K.sums_of(b.inside & starts_character, bounds)
    n_symbols = K.sums_of(_SYMBOL[b.data], bounds)
    ends = np.flatnonzero(b.data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    worded = np.searchsorted(b.starts, ends) > np.searchsorted(b.starts, starts)
    starts, ends = starts[worded], ends[worded]
    of = np.searchsorted(b.ends_of, ends)
    lines = _dup(b.hashes(starts, ends), of)
    first_seen = np.bincount(of, minlength=b.n) - np.bincount(of[lines[1]], minlength=b.n)
    n_dup_lines = first_seen
    b.word_hash = b.hashes(b.starts, b.ends)
    h, of = b.windows(b.word_hash, WINDOW)
    twice = _dup(h, of)[0]
    cover = np.zeros(b.starts.size + 1, np.int64)
    at = b.window_at[twice] if h.size else np.zeros(0, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, np.minimum(at + WINDOW, b.starts.size), -1)
    n_repeat = K.sums_of(np.cumsum(cover)[:-1] > 0, b.words)
    return {"n_words": b.n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat}


def _dup(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values occur twice or more within a text (mask), and the places of one of each distinct value."""
    key = K.mix(h + (of.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    _, first, back, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return n[back] > 1, first


def ngram_buckets(b: K.Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(family, buckets, bounds of each text) of words, word pairs, 3 and 5 bytes; byte grams come by stretches.

    No n-gram runs over the end of its text, so what a text has depends on the text alone.
    """
    low = np.uint64(64 - BITS)
    for f, k in enumerate((1, 2)):
        h, of = b.windows(b.word_hash, k)
        yield f, (h >> low).astype(np.int32), np.searchsorted(of, np.arange(b.n + 1))
    for f, k in ((2, 3), (3, 5)):
        last = np.maximum(b.starts_of, b.ends_of - k + 1)  # where a text's n-grams end to begin
        for lo in range(0, b.data.size, K.STRETCH):
            hi = min(lo + K.STRETCH, b.data.size)
            data = K.LOWER[b.data[lo : hi + k - 1]].astype(np.uint32)
            code = np.zeros(data.size, np.uint32)
            for j in range(k):
                code[: max(0, data.size - j)] += data[j:]  # a last stretch may be shorter than an n-gram
                code *= np.uint32(0x01000193)
            code ^= code >> np.uint32(15)
            first, end = np.clip(b.starts_of, lo, hi) - lo, np.clip(last, lo, hi) - lo
            inside = np.zeros(hi - lo + 1, np.int8)
            np.add.at(inside, first, 1)
            np.add.at(inside, end, -1)
            inside = np.cumsum(inside[:-1]) > 0
            bounds = np.concatenate(([0], np.cumsum(end - first)))
            yield f, (code[: hi - lo][inside] * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.int32), bounds


#: Weights are summed as whole numbers of this size, so that a sum doesn't depend on what else a block holds.
_GRAIN = 2.0**-32


def _linear(families: Iterable[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, n: int) -> np.ndarray:
    """The mean weight of each family's n-grams, summed over families, for each of ``n`` texts."""
    total, count = np.zeros((_FAMILIES, n), np.int64), np.zeros((_FAMILIES, n), np.int64)
    for f, at, bounds in families:
        total[f] += K.sums_of(weights[f][at], bounds)
        count[f] += np.diff(bounds)
    return (total * _GRAIN / np.maximum(1, count)).sum(0)


class Classifier:
    """Weights by family and bucket (whole numbers of ``_GRAIN``), an intercept, and the slope and offset of the calibration."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = np.round(weights / _GRAIN).astype(np.int64), bias, slope, offset

    def probability(self, b: K.Block) -> np.ndarray:
        """Of each text of a block whose words are hashed."""
        z = _linear(ngram_buckets(b), self.weights, b.n) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30)))

    @classmethod
    def fit(cls, texts: list[str], y: np.ndarray, rounds: int = 120, rate: float = 0.5, decay: float = 1e-5) -> Classifier:
        """Full-batch Adam on four fifths of the rows; the last fifth calibrates by Platt's method."""
        width, parts = _FAMILIES << BITS, []
        for first, b in K.blocks(texts):  # each block's own sparse rows, in 12 bytes an entry
            base_counts(b)
            for f, family in groupby(ngram_buckets(b), lambda x: x[0]):  # families come in order, one at a time is sorted
                keys, count = [], np.zeros(b.n, np.int64)
                for _, bucket, bounds in family:
                    of = np.repeat(np.arange(b.n, dtype=np.int32), np.diff(bounds))
                    keys.append((of.astype(np.int64) << BITS) | bucket)
                    count += np.diff(bounds)
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                row, col = (key >> BITS).astype(np.int32), ((key & ((1 << BITS) - 1)) + (f << BITS)).astype(np.int32)
                parts.append((slice(first, first + b.n), row, col, (n / np.maximum(1, count[row])).astype(np.float32)))
                del keys, key, n
        fit = np.arange(len(texts)) % 5 != 0
        share = np.where(y > 0, 0.5 / max(1, (y[fit] > 0).sum()), 0.5 / max(1, (y[fit] <= 0).sum())) * fit
        w, bias = np.zeros(width), 0.0
        m, v = np.zeros(width), np.zeros(width)

        def linear() -> np.ndarray:
            z = np.zeros(len(texts))
            for at, row, col, val in parts:
                z[at] += np.bincount(row, val * w[col], at.stop - at.start)
            return z + bias

        for k in range(1, rounds + 1):
            e = (1 / (1 + np.exp(-np.clip(linear(), -30, 30))) - y) * share
            g = decay * w
            for at, row, col, val in parts:
                g += np.bincount(col, val * e[at][row], width)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
            bias -= rate * 0.2 * e.sum()
        z = linear()
        held = ~fit if (~fit).sum() >= 20 and len(set(y[~fit])) == 2 else fit
        return cls(w.reshape(_FAMILIES, -1), bias, *_platt(z[held], y[held]))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make a sigmoid of ``z`` the frequency of ``y`` (smoothed targets, Newton steps)."""
    scale = max(1e-9, float(np.abs(z).max()))
    x = np.stack([z / scale, np.ones_like(z)], 1)
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    c = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        c = c + np.clip(np.linalg.solve(h, x.T @ (t - p) - 1e-3 * c), -5, 5)
    return max(0.0, float(c[0])) / scale, float(c[1])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Classifier | None:
    """Fit on at most about ``sample`` labelled documents, chosen by a hash of doc_id; None without both classes."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("_y"))
    total = known.count()
    if not total:
        return None
    share = min(1.0, sample / total)
    few = known.filter(unit(F.col("doc_id")) < share).groupBy("doc_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample)
    rows = docs.select("doc_id", "text").filter(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_y").alias("_y"))

    # the bounded sample is one task's; executors have no room for its training beside their stages, so the driver trains
    rows = rows.coalesce(1).sortWithinPartitions("doc_id").select("text", "_y").toArrow()
    y = np.array(rows.column("_y").to_pylist(), float) > 0
    texts = rows.column("text").to_pylist()
    del rows
    model = Classifier.fit(texts, y.astype(float)) if len(set(y)) == 2 else None
    del texts
    released()
    return model


def _verdict(b: K.Block, model: Classifier | None, least: float) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Counts, whether the base rule fails, the probability, and whether each text of a block is kept."""
    c = base_counts(b)
    failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED_PERCENT * c["n_words"])
    p = model.probability(b) if model else np.ones(b.n)
    return c, failed, p, ~failed & (p >= least)


def score(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, base_failed and the calibrated probability."""

    def run(batches):
        for batch in K.small_batches(batches, "text"):
            texts = K.column(batch, "text")
            for first, b in K.blocks(texts):
                c, failed, p, _ = _verdict(b, model, LEAST_PROBABILITY)
                ids = batch.column(0).slice(first, b.n)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(p.astype(float))], names=[f.split()[0] for f in re.split(", ", FEATURES_SCHEMA)])

    return bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, FEATURES_SCHEMA)


def quality_rules(docs: DataFrame, labels: DataFrame, least: float = LEAST_PROBABILITY) -> DataFrame:
    """``score`` with a classifier trained on ``labels``, and ``kept``: not base_failed and probability >= ``least``."""
    return score(docs, train(docs, labels)).withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= least))


def keep(docs: DataFrame, labels: DataFrame, least: float = LEAST_PROBABILITY) -> DataFrame:
    """The rows of ``docs`` that the rules keep, whole and unchanged, without a shuffle of texts."""
    model = train(docs, labels)
    at = docs.columns.index("text")

    def run(batches):
        for batch in K.small_batches(batches, "text"):
            kept = [_verdict(b, model, least)[-1] for _, b in K.blocks(batch.column(at).to_pylist())]
            yield batch.filter(pa.array(np.concatenate(kept))) if kept else batch

    return bounded(docs).mapInArrow(run, docs.schema)
