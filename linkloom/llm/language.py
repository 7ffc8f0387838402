"""Language identification: nearest of several clustered centroids per language.

Texts become normalised TF-IDF vectors of hashed character n-grams; each learned
language has up to ``CENTROIDS`` centroids from spherical k-means. A text gets the
language of the nearest centroid by cosine. It is ``accepted`` unless its distance
from that centroid is beyond the one that all but a thousandth of the learning
texts keep (distance-based rejection); the prediction stays a learned language.

The centroids and n-gram weights are fitted on a bounded sample of rows of known
language, chosen by a hash: about ``PER_LANGUAGE`` per language and ``SAMPLE`` in all,
or ``LEAST_ROWS`` per language where that is more, of texts of up to ``SAMPLE_BYTES``.
Every language that has such a text is learned. Prediction covers every row.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and
not accepted. With nothing to learn from, every text is. Repeated rows each get
their row; other columns of the input are never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .runtime import bounded, unit

BITS = 12
CENTROIDS = 3
#: Bounds of the learning sample: rows of a language, rows in all where there are few languages, rows that every
#: language may have however many there are, and bytes of a text.
PER_LANGUAGE, SAMPLE, LEAST_ROWS, SAMPLE_BYTES = 400, 3000, 10, 1 << 18
_LETTERS = np.where([c >= 128 or 97 <= c <= 122 for c in K.LOWER.tolist()], K.LOWER, 32).astype(np.uint32)
PREDICTED_SCHEMA = "doc_id long, lang_pred string, score double, accepted boolean"


_DAMPED = np.concatenate(([0], 1 + np.log(np.arange(1, 1 << 12)))).astype(np.float32)


def vectors(b: K.Block) -> np.ndarray:
    """Counts of each text's hashed 2- and 3-byte grams of letters (ASCII in lower case), dampened: 1 + ln, up to 4,095.

    A blank ends each text; no gram runs beyond it, so a text's vector depends on the text alone.
    """
    low, total = np.uint32(32 - BITS), np.zeros(b.n << BITS, np.int64)
    bounds = np.append(b.starts_of, b.data.size)
    ends = np.zeros(b.data.size + 2, bool)
    ends[b.ends_of] = True
    for lo in range(0, b.data.size, K.STRETCH):
        hi = min(lo + K.STRETCH, b.data.size)
        code = _LETTERS[np.append(b.data[lo : hi + 2], [32, 32])[: hi - lo + 2]]
        of = np.repeat(np.arange(b.n, dtype=np.uint32) << np.uint32(BITS), np.diff(np.clip(bounds, lo, hi)))
        two = code[:-1] * np.uint32(257) + code[1:]
        three = two[:-1] * np.uint32(257) + code[2:]
        two = two[:-1]
        keep = (two != 32 * 257 + 32) & ~ends[lo:hi]
        for gram, good in ((two, keep), (three, keep & ~ends[lo + 1 : hi + 1])):
            total += np.bincount(of[good] | ((gram[good] * np.uint32(0x9E3779B1)) >> low), minlength=total.size)
    return _DAMPED[np.minimum(total, 4095)].reshape(b.n, -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Centroids:
    """Weights of n-grams, centroids, the language of each, and the least cosine of each that is accepted."""

    def __init__(self, idf: np.ndarray, centres: np.ndarray, langs: list[str], least: np.ndarray):
        self.idf, self.centres, self.langs, self.least = idf, centres, langs, least

    @classmethod
    def fit(cls, texts: list[str], langs: list[str]) -> Centroids:
        x = np.concatenate([vectors(b) for _, b in K.blocks(texts)])
        idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
        x = _unit(x * idf)
        names = np.array(langs, object)
        centres, of, least = [], [], []
        for lang in sorted(set(langs)):
            own = x[names == lang]
            c = own[np.linspace(0, len(own) - 1, min(CENTROIDS, len(own))).astype(int)]
            for _ in range(8):
                near = (own @ c.T).argmax(1)
                c = _unit(np.stack([own[near == i].sum(0) if (near == i).any() else c[i] for i in range(len(c))]))
            cosine = own @ c.T
            near = cosine.argmax(1)
            for i in range(len(c)):
                centres.append(c[i])
                of.append(lang)
                least.append(np.quantile(cosine[near == i, i], 0.001) if (near == i).any() else 0.0)
        return cls(idf, np.stack(centres).astype(np.float64), of, np.array(least))

    def predict(self, b: K.Block) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each text and the cosine."""
        cosine = np.round(_unit((vectors(b) * self.idf).astype(np.float64)) @ self.centres.T, 9)  # the same whatever else a block holds
        near = cosine.argmax(1)
        return near, np.clip(cosine[np.arange(b.n), near], 0, 1)


def train(docs: DataFrame, learn: Column) -> Centroids | None:
    """Fit on rows where ``learn`` holds and lang is known, up to the documented bounds."""
    known = docs.select("doc_id", "text", "lang", learn.alias("_learn")).filter(F.col("_learn") & F.col("lang").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES) & F.col("text").rlike(r"\p{L}"))
    known = known.select("doc_id", "text", "lang", unit(F.concat_ws("\n", F.col("doc_id").cast("string"), F.md5("text"))).alias("_at"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), F.min("_at").alias("first")).collect()
    if not counts:
        return None
    each = min(PER_LANGUAGE, max(LEAST_ROWS, SAMPLE // len(counts)))
    # a language's first row is always in
    share = known.sparkSession.createDataFrame([(r["lang"], max(each / r["n"], r["first"])) for r in counts], "lang string, _share double")
    rows = known.join(F.broadcast(share), "lang").filter(F.col("_at") <= F.col("_share")).select("doc_id", "text", "lang").limit(4 * max(SAMPLE, each * len(counts))).toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending"), ("lang", "ascending")])
    return Centroids.fit(rows.column("text").to_pylist(), rows.column("lang").to_pylist()) if rows.num_rows else None


def predict(docs: DataFrame, model: Centroids | None) -> DataFrame:
    """doc_id, lang_pred, score (cosine of the nearest centroid) and accepted, of every row."""

    def run(batches):
        for batch in K.small_batches(batches, "text"):
            text = batch.column(1)
            lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            step = 128
            for at in range(0, batch.num_rows, step):
                part = text.slice(at, step).to_pylist()
                for first, b in K.blocks(part):
                    ok = lettered[at + first : at + first + b.n] & (model is not None)
                    near, score = model.predict(b) if model else (np.zeros(b.n, int), np.zeros(b.n))
                    langs = [model.langs[i] if o else "und" for i, o in zip(near.tolist(), ok.tolist(), strict=True)]
                    score = np.where(ok, score, 0.0)
                    accepted = ok & (score >= model.least[near]) if model else ok
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at + first, b.n), pa.array(langs, pa.string()), pa.array(score.astype(float)), pa.array(accepted)], names=[f.split()[0] for f in PREDICTED_SCHEMA.split(", ")])

    return bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, PREDICTED_SCHEMA)


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learned from: crc32 of the id's text, modulo 4, is 2. A null id is not in it."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Train outside the held-out fold and predict every row: doc_id, held_out, lang_pred, score, accepted."""
    model = train(docs, ~held_out(F.col("doc_id")))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
