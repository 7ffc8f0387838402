"""Small corpora with every awkward case, and brute-force versions of the operators."""

import collections
import re

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, seed=0, size=900):
    x, out = seed * 7919 + 13, []
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(f"w{(x >> 33) % size}")
    return out


def awkward():
    long_ = " ".join(words(30_000, 5))
    return [None, "", "   \n\t ", "one", "two words", "UPPER lower UPPER", "été naïve ÅÄÖ 日本語 текст \U0001f600", "\x00 nul \x1f and\x0b tabs\x0c", "<|endoftext|> in <|startoftext|> text", "İstanbul ΣΑΣ straße ſ", "a" * 5000, long_, "same same same", "same same same", "x" * 3 + " " + "y z"]


def table(spark, texts, ids=None, extra=True):
    rows = [(ids[i] if ids else i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:  # columns with the names that operators use inside
        for c in ("ids", "digest", "node", "key", "part", "shard", "component", "mark", "salt", "_doc", "_y", "n"):
            df = df.withColumn(c, df["source"])
    return df


def near_copies(base, n, seed, share=0.05):
    out = []
    for k in range(n):
        w, noise = list(base), words(len(base), seed + k, 10_000)
        for i in range(len(w)):
            if (i * 31 + k * 17 + seed) % 997 < share * 200:
                w[i] = noise[i]
        out.append(" ".join(w))
    return out


LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(docs):
    """{doc_id: least doc_id reachable} over all pairs."""
    sets = collections.defaultdict(list)
    for i, t in docs:
        sets[i].append(shingles(t))
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    rows = [(i, s) for i, ss in sets.items() for s in ss if s]
    for x, (i, a) in enumerate(rows):
        for j, b in rows[:x]:
            both = len(a & b)
            if 100 * both >= 75 * (len(a) + len(b) - both):
                p, q = sorted((find(i), find(j)))
                up[q] = p
    return {i: find(i) for i in sets}
