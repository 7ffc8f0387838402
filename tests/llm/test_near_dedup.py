from pathlib import Path

import pytest
from pyspark.sql import functions as F

from linkloom.llm import graph, near_dedup
from linkloom.llm.runtime import skew_lookup, work_dir, written

from . import corpus


def check(spark, texts, ids=None):
    df = corpus.table(spark, texts, ids)
    got = near_dedup.near_duplicates(df).collect()
    rows = [(ids[i] if ids else i, t) for i, t in enumerate(texts)]
    want = corpus.components([r for r in rows if r[0] is not None])
    assert len(got) == len(texts)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id]
            assert r.kept == (r.doc_id == want[r.doc_id])
    sizes = sorted(r.n_shingles for r in got)
    assert sizes == sorted(len(corpus.shingles(t)) for t in texts)


def test_awkward_texts(spark):
    check(spark, corpus.awkward())


def test_families_beyond_long_lists(spark):
    """Families larger than a short list, with members that only some others reach."""
    base = corpus.words(150, 1)
    texts = corpus.near_copies(base, 40, 3, 0.06) + corpus.near_copies(base, 30, 90, 0.17) + corpus.near_copies(corpus.words(40, 2), 25, 7, 0.08)
    passage = " ".join(corpus.words(60, 8))
    texts += [passage + " " + " ".join(corpus.words(30 + i, 200 + i)) for i in range(40)]
    check(spark, texts)


def test_a_large_family_with_members_at_the_threshold(spark):
    """Longer and shorter copies at 0.75 to 0.80 that share only runs of long lists with their family."""
    base = corpus.words(240, 5, 100_000)
    texts = [" ".join(base), *corpus.near_copies(base, 120, 11, 0.02)]
    texts += [" ".join(base + corpus.words(60 + i % 18, 700 + i, 100_000)) for i in range(60)]
    texts += [" ".join(base[: 182 + i % 12] + corpus.words(i // 12, 900 + i, 100_000)) for i in range(60)]
    check(spark, texts)


def test_rare_values_reach_every_pair_the_estimate_passes():
    least = near_dedup.least_shared
    assert [least(n) for n in (1, 2, 3, 4, 8, 40, 48)] == [1, 2, 3, 3, 6, 30, 36]
    assert least(49) == least(64) == least(10_000) == 29  # such a set may meet one whose sketch leaves values out


def test_small_sets_at_the_threshold(spark):
    w = [f"t{i}" for i in range(40)]
    texts = [" ".join(w[a:b]) for a in range(4) for b in range(a + 3, 22)]
    check(spark, texts)


def test_repeated_and_null_ids(spark):
    long_ = " ".join(corpus.words(50, 1))
    check(spark, [long_, long_, "other text of five words here", long_, None], [7, 7, 7, None, 2])


def test_empty(spark):
    df = corpus.table(spark, ["x"]).filter("doc_id < 0")
    assert near_dedup.near_duplicates(df).count() == 0
    assert near_dedup.without_duplicates(df).count() == 0


def test_block_links_report_each_component_once():
    import numpy as np

    left = [(1, 1, np.arange(20)), (2, 2, np.arange(50, 60))]
    right = [(5, 5, np.arange(20)), (6, 5, np.arange(1, 21)), (7, 7, np.arange(19)), (1, 1, np.arange(20))]
    found = near_dedup.block_links(left, right, slice_=7)
    assert len(found) == 2 and {a for a, _ in found} == {1} and {b for _, b in found} & {5, 6} and 7 in {b for _, b in found}
    assert near_dedup.block_links([(1, 1, np.zeros(0, np.int64))], [(2, 2, np.arange(3))]) == []


@pytest.mark.parametrize("n", [1, 40])
def test_components_of_chains_and_stars(spark, n):
    edges = [(i + 1, i) for i in range(n)] + [(1000, 1000 + i) for i in range(1, 300)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and all(got[1000 + i] == 1000 for i in range(300))


def test_components_of_a_long_ascending_chain(spark):
    """Each vertex's least neighbour is its predecessor, so a round without doubling takes in one vertex."""
    n = 400
    edges = [(i, i + 1) for i in range(n)] + [(5000 + i, 5000 + i + d) for i in range(100) for d in (1, 2)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {5000 + i: 5000 for i in range(102)}


def test_skew_lookup_is_a_left_join(spark):
    big = written(spark.range(5000).select(F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).cast("long").alias("k"), "id"), "big")
    small = spark.range(0, 5000, 5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionByName(spark.createDataFrame([(7, 14)], "k long, v long"))
    got = {(r.id, r.v) for r in skew_lookup(big, "k", small).collect()}
    assert got == {(r.id, r.v) for r in big.join(small, "k", "left").select("id", "v").collect()}


def test_pairs_that_share_a_passage_with_all_others(spark):
    """120 pairs; all documents open with the same ten words, so half of what a pair shares lies in one long list."""
    head, texts = " ".join(f"head{i}" for i in range(10)), []
    for i in range(120):
        own = " ".join(f"p{i}x{j}" for j in range(4))
        texts += [f"{head} {own} a{i} b{i}", f"{head} {own} c{i}"]
    check(spark, texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_sets_with_shared_passages(spark, seed):
    """Sets of 1 to 200 shingles: passages of all lengths, copies cut, extended and edited, around the threshold."""
    import random

    r = random.Random(seed)
    passages = [[f"s{p}w{i}" for i in range(r.randint(3, 60))] for p in range(6)]
    texts = []
    for d in range(60):
        base = [f"d{d}w{i}" for i in range(r.randint(1, 120))]
        for p in r.sample(passages, r.randint(0, 2)):
            at = r.randint(0, len(base))
            base[at:at] = p
        texts.append(" ".join(base))
        for c in range(r.choice([0, 1, 1, 3, 24]) if d % 12 else 30):
            copy = list(base)
            kind = r.randint(0, 2)
            if kind == 0:
                copy = copy[: max(1, int(len(copy) * r.uniform(0.7, 1)))]
            elif kind == 1:
                copy += [f"e{d}c{c}w{i}" for i in range(int(len(copy) * r.uniform(0, 0.4)))]
            else:
                for _ in range(1 + len(copy) // 60):
                    copy[r.randrange(len(copy))] = f"f{d}c{c}"
            texts.append(" ".join(copy))
    check(spark, texts)


def test_lists_by_length(spark):
    """Short lists, long ones that the sort gathers, and heavy ones, with batches that end within a list."""
    rows = [(k, n) for k, size in enumerate([1, 2, 16, 17, 40, 3, 500, 2]) for n in range(size)]
    df = written(spark.createDataFrame(rows, "key long, node long"), "list-rows")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch, classes in ((3, 10), (7, 10**6), (10000, 10**6), (5, 100_000)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            got = near_dedup.lists(df, classes).collect()
            assert sorted(sorted(r.members) for r in got if r.members is not None) == sorted(list(range(n)) for n in (2, 2, 3, 16))
            assert sorted((r.key, r.node) for r in got if r.members is None) == sorted((k, n) for k, n in rows if k in (3, 4, 6))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("most", [1 << 30, 0])
def test_templates_larger_than_the_pivots_reach(spark, monkeypatch, most):
    """Both ways from open lists to links. One page filled in many ways: slots from few choices, so all values are common and components many."""
    import random

    plain = near_dedup.open_links
    monkeypatch.setattr(near_dedup, "open_links", lambda *a: plain(*a, most=most))
    r = random.Random(5)
    slots = [[" ".join(f"t{s}c{c}w{i}" for i in range(9)) for c in range(3)] for s in range(12)]
    texts = [" ".join(r.choice(s[: 1 + (k % 3)]) for s in slots) for k in range(150)]
    check(spark, texts)


def test_repeated_ids_with_different_texts(spark):
    """Document 5 has two texts: one is a copy of 3, one of 8, so 3, 5 and 8 are one component."""
    a, b = " ".join(corpus.words(40, 21)), " ".join(corpus.words(40, 22))
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(corpus.table(spark, [a, a, b, b], [3, 5, 5, 8])).collect()}
    assert got == {(3, 3), (5, 3), (8, 3)}


def test_wide_lookup_is_a_left_join(spark):
    big = written(spark.range(5000).select(F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).cast("long").alias("k"), "id"), "big")
    small = spark.range(0, 5000, 5).select(F.col("id").alias("k"), F.array("id").alias("v")).unionByName(spark.createDataFrame([(7, [14])], "k long, v array<long>"))
    got = {(r.id, str(r.v)) for r in skew_lookup(big, "k", small, wide=True).collect()}
    assert got == {(r.id, str(r.v)) for r in big.join(small, "k", "left").select("id", "v").collect()}


def test_a_text_of_fifty_megabytes(spark):
    """Hashing goes by stretches: a copy of a very long text is found, and a word longer than a stretch is one word."""
    from linkloom.llm import kernels as K

    word = "z" * (3 << 20)
    b = K.Block([f"one {word} two".encode(), word.encode()])
    b.find_words()
    h = b.hashes(b.starts, b.ends)
    assert h[1] == h[3] and len(set(h.tolist())) == 3
    few = K.Block([b"alpha beta", b"beta"])
    few.find_words()
    assert few.hashes(few.starts, few.ends)[1] == few.hashes(few.starts, few.ends)[2]
    long_ = " ".join(f"{i:07d}" for i in range(50 << 17))
    sets = near_dedup.shingle_sets([long_])
    assert len(sets[0]) == (50 << 17) - 4


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("key", ["id", "cast(null as long)", "id % 2500"])
def test_lookup_without_hot_keys(spark, key, wide):
    big = written(spark.range(5000).selectExpr(f"{key} AS k", "id"), "big")
    small = spark.range(0, 5000, 3).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = {(r.id, r.v) for r in skew_lookup(big, "k", small, wide=wide).collect()}
    assert got == {(r.id, r.v) for r in big.join(small, "k", "left").select("id", "v").collect()} and len(got) == 5000


@pytest.mark.parametrize("wide", [False, True])
def test_lookup_by_hot_digests(spark, wide):
    """Two digests hold two thirds of the rows, another is null; only one hot digest is known."""
    digest = F.when(F.col("id") % 3 == 0, F.unhex(F.lit("00ff"))).when(F.col("id") % 3 == 1, F.unhex(F.lit("27"))).when(F.col("id") % 5 > 0, F.encode(F.col("id").cast("string"), "UTF-8"))
    big = written(spark.range(6000).select(digest.alias("k"), "id"), "big")
    small = big.filter("id % 2 = 0 and k is not null and k <> unhex('27')").groupBy("k").agg(F.max("id").alias("v"))
    got = {(r.id, r.v) for r in skew_lookup(big, "k", small, wide=wide).collect()}
    assert got == {(r.id, r.v) for r in big.join(small, "k", "left").select("id", "v").collect()} and len(got) == 6000


def test_scratch_tables_go(spark):
    """Only the tables that a result reads are left in the shared folder."""
    folder = Path(work_dir(spark).removeprefix("file:"))
    texts = corpus.near_copies(corpus.words(60, 1), 30, 3, 0.06) + ["x y z", None]
    df = corpus.table(spark, texts)
    before = set(folder.iterdir())
    kept = near_dedup.without_duplicates(df)
    assert [p.name.split("-")[0] for p in set(folder.iterdir()) - before] == ["gone"]
    want = corpus.components(list(enumerate(texts)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in want if want[i] == i)
    before = set(folder.iterdir())
    found = near_dedup.near_duplicates(df)
    assert sorted(p.name.split("-")[0] for p in set(folder.iterdir()) - before) == ["known", "signed"]
    assert {r.doc_id: r.component_id for r in found.collect()} == want
