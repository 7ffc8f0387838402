"""What a row gets depends on the row alone; sizes beyond the usual; empty tables and nulls of every operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm import bpe_codec, kernels as K, language, quality, secret_scan, token_counts, topk
from linkloom.llm.queries import BYTE_BPE, _tokenizer

from . import corpus


def texts():
    good = [" ".join(corpus.words(60 + i % 40, i, 400)) for i in range(60)]
    bad = ["click here now " * 12 + " ".join(corpus.words(40, 900 + i, 60)) for i in range(60)]
    return good + bad + [t for t in corpus.awkward() if t is None or len(t) < 9000]


def arrangements(df):
    return df.repartition(1), df.repartition(7, "doc_id"), df.orderBy(F.desc("doc_id")).coalesce(1), df.sample(0.5, seed=3)


@pytest.mark.parametrize("more", range(6))
def test_quality_ngrams_of_a_last_stretch_shorter_than_they(monkeypatch, more):
    monkeypatch.setattr(K, "BLOCK_BYTES", 1 << 22)
    b = K.Block([(b"some words, " * (K.STRETCH // 12 + 1))[: K.STRETCH + more - 1]])  # and a line feed
    quality.base_counts(b)
    got = list(quality.ngram_buckets(b))
    monkeypatch.setattr(K, "STRETCH", 1 << 21)  # all in one stretch
    want = {f: at for f, at, _ in quality.ngram_buckets(b)}
    for f in want:
        assert (np.concatenate([at for g, at, _ in got if g == f]) == want[f]).all()


def test_quality_of_a_text_depends_on_the_text_alone(spark):
    all_ = texts()
    model = quality.Classifier.fit([t or "" for t in all_[:120]], np.array([1.0] * 60 + [0.0] * 60))
    df = corpus.table(spark, all_)
    want = {r.doc_id: r for r in quality.score(df, model).collect()}
    for other in arrangements(df):
        assert all(r == want[r.doc_id] for r in quality.score(other, model).collect())


def test_language_of_a_text_depends_on_the_text_alone(spark):
    all_ = texts()
    model = language.Centroids.fit([t or "" for t in all_[:120]], ["xx"] * 60 + ["yy"] * 60)
    df = corpus.table(spark, all_)
    want = {r.doc_id: r for r in language.predict(df, model).collect()}
    for other in arrangements(df):
        assert all(r == want[r.doc_id] for r in language.predict(other, model).collect())


def test_secrets_of_a_text_depend_on_the_text_alone():
    for a in ("token9f8 alone", "x"):
        alone, after = K.Block([a.encode()]), K.Block([b"before", a.encode(), b"after"])
        one, two = secret_scan.tokens(alone), secret_scan.tokens(after)
        for k in ("shape", "prev", "next", "before", "after", "file"):
            assert one[k].tolist() == two[k][two["of"] == 1].tolist(), k


@pytest.mark.parametrize("n", [400])
def test_every_language_is_learned(spark, n):
    """A language of its own alphabet each, ten rows or one; the rarest is learned too."""
    rows = [(i * 20 + j, " ".join(f"{chr(0x4E00 + 7 * i)}{chr(0x4E01 + 7 * i)}{w}" for w in range(30)), f"l{i:03d}") for i in range(n) for j in range(12 if i % 50 else 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df, F.lit(True))
    assert sorted(set(model.langs)) == sorted({r[2] for r in rows})


def test_top_k_of_components_of_any_size(spark):
    """Beyond 32 and 64 bits, and to the end of what a double holds."""
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.normal(size=3) * (10.0 ** rng.integers(-3, 8))]) for i in range(300)]
    vectors += [(400, [1.7e308, -1.0, 0.5]), (450, [1e6, 1e6, -1e6]), (500, [70000.0, 1.0, 0.0]), (501, [float("inf"), 0.0, 0.0]), (502, [0.1, None, 0.0]), (503, None)]
    df = spark.createDataFrame(vectors, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))]))
    whole = {i: [topk._floor(x) for x in v] for i, v in vectors if v and None not in v and float("inf") not in v}
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 10).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    limit = 2**63
    assert set(got) == {i for i in whole if i % 50 == 0}
    for q, ranks in got.items():
        best = sorted((-min(max(sum(a * b for a, b in zip(whole[q], v, strict=True)), -limit), limit - 1), i) for i, v in whole.items() if i != q)[:10]
        assert [(i, -s) for s, i in best] == [ranks[k] for k in range(1, 11)], q


@pytest.mark.parametrize("range_bytes", [1, 1000, 4096])
def test_long_files_are_read_in_ranges(spark, tmp_path, range_bytes):
    ids = np.random.default_rng(1).integers(0, 9, 20_001).astype("<u2")
    (tmp_path / "long.bin").write_bytes(ids.tobytes())
    (tmp_path / "short.bin").write_bytes(ids[:7].tobytes())
    blocks = token_counts.read_token_files(spark, str(tmp_path), block_tokens=256, range_bytes=range_bytes)
    got = {(r.file.split("/")[-1], r.ordinal): r.n_tokens for r in token_counts.count_tokens(blocks, 0).collect()}
    for name, part in (("long.bin", ids), ("short.bin", ids[:7])):
        want = [len(x) for x in "".join(map(str, part.tolist())).split("0")]
        want = want if want[-1] else want[:-1]
        assert [got[name, i] for i in range(len(want))] == want


def test_ids_beyond_the_vocabulary_decode_to_nothing():
    encoder = bpe_codec.ChunkEncoder(_tokenizer(BYTE_BPE))
    ids = np.frombuffer(encoder.encode(["some text"])[0], "<u4")
    assert encoder.decode(np.concatenate((ids, [999_999])).astype("<u4").tobytes()) == b"some text"


def test_empty_tables(spark):
    none = corpus.table(spark, ["x"]).filter("doc_id < 0")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert secret_scan.scan(none).count() == 0
    assert quality.quality_rules(none, labels).count() == 0
    assert quality.keep(none, labels.filter("doc_id < 0")).count() == 0
    assert language.identify(none).count() == 0
    assert sorted(r.lang_pred for r in language.identify(corpus.table(spark, ["letters here", "letters here", None], [2, 2, 2])).collect())[-1] in ("en", "und")
