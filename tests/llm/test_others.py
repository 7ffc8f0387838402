"""Sharding, quality, search, language, substrings, secrets, and the pipeline."""

import collections
import functools
import hashlib
import re
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkloom.llm import language, quality, secret_scan, sharding, substring_dedup, topk
from linkloom.llm import kernels as K

from . import corpus

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


# --- sharding -----------------------------------------------------------------


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [0, 1, 256, 2**32 - 1, 2**32, 2**63, 2**64 - 1, *(int(hashlib.md5(str(i).encode()).hexdigest()[:16], 16) for i in range(300))]
    df = spark.createDataFrame([(k >> 32, k & 0xFFFFFFFF) for k in keys], "h long, l long")
    for many in (1, 2, 24, 25, 1000):
        got = [r.s[0] for r in df.select(sharding.jump_hash(F.col("h"), F.col("l"), many).alias("s")).collect()]
        assert got == [jump(k, many) for k in keys]


def test_sharding(spark):
    ts = corpus.awkward() * 20
    ids = [*range(len(ts) - 2), None, 5]
    rows = sharding.shard(corpus.table(spark, ts, ids), 24).collect()
    assert len(rows) == len(ts)
    slots = collections.defaultdict(list)
    for r in rows:
        if r.doc_id is not None:
            key = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:16], 16)
            assert r.shard == jump(key, 24) and r.grown_shard == jump(key, 25)
        assert r.grown_shard in (r.shard, 24) and r.law == "key"
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    crc = collections.Counter((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in ts)
    assert crc == collections.Counter((r["size"], r.text_crc32) for r in rows)
    assert sharding.shard(corpus.table(spark, ["x"]).filter("doc_id < 0"), 24).count() == 0


# --- quality ------------------------------------------------------------------


def counts(text):
    w = corpus.WORD.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if corpus.WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))


def test_base_counts(spark):
    ts = [*corpus.awkward(), "a b c d e f g h\n" * 4, "#$%&*|<>", "x\n\nx\ny\nx ", " ".join(["r"] * 30)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in quality.quality_rules(corpus.table(spark, ts), labels).collect():
        n = counts(ts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and r.kept == (not r.base_failed)


def test_classifier_tells_held_out_texts_apart(spark):
    texts = [" ".join(corpus.words(60, i)) for i in range(200)] + ["%%% ".join(corpus.words(60, i)) for i in range(200, 400)]
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(400) if i % 2] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality_rules(corpus.table(spark, texts), labels).filter("doc_id % 2 = 0").collect()
    assert np.mean([r.kept == (r.doc_id < 200) for r in rows]) > 0.97
    kept = quality.keep(corpus.table(spark, texts, extra=False), labels)
    assert kept.columns == [f.name for f in corpus.DOCS] and {r.doc_id for r in kept.collect()} >= {r.doc_id for r in rows if r.kept}


def test_training_is_small_and_gives_its_memory_back(spark, monkeypatch):
    """What the driver's Python keeps from training, it keeps for all later stages."""
    texts = [" ".join(corpus.words(3000, i)) for i in range(40)] + ["%%% ".join(corpus.words(3000, i)) for i in range(40, 80)]
    y = np.array([1.0] * 40 + [0.0] * 40)
    tracemalloc.start()
    want = quality.Classifier.fit(texts, y, rounds=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * sum(map(len, texts))
    calls = []
    monkeypatch.setattr(quality, "released", lambda: calls.append(1), raising=False)
    monkeypatch.setattr(quality.Classifier, "fit", functools.partial(quality.Classifier.fit, rounds=3))
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(80)], "doc_id long, quality int, toxic int")
    got = quality.train(corpus.table(spark, texts), labels)
    assert calls and (got.weights == want.weights).all() and (got.bias, got.slope, got.offset) == (want.bias, want.slope, want.offset)
    assert quality.train(corpus.table(spark, texts), labels.filter("quality = 1")) is None


# --- top-k --------------------------------------------------------------------


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(700, 8)).astype(np.float32)
    vectors[100:300] = vectors[100]
    rows = [(int(i), v.tolist(), 0) for i, v in enumerate(vectors)] + [(1000, None, 0), (1001, [], 0), (1002, [1.0, None] * 4, 0), (1003, [float("nan")] * 8, 0), (1004, [float("inf")] * 8, 0), (1100, [0.0] * 8, 0), (1200, [1.0, 2.0], 0), (1201, [3.0, 4.0], 0), (None, [1.0] * 8, 0), (1300, [1e30] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit(1)).repartition(3)
    got = collections.defaultdict(dict)
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 10).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    whole = lambda v: np.array([int(x) for x in np.floor(1024 * np.array(v, np.float32).astype(float))], object)
    good = [(i, whole(v)) for i, v, _ in rows if i is not None and i not in range(1000, 1005)]
    for q, x in [g for g in good if g[0] % 50 == 0]:
        want = sorted(((-min(max(int(x @ y), -(2**63)), 2**63 - 1), i) for i, y in good if i != q and len(y) == len(x)))[:10]
        assert [got[q][k + 1] for k in range(len(want))] == [(i, -s) for s, i in want]
    assert set(got) == {g[0] for g in good if g[0] % 50 == 0}
    assert topk.top_k(df.filter("vec_id < 0"), F.col("vec_id") % 50 == 0, 10).count() == 0


# --- language -----------------------------------------------------------------


@tables
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language.identify(docs).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_language_cases(spark):
    rows = language.identify(corpus.table(spark, [*corpus.awkward(), "123 456 !!"])).collect()
    by = {r.doc_id: r for r in rows}
    assert by[0].lang_pred == by[1].lang_pred == by[15].lang_pred == "und" and by[0].score == 0
    assert by[4].lang_pred == "en"
    assert {r.lang_pred for r in language.identify(corpus.table(spark, ["a b"]).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# --- substrings ---------------------------------------------------------------


def plain_repeats(docs):
    """{doc_id: removed (start, end) bytes} by chunking each text alone and looking in all earlier ones."""
    seen, out = {}, {}
    for i, t in docs:
        b = K.Block([(t or "").encode()])
        c = substring_dedup.Chunks(b)
        own = [bytes(b.data[b.starts[f] : b.ends[z]]) for f, z in zip(c.first, c.last, strict=True)]
        flags = []
        for k, chunk in enumerate(own):
            flags.append(chunk in seen)
            seen.setdefault(chunk, (i, k))
        runs, k = [], 0
        while k < len(flags):
            j = k
            while j < len(flags) and flags[j]:
                j += 1
            if j > k:
                f, z = c.first[k], c.last[j - 1]
                if z - f + 1 >= substring_dedup.LEAST_WORDS:
                    runs.append((int(b.starts[f]), int(b.ends[z])))
            k = max(j, k + 1)
        out[i] = runs
    return out


def test_repeated_passages(spark):
    passage = " ".join(corpus.words(70, 8))
    texts = [*corpus.awkward(), *[" ".join(corpus.words(40, 100 + i)) + " " + passage + " " + " ".join(corpus.words(30, 200 + i)) for i in range(12)], " ".join(corpus.words(90, 77))]
    df = corpus.table(spark, texts).repartition(3)
    want = plain_repeats(list(enumerate(texts)))
    got = collections.defaultdict(list)
    for r in substring_dedup.repeated_passages(df).collect():
        t = texts[r.doc_id]
        got[r.doc_id].append((len(t[: r.start].encode()), len(t[: r.end].encode())))
        assert r.earlier_doc_id <= r.doc_id
    assert {i: sorted(s) for i, s in got.items()} == {i: s for i, s in want.items() if s}
    assert set(range(16, 27)) <= set(got) and 15 not in got and 27 not in got
    kept = {r.doc_id: r for r in substring_dedup.deduplicate(df).collect()}
    assert len(kept) == len(texts) and all((kept[i].text == texts[i]) == (i not in got) for i in kept)
    assert kept[20].n_chars == len(kept[20].text) < len(texts[20]) and kept[0].text is None
    assert substring_dedup.deduplicate(df).columns == df.columns


def test_repeats_of_repeated_rows(spark):
    t = " ".join(corpus.words(80, 9))
    df = corpus.table(spark, [t, t, t, "x " + t, None], [4, 4, 9, 4, None])
    got = collections.Counter(r.doc_id for r in substring_dedup.repeated_passages(df).collect())
    assert got[9] == 1  # rows 0 and 1 are one document, the other text of id 4 and id 9 repeat it or are repeated
    assert substring_dedup.repeated_passages(df.filter("doc_id < 0")).count() == 0


def test_chunks_of_several_documents_make_no_passage(spark):
    """Every chunk of the last text is in an earlier one, but no 14 words in a row are."""
    text = corpus.words(400, 31, 100_000)
    b = K.Block([" ".join(text).encode()])
    c = substring_dedup.Chunks(b)
    own = [text[f : z + 1] for f, z in zip(c.first.tolist(), c.last.tolist(), strict=True)]
    around = corpus.words(len(own) * 40, 32, 100_000)
    texts = []
    for k, chunk in enumerate(own):
        # the words about a chunk that let it be cut the same way, and others
        before = own[k - 1][-2:] if k else []
        texts.append(" ".join([*around[k * 40 : k * 40 + 20], *before, *chunk, *(own[k + 1][:1] if k + 1 < len(own) else []), *around[k * 40 + 20 : k * 40 + 40]]))
    texts.append(" ".join(text))
    seen = {tuple(w[i : i + 14]) for t in texts[:-1] for w in [t.split()] for i in range(len(w) - 13)}
    df = corpus.table(spark, texts)
    for r in substring_dedup.repeated_passages(df).collect():
        w = texts[r.doc_id][r.start : r.end].split()
        held = {k for i in range(len(w) - 13) if tuple(w[i : i + 14]) in seen for k in range(i, i + 14)}
        assert held == set(range(len(w)))
    assert any(len(chunk) < 14 for chunk in own) and sum(map(len, own)) == len(text)


def test_spans_cover_every_row_of_chunks_with_enough_words():
    b = K.Block([" ".join(corpus.words(n, 40 + n)).encode() for n in (3, 14, 90, 400)])
    c = substring_dedup.Chunks(b)
    spans = list(zip(c.span_first.tolist(), c.span_last.tolist(), strict=True))
    assert all(c.words[a : z + 1].sum() >= 14 and c.of[a] == c.of[z] for a, z in spans)
    for i in range(b.n):
        for a in range(c.base[i], c.base[i + 1]):
            for z in range(a, min(a + 9, c.base[i + 1])):
                if c.words[a : z + 1].sum() >= 14:
                    assert {k for x, y in spans if a <= x and y <= z for k in range(x, y + 1)} == set(range(a, z + 1))


def test_cuts_resist_insertions():
    a = " ".join(corpus.words(500, 4)).encode()
    b = b"inserted words " + a
    x, y = (set(c.tolist()) for c in K.gear_cuts([a, b], 5))
    assert len({v + 15 for v in x} & y) >= len(x) - 1


# --- secrets ------------------------------------------------------------------


def plain_base(text):
    out = []
    for kind, pattern, keep in (
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ):
        out += [(m.start(), ("assign", "access", "hex").index(kind), m.end(), kind) for m in re.finditer(pattern, text or "") if keep(m)]
    return sorted(out)


def test_secrets(spark):
    h = "0123456789abcdef" * 2
    ts = [*corpus.awkward(), f'é token = "{h}" x', "PassWord: short", "api_key=abcdefgh AKIA" + "B" * 12, "token: secret: abcdefghij", "secret='a" + "b" * 9 + "' " + h + h, "AKIAB AKIA" + "C" * 11, "toKen : " + h, "x" + h + "g"]
    rows = {r.doc_id: r for r in secret_scan.scan(corpus.table(spark, ts)).collect()}
    for i, t in enumerate(ts):
        base = plain_base(t)
        said = ",".join(f"{k}:{s}:{e}" for s, _, e, k in base)
        n = collections.Counter(k for *_, k in base)
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == (n["assign"], n["access"], n["hex"])
        assert rows[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(rows[i].spans.split(","))
    red = {r.doc_id: r for r in secret_scan.redact(corpus.table(spark, ts)).collect()}
    assert h not in red[15].text and red[15].text.startswith("é [secret]") and red[15].n_chars == len(red[15].text) and red[0].text is None


@pytest.fixture(scope="module")
def field():
    return secret_scan.fit([" ".join(corpus.words(60, i)) for i in range(80)])


def test_field_finds_forms_the_patterns_miss(field):
    found = lambda t: secret_scan.scan_texts(pa.array([t]), field)[0]
    for t in ("my key ghp_abcdEFGH1234ijklMNOP5678qrstUVWX90 here", "Bearer eyJhbGciOiJIUzI1NiIsInR5cCI6.eyJzdWIiOiIxMjM0NTY3ODkwIiwibmFtZSI6.SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV_adQssw5c"):
        assert [k for _, k, _ in found(t)] == [3]
    for t in ("w1 w2 w3 w4", "call 12345678 or mail a.b@mail3.example.com on 2024-05-06", ""):
        assert found(t) == []


def test_stretches_give_the_viterbi_path(field):
    rng = np.random.default_rng(2)
    bits = ["w1", "Zx9Kq81LmN0pQ2rS", "ghp_abcdEFGH1234ijkl", "=", "token", "abc", "9f8e7d6c5b4a39281706f5e4d3c2b1a0", "A1B2-C3D4"]
    for _ in range(60):
        b = K.Block([" ".join(rng.choice(bits, 25)).encode()])
        t = secret_scan.tokens(b)
        labels = field.viterbi(field.scores(t).astype(float), False, False)
        want, i = [], 0
        while i < len(labels):
            j = i
            if labels[i]:
                while j + 1 < len(labels) and labels[j + 1] == secret_scan.INSIDE:
                    j += 1
                want.append((i, j))
            i = j + 1
        assert field.tag(t) == want


# --- the pipeline ---------------------------------------------------------------


@tables
def test_pipeline(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in C.STAGES:
        after = stage(spark, before, SF).cache()
        if name != C.STAGES[-1][0]:
            assert after.columns == docs.columns
        if name == "near duplicates":
            comp = corpus.components([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in after.select("doc_id").collect()} == set(comp.values())
        if name == "secrets":
            assert after.count() == before.count()
            assert not any(plain_base(r.text) for r in after.collect())
        before = after
    assert {r.doc_id for r in before.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert C.run(spark, SF).count() == before.count()
