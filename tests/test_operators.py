"""Policy, sources, components, the model and the stream, on small tables."""

import pytest
from pyspark.sql import functions as F

from linkloom.functions import udf
from linkloom.operators import blocking, mining, policy
from linkloom.operators.pairs import FEATURES
from linkloom.operators.prepare import Lexicon, prepare
from linkloom.sources import records as R
from linkloom.streaming import incremental


def pairs(spark, rows):
    return spark.createDataFrame(rows, "s1_id string, s23_id string, score double")


def test_selection_order(spark):
    rows = pairs(spark, [("a", "x", 0.9), ("a", "y", 0.7), ("a", "z", 0.5), ("b", "x", 0.8)])
    got = {(r.s1_id, r.s23_id) for r in policy.select_matches(rows, "score", 0.6, 0.75).collect()}
    assert got == {("a", "x")}  # b lost x before ranking


def test_metric_golden_cases(spark):
    truth = spark.createDataFrame([("a", "1"), ("a", "3")], "s1_id string, s23_id string")
    pred = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "3"), ("c", "9")], "s1_id string, s23_id string")
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "s1_id string")
    got = {r.s1_id: r.f05 for r in policy.per_entity(pred, truth, ids).collect()}
    assert got["a"] == pytest.approx(0.714, abs=5e-4) and got["b"] == 1.0 and got["c"] == 0.0


def test_lists_and_findings(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "s1_id string")
    got = {r[0]: r[1] for r in policy.id_lists(pairs(spark, [("a", "S3-2", 1.0), ("a", "S2-1", 1.0), ("a", "S2-1", 1.0)]), ids).collect()}
    assert got == {"a": "S2-1,S3-2", "b": ""}
    lists = spark.createDataFrame([("a", "S2-1,S2-1"), ("a", "S1-4"), ("z", "Q-1")], "source1_entity_id string, matched_entity_ids string")
    found = {r.finding for r in policy.findings(lists, ids).collect()}
    assert found == {"repeated_id", "duplicate_row", "self_match", "wrong_prefix", "missing_s1", "extra_s1"}


def test_tsv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("S1-1", 'say "NA"', "", "fr"), ("S1-2", "x", "\\N", "")], R.RECORD)
    R.write_tsv(rows, f"file://{tmp_path}/t")
    back = R.read_tsv(spark, f"file://{tmp_path}/t", R.RECORD)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    twice = rows.unionByName(rows)
    R.write_tsv(twice, f"file://{tmp_path}/u")
    with pytest.raises(R.ContractError):
        R.read_tsv(spark, f"file://{tmp_path}/u", R.RECORD)
    assert R.read_optional(spark, f"file://{tmp_path}/none", R.RECORD).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in mining.components(edges).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[101] == 100


def test_components_of_long_chains_take_few_rounds(spark, monkeypatch):
    """Words stand in a chain in any order, as w9, w10 do: a label that moves by one word a round takes hundreds of rounds."""
    tables = []

    def counted(df, name, made=mining.staged):
        tables.append(name)
        assert len(tables) <= 60, "too many rounds"
        return made(df, name)

    monkeypatch.setattr(mining, "staged", counted)
    chain = [f"w{i * 389 % 1009}" for i in range(1009)]
    edges = list(zip(chain, chain[1:], strict=False)) + [("x", "x"), ("y", "z"), ("z", "y"), ("v", None)] + [("star", f"s{i}") for i in range(20)]
    got = [tuple(r) for r in mining.components(spark.createDataFrame(edges, "a string, b string")).collect()]
    want = dict.fromkeys(chain, "w0") | {"x": "x", "y": "y", "z": "y", "v": "v", None: None, "star": "s0"} | {f"s{i}": "s0" for i in range(20)}
    assert len(got) == len(want) and dict(got) == want
    assert mining.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_char_grams(spark):
    g = spark.createDataFrame([("ab c",)], "t string").select(blocking.char_grams(F.col("t")).alias("g")).first().g
    assert sorted(g) == sorted([" ab", "ab ", " ab ", " c "])


def test_similarity_takes_other_scorers(spark):
    df = spark.createDataFrame([("a", None)], "a string, b string")
    s = df.select(udf.similarity(F.col("a"), F.col("b"), "ratio", "own", scorers={"own": lambda x, y: 50.0}).alias("s")).first().s
    assert s.ratio == 0 and s.own == 0.5


def test_prepare_with_lexicon_and_scripts(spark):
    lexicon = Lexicon(words=[("FRANCE", "addr", "r", "rue"), ("*", "name", "tamil nadu", "tn")], classes=[("US", "inc", "legal_form")])
    rows = spark.createDataFrame([("S1-1", "Ram lnc", "5 Main Road, near Mall", "usa"), ("S2-1", "राम", "12 r de lille", "fr"), ("S3-1", None, None, None)], R.RECORD)
    got = {r.entity_id: r for r in prepare(rows, lexicon).collect()}
    assert got["S1-1"].norm_name == "ram inc" and got["S1-1"].distinct == "ram" and "mall" in got["S1-1"].landmark
    assert got["S2-1"].norm_name == "ram" and got["S2-1"].nonlatin and got["S2-1"].norm_addr.startswith("12 rue")
    assert got["S3-1"].norm_name == "" and got["S3-1"].country == ""


def test_feature_names():
    assert len(FEATURES) == len(set(FEATURES)) == 54


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tAlpha Limited\t1 Main Road\tusa\n")
    q = incremental.prepare_into(incremental.record_stream(spark, str(tmp_path / "in")), f"file://{tmp_path}/out", f"file://{tmp_path}/ck", romanise=False)
    q.awaitTermination(60)
    assert spark.read.parquet(f"file://{tmp_path}/out").first().norm_name == "alpha ltd"


def test_transliteration_candidates_of_frequent_words(spark, tmp_path):
    """Words seen six times or more have candidates too, and targets count from 20."""
    from linkloom.plans import queries

    text = " ".join(["limited"] * 20 + ["limitid"] * 8 + ["limitad"] * 3 + ["limitud"] * 2)
    spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.token: r.candidates for r in queries.transliteration_candidates(spark, str(tmp_path)).collect()}
    assert got == {"limitid": ["limited"], "limitad": ["limited"]}


def test_swap_partners_come_first(spark):
    """Partners that are no targets don't use up places; words without partners have the others' candidates only."""
    from linkloom.operators import judging

    rows = [("phuds", w, 50 - i, 0.5) for i, w in enumerate(["xylem", "foods", "meals", "grub", "fare", "snacks"])] + [("phuds", "rarely", 90, 0.01), ("two words", "phuds", 80, 0.5), ("stor", "phuds", 1, 0.5)]
    swapped = spark.createDataFrame(rows, "a string, b string, n long, rate double")
    words = spark.createDataFrame([("phuds",), ("stor",), ("qq",)], "token string")
    targets = spark.createDataFrame([(w,) for w in ("foods", "meals", "grub", "fare", "snacks", "store", "rarely")], "token string")
    got = {r.token: r.candidates for r in judging.transliterations(words, targets, swapped=swapped).collect()}
    assert got["phuds"][:4] == ["foods", "meals", "grub", "fare"] and len(set(got["phuds"])) == len(got["phuds"]) <= 12
    assert "rarely" not in got["phuds"] and got["stor"] == ["store"] and "qq" not in got


def test_romanised_reads_whole_texts(spark, tmp_path):
    from linkloom.plans import queries

    spark.createDataFrame([(1, "one two three four five six seven राम", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    (row,) = queries.romanised(spark, str(tmp_path)).collect()
    last = row.latin.split()[-1]
    assert len(row.latin.split()) == 8 and last.isascii() and last.startswith("r")


def test_nearest_words_are_those_of_all_pairs(spark):
    """Filters by letters and steps of ratios leave out no word that a comparison of all pairs finds."""
    from linkloom.functions import kernels as K

    text = "trading traders trade raiding shop shoppe shoop shops bread broad board hoard aab aabb abab bbaa oo ooo zx zxq qzx lenient lenses rents spent ent entente".split()
    grams = lambda w: {f" {w} "[i : i + 3] for i in range(max(1, len(w)))}
    pairs_ = {(a, b): K.ratio(a, b) for a in text for b in text if a != b and grams(a) & grams(b)}
    best = {a: [b for _, b in sorted((-r, b) for (x, b), r in pairs_.items() if x == a)] for a in text}
    words = spark.createDataFrame([(w, w) for w in text], "token string, form string")
    for most in (1, 3, 6):
        got = mining.nearest(words, words.toDF("target", "other"), most).collect()
        assert {(r.token, r.target, r["rank"]) for r in got} == {(a, b, i + 1) for a in text for i, b in enumerate(best[a][:most])}
    got = {(r.token, r.other) for r in mining.similar_words(words, 70, 50).collect()}
    assert got == {p for p, r in pairs_.items() if r >= 70}
    plan = mining.alike(words, words.toDF("target", "other"), 0.85)._jdf.queryExecution().executedPlan().toString()
    assert "bit_count" in plan  # unlike pairs go where they are joined


def test_search_over_all_grams_is_that_of_all_pairs(spark):
    """Words of every record count, as do grams of one record; copies, ids with two texts and ties come as without shared vectors."""
    import math
    from collections import Counter

    names = ["red ring", "ring red", "red ring zq", "red bolt", "old bolt", "old ring red red"]
    a = [(f"S1-{i}", "g" if i % 7 else "h", names[i % 6]) for i in range(140)] + [("S1-1", "h", "old bolt"), ("S1-1", "g", "red"), ("S1-x", "g", " "), ("S1-y", "g", "qqqq")]
    b = [(f"S2-{i}", "g" if i % 5 else "h", names[i * i % 5]) for i in range(140)] + [("S2-z", "g", "red ring zq xv"), ("S2-4", "h", "ring")]
    grams = lambda t: [f" {w} "[i : i + k] for w in t.split() for k in (3, 4) for i in range(max(1, len(w) + 3 - k)) if k == 3 or len(w) > 1]

    def counts(rows):
        out = {}
        for i, g, t in rows:
            out.setdefault((g, i), Counter()).update(grams(t))
        return {k: v for k, v in out.items() if v}

    pool = counts(b)
    n, df = Counter(g for g, _ in pool), Counter((g, x) for (g, _), v in pool.items() for x in v)

    def vector(g, tf):
        x = {t: (1 + math.log(c)) * (math.log((1 + n[g]) / (1 + df[g, t])) + 1) for t, c in tf.items() if (g, t) in df}
        size = math.sqrt(sum(v * v for v in x.values()))
        return {t: v / size for t, v in x.items()}

    one, two = ({k: vector(k[0], v) for k, v in c.items()} for c in (counts(a), pool))
    sims = Counter()
    for (g, i), x in one.items():
        for (h, j), y in two.items():
            if g == h and x.keys() & y.keys():
                sims[i, j] += sum(x[t] * y[t] for t in x.keys() & y.keys())
    for k in (1, 3, 40):
        want = {(i, j, s) for q in {i for i, _ in sims} for s, j, i in sorted(((-round(s, 6), j, i) for (i, j), s in sims.items() if i == q))[:k] if -s >= blocking.MIN_SIM}
        sides = (spark.createDataFrame(rows, "id string, grp string, name string") for rows in (a, b))
        got = {(r.s1_id, r.s23_id): r.sim for r in blocking.top_k_of_all(*sides, k).collect()}
        assert got.keys() == {(i, j) for i, j, _ in want} and all(abs(got[i, j] + s) < 2e-6 for i, j, s in want)


def test_blocking_recall_of_frequent_words(spark, tmp_path):
    """In groups of more than 50 records with few words every record finds some: a bound on frequent grams left none."""
    from linkloom.plans import queries

    words = ["red", "old", "hot", "new"]
    rows = [(i, f"{words[i % 4]} {words[i // 4 % 4]}", "PROMO", "Brand#1", i % 2) for i in range(400)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    (r,) = queries.blocking_recall(spark, str(tmp_path)).collect()
    assert r.total == 400 and r.found > 0


def test_candidates_of_frequent_words(spark, tmp_path):
    """Each record of a group of few words has its five candidates: a bound on frequent grams left none."""
    from linkloom.plans import queries

    words = ["red", "old", "hot", "new"]
    rows = [(i, f"{words[i % 4]} {words[i // 4 % 4]}", "PROMO", "Brand#1", i % 2) for i in range(400)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = queries.candidates_union(spark, str(tmp_path)).groupBy("s1_id").count().collect()
    assert len(found) == 400 and {r["count"] for r in found} == {5}


def test_nearest_in_cells_is_that_of_all_pairs(spark, monkeypatch):
    """Words in several cells, longer than 64 letters, of other scripts and of several parts; the kernel scores what can be near alone."""
    from linkloom.functions import kernels as K
    from linkloom.functions import near

    text = "trading traders trade raiding shop shops board hoard aab abab oo zx éclair éclat éclairs क्षेत्र क्षेत् ab1 ab2 a".split() + ["ab" * 40, "ab" * 41, "x" * 64, "x" * 65, "to be", "to bee"]
    text = sorted(text, key=str.encode)
    grams = lambda t: {f" {w} "[i : i + 3] for w in t.split() for i in range(len(w))}
    pairs_ = {(a, b): K.ratio(a, b) / 100 for a in text for b in text if grams(a) & grams(b)}
    best = {a: sorted((-r, b.encode()) for (x, b), r in pairs_.items() if x == a) for a in text}
    others = near.Others(text)
    for most in (1, 4, 40):
        got = [(text[f], -float(s), text[o].encode()) for f, o, s in zip(*others.nearest(text, most), strict=True)]
        assert sorted(got) == sorted((a, *x) for a in text for x in best[a][:most])
    scored = []
    monkeypatch.setattr(near.Others, "common", lambda self, forms, which, other, real=near.Others.common: scored.extend(other) or real(self, forms, which, other))
    near.Others([f"zz{i:04d}" for i in range(2000)] + ["trade"]).nearest(["trade"], 1)
    assert len(scored) == 1
    monkeypatch.setattr(mining, "FORMS", 5)
    monkeypatch.setattr(mining, "OTHERS", 7)
    words = spark.createDataFrame([(w, w) for w in text], "token string, form string")
    got = {(r.token, r.target, r["rank"]) for r in mining.nearest(words, words.toDF("target", "other"), 3).collect()}
    assert got == {(a, b.decode(), i + 1) for a in text for i, (_, b) in enumerate([x for x in best[a] if x[1] != a.encode()][:3])}
