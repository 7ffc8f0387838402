"""Golden cases of the text functions, and what nulls and empty texts give."""

import pytest
from pyspark.sql import functions as F

from linkloom.functions import text as X


def one(spark, expr, *values):
    row = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values)))).select(expr(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()
    return row.x


@pytest.mark.parametrize(
    ("raw", "kind", "expected"),
    [
        ("12 - 3 / 456", "addr", "12-3-456"),
        ("10001-1234", "addr", "10001"),
        ("560 001", "addr", "560001"),
        ("5th 2eme", "name", "5 2"),
        ("12 bis", "addr", "12b"),
        ("m g rd", "addr", "mg rd"),
        ("joe's", "name", "joe"),
        ("M/s. A B C Brothers & Sons Private Limited", "name", "abc bros and sons pvt ltd"),
        ("Cœur", "name", "coeur"),
        (None, "name", ""),
        ("", "addr", ""),
    ],
)
def test_normalize(spark, raw, kind, expected):
    assert one(spark, lambda c: X.normalize(c, kind), raw) == expected


@pytest.mark.parametrize(
    ("word", "style", "key"),
    [("sri", "indic", "sr"), ("shri", "indic", "sr"), ("shree", "indic", "sr"), ("sree", "indic", "sr"), ("lakshmi", "indic", "lxm"), ("laxmi", "indic", "lxm"), ("chaudhary", "indic", "ctr"), ("chowdhury", "indic", "ctr"), ("dupont", "french", "dpn"), ("dupond", "french", "dpn"), ("thibault", "french", "tb"), ("thibaut", "french", "tb"), ("12b", "french", "12b")],
)
def test_phonetic_key(spark, word, style, key):
    assert one(spark, lambda c: X.phonetic_key(c, style), word) == key


@pytest.mark.parametrize(("raw", "expected"), [("hea1th", "health"), ("6roup", "group"), ("lnc", "inc"), ("c0m", "com"), ("12b", "12b"), ("a18a", "a18a"), ("4x4", "4x4"), ("A1", "a1"), (None, "")])
def test_fix_ocr(spark, raw, expected):
    assert one(spark, X.fix_ocr, raw) == expected


def test_names_and_countries(spark):
    assert one(spark, X.split_trade_names, "ABC Holdings LLC dba Joe's Pizza") == ["ABC Holdings LLC", "Joe's Pizza"]
    assert one(spark, X.split_trade_names, None) == [""]
    assert [one(spark, X.canon_country, c) for c in ("U.S.A.", "bharat", "Peru", None)] == ["US", "INDIA", "PERU", ""]
    assert [one(spark, X.country_key, c) for c in ("usa", "Peru", None)] == ["US", "*", "*"]
    assert one(spark, X.core_name, "the and of") == "the and of"
    assert one(spark, X.initials, "alpha beta") == "ab" and one(spark, X.initials, "alpha") == ""
    assert one(spark, X.nonlatin, "नमस्ते") and not one(spark, X.nonlatin, "Été")


def test_addresses(spark):
    parts = one(spark, X.address_parts, "12 rue shop 7b paris 75008")
    assert (parts.pc, parts.unit, parts.house, parts.arr) == ("75008", "7b", "12", "paris8")
    parts = one(spark, X.address_parts, None)
    assert (parts.pc, parts.unit, parts.house, parts.arr) == ("", "", "", "")
    split = one(spark, X.split_landmarks, "12 Main Road, near City Mall, Pune")
    assert split.landmark.strip() == "near City Mall" and "Main Road" in split.core and "Mall" not in split.core
    assert one(spark, lambda c, a: X.region_key(c, a), "INDIA", "road pune nagpur") == "MH"
    assert one(spark, lambda c, a: X.region_key(c, a), "INDIA", "pune chennai") == ""
    assert one(spark, lambda c, a: X.region_key(c, a), "PERU", "pune") == ""


def test_pairs(spark):
    conflict = lambda a, b: X.name_conflict(a, b, F.array(F.lit("patel|patil")))
    assert one(spark, conflict, "patel co", "patil co") == 1.0
    assert one(spark, conflict, "patel", "patel patil") == 0.0
    assert one(spark, X.is_abbreviation, "mfg", "manufacturing") and not one(spark, X.is_abbreviation, "x", "x")
    assert one(spark, X.same_if_known, "", "1") is None and one(spark, X.same_if_known, "1", "1") == 1.0
    assert one(spark, lambda a, b: X.jaccard(X.numbers(a), X.numbers(b)), "a", "b") is None


def test_tokens_evaluate_their_text_once(spark):
    """Each mention of a normalised text would run the whole normaliser again."""
    plan = spark.range(1).select(X.tokens(F.upper(F.col("id").cast("string"))).alias("w"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(") == 1
