"""Pair features: two key joins bring the prepared records together, one Arrow UDF per text pair scores them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.udf import best_trade_name, similarity
from .blocking import word_cosine
from .prepare import Lexicon

NEEDED = "entity_id norm_name norm_addr core distinct pc unit house arr nums name_nums landmark dba key_indic key_french nonlatin core_freq ckey".split()
FEATURES = (
    "blk_name blk_core blk_text n_blockers "
    "name_tset core_tset name_tsort core_tsort name_part core_part name_ratio core_ratio name_wr core_wr name_jw core_exact "
    "addr_tset addr_part addr_ratio name_idfcos addr_idfcos pc_both pc_eq house_eq num_jacc acronym core_freq_s1 core_freq_s23 "
    "name_len_ratio addr_len_a addr_len_b is_s3 distinct_tset distinct_jacc name_conflict "
    "name_soft_min name_soft_max addr_soft_min addr_soft_max name_tset_ml addr_core_tset name_key_indic name_key_french "
    "landmark_a landmark_b landmark_sim has_dba name_dba_best name_num_conflict unit_eq arr_eq nonlatin_a nonlatin_b cross_script"
).split()


def gathered(pairs: DataFrame, s1: DataFrame, s23: DataFrame, columns=NEEDED) -> DataFrame:
    """``pairs`` with the columns of both records: a_<column> of Source 1, b_<column> of the other."""
    for side, key, table in (("a", "s1_id", s1), ("b", "s23_id", s23)):
        pairs = pairs.join(table.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{side}_{c}") for c in columns if c != "entity_id"]), key)
    return pairs


def native_features(rows: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """The features that Column expressions give; nulls where evidence is missing."""
    lexicon = lexicon or Lexicon()
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    known = (X.text(a("pc")) != "") & (X.text(b("pc")) != "")
    flag = lambda c: c.cast("double")
    return rows.withColumns(
        {
            "core_exact": flag(a("core") == b("core")),
            "pc_both": flag(known),
            **{f"{k}_eq": X.same_if_known(a(k), b(k)) for k in ("pc", "house", "unit", "arr")},
            "num_jacc": X.jaccard(a("nums"), b("nums")),
            "acronym": X.acronym(a("core"), b("core")),
            "core_freq_s1": F.log1p(a("core_freq")),
            "core_freq_s23": F.log1p(b("core_freq")),
            "name_len_ratio": X.length_ratio(a("norm_name"), b("norm_name")),
            "addr_len_a": flag(F.length(a("norm_addr"))),
            "addr_len_b": flag(F.length(b("norm_addr"))),
            "is_s3": flag(F.col("s23_id").startswith("S3-")),
            "distinct_jacc": X.jaccard(F.array_distinct(X.tokens(a("distinct"))), F.array_distinct(X.tokens(b("distinct")))),
            "name_conflict": X.name_conflict(a("norm_name"), b("norm_name"), lexicon.lookalikes(a("ckey"))),
            "landmark_a": flag(a("landmark") != ""),
            "landmark_b": flag(b("landmark") != ""),
            "has_dba": flag((F.size(a("dba")) > 1) | (F.size(b("dba")) > 1)),
            "name_num_conflict": flag((F.size(a("name_nums")) > 0) & (F.size(b("name_nums")) > 0) & (a("name_nums") != b("name_nums"))),
            "nonlatin_a": flag(a("nonlatin")),
            "nonlatin_b": flag(b("nonlatin")),
            "cross_script": flag(a("nonlatin") != b("nonlatin")),
        }
    )


def pair_features(candidates: DataFrame, s1: DataFrame, s23: DataFrame, lexicon: Lexicon | None = None, scorers=None) -> DataFrame:
    """s1_id, s23_id and all ``FEATURES`` of candidate pairs of prepared tables."""
    pairs = candidates
    for view, name in (("norm_name", "name_idfcos"), ("norm_addr", "addr_idfcos")):
        pairs = word_cosine(pairs, s1, s23, view, name)
    rows = native_features(gathered(pairs, s1, s23), lexicon)
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    rows = rows.withColumns(
        {
            "_name": similarity(a("norm_name"), b("norm_name"), "tset", "tsort", "part", "ratio", "wr", "jw", "soft_min", "soft_max", scorers=scorers),
            "_core": similarity(a("core"), b("core"), "tset", "tsort", "part", "ratio", "wr", scorers=scorers),
            "_addr": similarity(a("norm_addr"), b("norm_addr"), "tset", "part", "ratio", "soft_min", "soft_max", scorers=scorers),
            "_distinct": similarity(a("distinct"), b("distinct"), "tset", scorers=scorers),
            "_indic": similarity(a("key_indic"), b("key_indic"), "tset", scorers=scorers),
            "_french": similarity(a("key_french"), b("key_french"), "tset", scorers=scorers),
            "_landmark": similarity(a("landmark"), b("landmark"), "tset", scorers=scorers),
            "name_dba_best": best_trade_name(a("dba"), b("dba")),
        }
    )
    both = lambda c: (X.text(a(c)) != "") & (X.text(b(c)) != "")
    rows = rows.withColumns(
        {
            **{f"name_{n}": F.col(f"_name.{n}") for n in ("tset", "tsort", "part", "ratio", "wr", "jw", "soft_min", "soft_max")},
            **{f"core_{n}": F.col(f"_core.{n}") for n in ("tset", "tsort", "part", "ratio", "wr")},
            **{f"addr_{n}": F.col(f"_addr.{n}") for n in ("tset", "part", "ratio", "soft_min", "soft_max")},
            "distinct_tset": F.col("_distinct.tset"),
            "name_tset_ml": F.when(both("norm_name"), F.col("_name.tset")),
            "addr_core_tset": F.when(both("norm_addr"), F.col("_addr.tset")),
            "name_key_indic": F.when(both("key_indic"), F.col("_indic.tset")),
            "name_key_french": F.when(both("key_french"), F.col("_french.tset")),
            "landmark_sim": F.when(both("landmark"), F.col("_landmark.tset")),
        }
    )
    have = set(rows.columns)
    return rows.select("s1_id", "s23_id", *[F.col(f).cast("float").alias(f) if f in have else F.lit(None).cast("float").alias(f) for f in FEATURES])


# --- native candidates for rules, kept apart from the learned model -------------


def structured_key_pairs(s1: DataFrame, s23: DataFrame, *keys: str) -> DataFrame:
    """Pairs that share all of some non-empty parts (postcode and house, say): an equi-join, no similarity."""
    good = lambda t: t.filter(" and ".join(f"{k} <> ''" for k in keys))
    return good(s1).select(F.col("entity_id").alias("s1_id"), *keys).join(good(s23).select(F.col("entity_id").alias("s23_id"), *keys), list(keys)).select("s1_id", "s23_id")
