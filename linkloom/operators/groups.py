"""Group context of scored pairs: windows over a record's candidates on either side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.udf import similarity

BASE = "name_tset name_wr core_tset core_exact addr_tset addr_core_tset pc_eq house_eq num_jacc name_idfcos addr_idfcos blk_text blk_name n_blockers name_soft_min addr_soft_max distinct_jacc name_conflict is_s3".split()


def side_stats(df: DataFrame, keys, score: str, ties, suffix: str) -> DataFrame:
    """Rank, size, margin to the best other and the best other's score within ``keys``; nulls where there is no other."""
    whole = Window.partitionBy(*keys)
    order = whole.orderBy(F.desc(score), *ties)
    full = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(order)
    other = F.when(rank == 1, F.nth_value(score, 2).over(full)).otherwise(F.max(score).over(whole))
    return df.withColumns({f"g_rank_{suffix}": rank, f"g_n_{suffix}": F.count("*").over(whole), f"g_margin_{suffix}": F.col(score) - other, f"g_best_other_{suffix}": other})


def strong_others(df: DataFrame, key: str, score: str, levels=(0.5, 0.9)) -> DataFrame:
    """How many other pairs of the group score at least each level."""
    w = Window.partitionBy(key)
    return df.withColumns({f"g_n_ge{round(t * 100)}_{key.split('_')[0]}": F.sum((F.col(score) >= t).cast("int")).over(w) - (F.col(score) >= t).cast("int") for t in levels})


def best_other(df: DataFrame, score: str) -> DataFrame:
    """The best other candidate of the same Source 1 record and its score (columns other_id, g_top_p)."""
    order = Window.partitionBy("s1_id").orderBy(F.desc(score), "s23_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = Window.partitionBy("s1_id").orderBy(F.desc(score), "s23_id")
    first = F.row_number().over(place) == 1
    return df.withColumns({"other_id": F.when(first, F.nth_value("s23_id", 2).over(order)).otherwise(F.first("s23_id").over(order)), "g_top_p": F.when(first, F.nth_value(score, 2).over(order)).otherwise(F.first(score).over(order))})


def same_address_support(df: DataFrame, score: str, address: str = "norm_addr") -> DataFrame:
    """Other candidates of the same Source 1 record at the same address: their number (0 without address) and best score."""
    stats = side_stats(df, ["s1_id", address], score, ["s23_id"], "addr")
    has = F.coalesce(F.col(address), F.lit("")) != ""
    return stats.withColumns({"g_same_addr_n": F.when(has, F.col("g_n_addr") - 1).otherwise(F.lit(0)), "g_same_addr_max": F.when(has, F.col("g_best_other_addr"))}).drop("g_rank_addr", "g_n_addr", "g_margin_addr", "g_best_other_addr")


def s1_side(scored: DataFrame, score: str, s23: DataFrame) -> DataFrame:
    """The features of a pair among its Source 1 record's candidates; ``s23`` is a prepared table."""
    texts = ("norm_name", "norm_addr", "pc", "house")
    rows = strong_others(side_stats(scored, ["s1_id"], score, ["s23_id"], "s1"), "s1_id", score)
    rows = best_other(rows, score)
    rows = rows.join(s23.select(F.col("entity_id").alias("s23_id"), *texts), "s23_id", "left")
    rows = rows.join(s23.select(F.col("entity_id").alias("other_id"), *[F.col(c).alias(f"o_{c}") for c in texts]), "other_id", "left")
    has = F.col("other_id").isNotNull()
    known = lambda c: has & (F.col(c) != "") & (F.col(f"o_{c}") != "")
    rows = rows.withColumns({"_n": similarity(F.col("norm_name"), F.col("o_norm_name"), "tset"), "_a": similarity(F.col("norm_addr"), F.col("o_norm_addr"), "tset")})
    rows = rows.withColumns(
        {
            "g_top_name_tset": F.when(has, F.col("_n.tset")),
            "g_top_addr_tset": F.when(has, F.col("_a.tset")),
            "g_top_addr_eq": F.when(has, ((F.col("norm_addr") == F.col("o_norm_addr")) & (F.col("norm_addr") != "")).cast("double")),
            "g_top_pc_eq": F.when(known("pc"), (F.col("pc") == F.col("o_pc")).cast("double")),
            "g_top_house_eq": F.when(known("house"), (F.col("house") == F.col("o_house")).cast("double")),
        }
    )
    rows = same_address_support(rows, score)
    return rows.drop("other_id", "_n", "_a", *texts, *[f"o_{c}" for c in texts])


def s23_side(scored: DataFrame, score: str) -> DataFrame:
    """The competition of Source 1 records for the same Source 2/3 record; needs all its candidates."""
    return side_stats(scored, ["s23_id"], score, ["s1_id"], "s23")


def stage2(features: DataFrame, score: str, s23: DataFrame) -> DataFrame:
    """Ids and the second stage's columns: the first score, base features, both group blocks."""
    rows = s23_side(s1_side(features.select("s1_id", "s23_id", score, *BASE), score, s23), score)
    return rows.select("s1_id", "s23_id", F.col(score).alias("p1"), *BASE, *[c for c in rows.columns if c.startswith("g_")])
