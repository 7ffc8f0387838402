"""From scores to matches: assignment, thresholds, the metric, diagnostics and the output's contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def one_to_one(pairs: DataFrame, score: str) -> DataFrame:
    """Each Source 2/3 record stays with the Source 1 record that scores it highest, ties to the smaller id."""
    w = Window.partitionBy("s23_id").orderBy(F.desc(score), "s1_id")
    return pairs.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def select_matches(pairs: DataFrame, score: str, tau1: float, tau2: float, assign: bool = True) -> DataFrame:
    """A Source 1 record's best pair from tau1, others from tau2, after assignment.

    The lesser threshold is applied first: a lower pair can't win over one that would be kept.
    """
    rows = pairs.filter(F.col(score) >= min(tau1, tau2))
    rows = one_to_one(rows, score) if assign else rows
    rank = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc(score), "s23_id"))
    kept = ((F.col("_rank") == 1) & (F.col(score) >= tau1)) | ((F.col("_rank") > 1) & (F.col(score) >= tau2))
    return rows.withColumn("_rank", rank).filter(kept).drop("_rank")


def f05(tp, n_pred, n_true):
    """F0.5 of one entity; 1 if nothing is there to find and nothing was found."""
    p = F.when(n_pred > 0, tp / n_pred).otherwise(0.0)
    r = F.when(n_true > 0, tp / n_true).otherwise(0.0)
    return F.when((n_true == 0) & (n_pred == 0), 1.0).when(0.25 * p + r > 0, 1.25 * p * r / (0.25 * p + r)).otherwise(0.0)


def per_entity(matches: DataFrame, truth: DataFrame, s1: DataFrame) -> DataFrame:
    """s1_id, tp, n_pred, n_true and f05 of every id of ``s1`` (s1_id)."""
    hit = matches.select("s1_id", "s23_id").distinct().join(truth.select("s1_id", "s23_id", F.lit(1).alias("hit")), ["s1_id", "s23_id"], "left")
    pred = hit.groupBy("s1_id").agg(F.count("hit").alias("tp"), F.count("*").alias("n_pred"))
    true = truth.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = s1.select("s1_id").join(pred, "s1_id", "left").join(true, "s1_id", "left").select("s1_id", zero("tp"), zero("n_pred"), zero("n_true"))
    return rows.withColumn("f05", f05(F.col("tp"), F.col("n_pred"), F.col("n_true")))


def macro_f05(matches: DataFrame, truth: DataFrame, s1: DataFrame) -> DataFrame:
    """One row: the mean F0.5 over all of ``s1``, and how many they are."""
    return per_entity(matches, truth, s1).agg(F.avg("f05").alias("macro_f05"), F.count("*").alias("entities"))


def grid(spark: SparkSession, first=(20, 80, 5), second=(30, 95, 5)) -> DataFrame:
    """(t1, t2) in hundredths, t2 >= t1."""
    points = [(a, b) for a in range(first[0], first[1] + 1, first[2]) for b in range(second[0], second[1] + 1, second[2]) if b >= a]
    return spark.createDataFrame(points, "t1 int, t2 int")


def tune_thresholds(pairs: DataFrame, score: str, s1: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """macro_f05 of every grid point, best first (then the least thresholds), in one pass.

    ``pairs``: s1_id, s23_id, the score, y (0 or 1). ``s1``: s1_id, n_true. Assignment does not depend on the
    thresholds. Each entity's winners become counts above each second threshold, so a group's size doesn't matter;
    an entity makes a row for each second threshold, and one aggregate takes the means for all first ones.
    """
    points = points if points is not None else grid(pairs.sparkSession)
    listed = [(r.t1, r.t2) for r in points.collect()]
    seconds = sorted({b for _, b in listed})
    won = one_to_one(pairs, score).withColumns({"h": F.floor(F.round(F.col(score) * 100, 6)).cast("int"), "y": F.col("y").cast("long")})
    count = lambda t, of: F.sum(F.when(F.col("h") >= t, of).otherwise(F.lit(0)))
    best = F.min_by(F.struct("h", "y"), F.struct(-F.col(score), "s23_id")).alias("best")
    entity = won.groupBy("s1_id").agg(*[count(t, F.lit(1)).alias(f"n{t}") for t in seconds], *[count(t, F.col("y")).alias(f"y{t}") for t in seconds], best)
    rows = s1.select("s1_id", "n_true").join(entity, "s1_id", "left").withColumns({"top": F.col("best.h"), "top_y": F.coalesce("best.y", F.lit(0))})
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("t2"), F.col(f"n{t}").alias("n"), F.col(f"y{t}").alias("y")) for t in seconds])).alias("at")
    spread = rows.select("n_true", "top", "top_y", each).select("n_true", "top", "top_y", "at.*")
    # the best pair counts from t1 on even if it lies below t2
    lone = F.when(F.col("top") < F.col("t2"), 1).otherwise(0)
    found = f05(F.col("y") + lone * F.col("top_y"), F.col("n") + lone, F.col("n_true"))
    spread = spread.select("t2", "top", found.alias("found"), f05(F.lit(0), F.lit(0), F.col("n_true")).alias("nothing"))
    mean = lambda t1: F.avg(F.when(F.col("top") >= t1, F.col("found")).otherwise(F.col("nothing")))
    firsts = sorted({a for a, _ in listed})
    means = spread.groupBy("t2").agg(*[mean(t).alias(f"m{t}") for t in firsts])
    points_ = F.explode(F.array(*[F.struct(F.lit(t).alias("t1"), F.col(f"m{t}").alias("macro_f05")) for t in firsts])).alias("g")
    wanted = [a * 1000 + b for a, b in listed]
    return means.select("t2", points_).select("g.t1", "t2", "g.macro_f05").filter((F.col("t1") * 1000 + F.col("t2")).isin(*wanted)).orderBy(F.desc(F.round("macro_f05", 12)), "t1", "t2")


def id_lists(matches: DataFrame, s1: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """One row per Source 1 record: its ids, distinct, sorted, comma-joined, "" if none."""
    lists = matches.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("s23_id")), ",").alias(column))
    return s1.select("s1_id").join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(column, F.lit("")).alias(column))


def diagnostics(truth: DataFrame, s1: DataFrame, s23: DataFrame) -> DataFrame:
    """(stat, label, value): sizes, singleton shares overall and by country, matches per record, and what is wrong with a truth."""
    n = s1.select(F.col("entity_id").alias("s1_id"), "country").join(truth.groupBy("s1_id").agg(F.count("*").alias("n")), "s1_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    row = lambda df, stat, value, label=F.lit(""): df.select(F.lit(stat).alias("stat"), label.cast("string").alias("label"), F.round(value.cast("double"), 6).alias("value"))
    alone = F.avg((F.col("n") == 0).cast("double"))
    by_country = n.rollup("country").agg(alone.alias("v"), F.grouping("country").alias("all"))
    c1, c23 = s1.select(F.col("entity_id").alias("s1_id"), F.col("country").alias("c1")), s23.select(F.col("entity_id").alias("s23_id"), F.col("country").alias("c23"))
    both = truth.join(c1, "s1_id", "left").join(c23, "s23_id", "left")
    claims = truth.groupBy("s23_id").agg(F.count("*").alias("n"))
    parts = [
        row(s1.agg(F.count("*").alias("v")), "s1_total", F.col("v")),
        row(s23.agg(F.count("*").alias("v")), "s23_total", F.col("v")),
        row(by_country.filter("all = 1"), "singleton_share", F.col("v")),
        row(by_country.filter("all = 0"), "singleton_share_by_country", F.col("v"), F.col("country")),
        row(n.groupBy("n").agg(F.count("*").alias("v")), "matches_per_s1", F.col("v"), F.col("n")),
        row(claims.agg(F.count(F.when(F.col("n") > 1, 1)).alias("v")), "s23_claimed_by_more_than_one_s1", F.col("v")),
        row(both.agg(F.count(F.when(~F.coalesce(F.col("c1") == F.col("c23"), F.lit(False)), 1)).alias("v")), "cross_country_true_pairs", F.col("v")),
        row(both.agg(F.count(F.when(F.col("c23").isNull(), 1)).alias("v")), "gt_ids_missing_from_sources", F.col("v")),
        row(s23.select(F.col("entity_id").alias("s23_id")).join(claims, "s23_id", "left").agg(F.avg(F.col("n").isNull().cast("double")).alias("v")), "s23_never_matched_share", F.col("v")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


FINDINGS = "duplicate_row repeated_id self_match wrong_prefix unknown_id missing_s1 extra_s1".split()


def findings(lists: DataFrame, required: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """(finding, offenders, examples): what breaks the contract of an id-list table.

    ``lists``: source1_entity_id and a comma list; ``required``: s1_id; ``valid``: s23_id. Examples are the first five in order.
    """
    key, column = lists.columns[:2]
    rows = lists.select(F.col(key).alias("s1_id"), F.coalesce(F.col(column), F.lit("")).alias("list"))
    seen = rows.select("s1_id").distinct()
    ids = rows.filter(F.trim("list") != "").select("s1_id", F.explode(F.split("list", ",")).alias("id"))
    once = ids.select("id").distinct()
    tagged = lambda df, name, c: df.select(F.lit(name).alias("finding"), F.col(c).alias("offender")).distinct()
    real = F.col("id").rlike("^S[23]-")
    parts = [
        tagged(rows.groupBy("s1_id").count().filter("count > 1"), "duplicate_row", "s1_id"),
        tagged(ids.groupBy("s1_id", "id").count().filter("count > 1"), "repeated_id", "s1_id"),
        tagged(once.filter(F.col("id").startswith("S1-")), "self_match", "id"),
        tagged(once.filter(~real & ~F.col("id").startswith("S1-")), "wrong_prefix", "id"),
        tagged(required.join(seen, "s1_id", "left_anti"), "missing_s1", "s1_id"),
        tagged(seen.join(required, "s1_id", "left_anti"), "extra_s1", "s1_id"),
    ]
    if valid is not None:
        parts.append(tagged(once.filter(real).join(valid.select(F.col("s23_id").alias("id")), "id", "left_anti"), "unknown_id", "id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    ranked = out.withColumn("_r", F.row_number().over(Window.partitionBy("finding").orderBy("offender")))
    return ranked.groupBy("finding").agg(F.count("*").alias("offenders"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_r") <= 5, F.col("offender")))), ", ").alias("examples"))


def outside_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matched pairs that were never candidates (a warning, no error)."""
    return matches.select("s1_id", "s23_id").join(candidates, ["s1_id", "s23_id"], "left_anti")


def split(ids: DataFrame, key: str, seed: str = "0", fit: float = 0.6, tune: float = 0.2) -> DataFrame:
    """``part`` 0, 1 or 2 (fit, tune, test) from a hash of the id: stable, and no global sort."""
    u = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return ids.withColumn("part", F.when(u < fit, 0).when(u < fit + tune, 1).otherwise(2))


def fold(key, folds: int):
    """The fold of an id, from the same portable hash."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % folds
