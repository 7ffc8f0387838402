"""Two-stage gradient-boosted scoring with Spark ML; the second stage sees out-of-fold first scores."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import staged
from . import groups, policy
from .pairs import FEATURES

#: Trees take no nulls: missing evidence is this value, below any feature.
MISSING = -1.0


def assembled(df: DataFrame, columns) -> DataFrame:
    filled = df.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(MISSING)).alias(f"_{c}") for c in columns])
    return VectorAssembler(inputCols=[f"_{c}" for c in columns], outputCol="features").transform(filled).drop(*[f"_{c}" for c in columns])


def fit(df: DataFrame, columns, tune: str | None = None, **options) -> GBTClassificationModel:
    """Boosted trees on ``columns`` against ``y``; ``tune`` names a boolean column of the early-stopping rows."""
    gbt = GBTClassifier(labelCol="y", featuresCol="features", **({"maxIter": 40, "maxDepth": 5, "stepSize": 0.15, "seed": 42} | options))
    if tune:
        gbt = gbt.setValidationIndicatorCol(tune)
    return gbt.fit(assembled(df, columns))


def score(model: GBTClassificationModel, df: DataFrame, columns, name: str) -> DataFrame:
    out = model.transform(assembled(df, columns))
    return out.withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


class TwoStage:
    """Both models, the thresholds, and what tuning and the held-out part gave."""

    def __init__(self, first, second, tau1: float, tau2: float, report: dict[str, float]):
        self.first, self.second, self.tau1, self.tau2, self.report = first, second, tau1, tau2, report

    def importance(self) -> list[tuple[str, float]]:
        gains = self.second.featureImportances.toArray()
        return sorted(zip(STAGE2, map(float, gains), strict=True), key=lambda x: -x[1])

    def predict(self, features: DataFrame, s23: DataFrame) -> DataFrame:
        """s1_id, s23_id, p1 and score of all candidates: score, windows, score; the first scores are written between."""
        first = score(self.first, features, FEATURES, "p1")
        return score(self.second, groups.stage2(staged(first, "first"), "p1", s23), STAGE2, "score").select("s1_id", "s23_id", "p1", "score")

    def matches(self, features: DataFrame, s23: DataFrame) -> DataFrame:
        return policy.select_matches(self.predict(features, s23), "score", self.tau1, self.tau2)


_GROUP = (
    "g_rank_s1 g_n_s1 g_margin_s1 g_best_other_s1 g_n_ge50_s1 g_n_ge90_s1 g_top_name_tset g_top_addr_tset g_top_addr_eq g_top_pc_eq g_top_house_eq g_top_p "
    "g_same_addr_n g_same_addr_max g_rank_s23 g_n_s23 g_margin_s23 g_best_other_s23"
).split()
STAGE2 = ["p1", *groups.BASE, *_GROUP]


def train_two_stage(features: DataFrame, truth: DataFrame, s1: DataFrame, s23: DataFrame, folds: int = 5, **options) -> TwoStage:
    """Fit on 60 % of Source 1, stop early and tune on 20 %, report on 20 %; all by a hash of s1_id.

    ``features`` should be a written table: it is read by each fold.
    """
    labelled = features.join(truth.select("s1_id", "s23_id", F.lit(1.0).alias("y")), ["s1_id", "s23_id"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))
    rows = policy.split(labelled, "s1_id").withColumns({"fold": policy.fold(F.col("s1_id"), folds), "tune": F.col("part") == 1})
    rows = staged(rows, "labelled")
    first = fit(rows.filter("part < 2"), FEATURES, "tune", **options)
    # out-of-fold scores for the fit part, so that the second stage sees no leaked score
    scored = score(first, rows.filter("part > 0"), FEATURES, "p1")
    for k in range(folds):
        inner = fit(rows.filter((F.col("part") == 0) & (F.col("fold") != k)), FEATURES, **(options | {"maxIter": first.getNumTrees}))
        scored = scored.unionByName(score(inner, rows.filter((F.col("part") == 0) & (F.col("fold") == k)), FEATURES, "p1"))
    scored = staged(scored, "scored")
    two = staged(groups.stage2(scored, "p1", s23).join(rows.select("s1_id", "s23_id", "y", "part", "tune"), ["s1_id", "s23_id"]), "second")
    second = fit(two.filter("part < 2"), STAGE2, "tune", **options)
    done = staged(score(second, two, STAGE2, "score"), "done")
    ids = policy.split(s1.select(F.col("entity_id").alias("s1_id")), "s1_id").join(truth.groupBy("s1_id").agg(F.count("*").alias("n_true")), "s1_id", "left").withColumn("n_true", F.coalesce("n_true", F.lit(0)))
    report = {}
    best = None
    for name, column in (("stage1", "p1"), ("two_stage", "score")):
        best = policy.tune_thresholds(done.filter("part = 1"), column, ids.filter("part = 1")).first()
        held = policy.select_matches(done.filter("part = 2"), column, best.t1 / 100, best.t2 / 100)
        report[name] = policy.macro_f05(held, truth, ids.filter("part = 2")).first().macro_f05
    report["tuned"] = best.macro_f05
    return TwoStage(first, second, best.t1 / 100, best.t2 / 100, report)
