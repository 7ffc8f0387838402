"""The end-to-end plan: records in, match lists out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..operators import blocking, model, pairs, policy
from ..operators.prepare import Lexicon, prepare
from ..sources import records as R
from ..sources.stage import staged


def sides(prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Source 1, and Sources 2 and 3, of a table of records."""
    one = R.source_of(prepared["entity_id"]) == "S1"
    return prepared.filter(one), prepared.filter(~one)


def candidates_and_features(s1: DataFrame, s23: DataFrame, lexicon: Lexicon | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs and their features of prepared tables, which should be staged."""
    found = staged(blocking.candidates(s1, s23, **options), "candidates")
    return found, pairs.pair_features(found, s1, s23, lexicon)


def train(spark: SparkSession, s1: DataFrame, s23: DataFrame, truth: DataFrame, lexicon: Lexicon | None = None, **options) -> tuple[model.TwoStage, dict[str, float]]:
    """Models and thresholds from raw records and true pairs (s1_id, s23_id), and what blocking and tuning reached."""
    a, b = staged(prepare(s1, lexicon), "s1"), staged(prepare(s23, lexicon), "s23")
    found, features = candidates_and_features(a, b, lexicon, **options)
    features = staged(features, "features")
    fitted = model.train_two_stage(features, truth, a, b)
    return fitted, fitted.report | {"recall": blocking.recall(found, truth).first().recall}


def link(fitted: model.TwoStage, s1: DataFrame, s23: DataFrame, lexicon: Lexicon | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """The match lists and the candidate lists of raw records: one row per Source 1 record each."""
    a, b = staged(prepare(s1, lexicon), "s1"), staged(prepare(s23, lexicon), "s23")
    found, features = candidates_and_features(a, b, lexicon, **options)
    ids = a.selectExpr("entity_id AS s1_id")
    return policy.id_lists(fitted.matches(features, b), ids), policy.id_lists(found, ids, "candidate_entity_ids")


def write(matches: DataFrame, candidates: DataFrame, metrics: dict[str, float], folder: str) -> None:
    """Two result tables and the metrics, each a folder with one file."""
    R.write_tsv(matches, f"{folder}/matching_results")
    R.write_tsv(candidates, f"{folder}/candidate_pairs")
    spark = matches.sparkSession
    spark.createDataFrame([(json.dumps(metrics),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metrics")
