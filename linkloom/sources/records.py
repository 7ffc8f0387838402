"""Scans and sinks of record tables: tab-separated text, quotes literal, all strings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


class ContractError(ValueError):
    """A table breaks its contract."""


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | None = None, check: bool = True) -> DataFrame:
    """One record per line with a header; nothing is parsed, an empty field is "".

    ``check`` compares the row count with the non-blank lines and asserts that the first column is unique.
    """
    reader = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("escape", "").option("mode", "FAILFAST").option("enforceSchema", False)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)
    df = df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns])
    if check:
        lines = spark.read.text(path).filter(F.trim("value") != "").count() - len(spark.read.text(path).select(F.input_file_name()).distinct().collect())
        first = df.columns[0]
        rows = df.count()
        if rows != lines:
            raise ContractError(f"{path}: {rows} rows from {lines} lines")
        if not df.groupBy(first).count().filter("count > 1").isEmpty():
            raise ContractError(f"{path}: {first} is not unique")
    return df


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A resource table; an absent one is empty."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return read_tsv(spark, path, schema, check=False)


def write_tsv(df: DataFrame, path: str) -> None:
    """One tab-separated file with a header in the folder ``path``; made for result lists, not for raw tables."""
    df.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def source_of(entity_id: Column) -> Column:
    return F.split_part(entity_id, F.lit("-"), F.lit(1))


def parsed_truth(truth: DataFrame) -> DataFrame:
    """The edges (s1_id, s23_id) of a truth table's comma lists, trimmed, without blanks or repeats."""
    ids = F.explode(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","))
    return truth.select(F.col("source1_entity_id").alias("s1_id"), ids.alias("id")).select("s1_id", F.trim("id").alias("s23_id")).filter("s23_id <> ''").distinct()


def in_regions(country: Column, address: Column, regions: Iterable[tuple[str, str]]) -> Column:
    """Whether a record lies in one of (country, pattern of the address, any case)."""
    out = F.lit(False)
    for label, pattern in regions:
        out = out | ((country == label) & F.coalesce(address, F.lit("")).rlike("(?i)" + pattern))
    return out


def region_sample(s1: DataFrame, s23: DataFrame, truth: DataFrame, regions: Iterable[tuple[str, str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Source 1 in the regions, its truth, and records of the others that lie there or that the truth needs."""
    regions = list(regions)
    here = in_regions(F.col("country"), F.col("business_address"), regions)
    own = s1.filter(here)
    kept = truth.join(own.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")
    needed = kept.select(F.col("s23_id").alias("entity_id")).distinct().withColumn("needed", F.lit(True))
    others = s23.join(needed, "entity_id", "left").filter(here | F.col("needed").isNotNull()).drop("needed").dropDuplicates(["entity_id"])
    return own, others, kept


def systematic_sample(df: DataFrame, key: str, every: int, offset: int = 0) -> DataFrame:
    """Every n-th row in the order of ``key``, numbered without gaps by parts, so that no task sorts the table."""
    ranked = df.repartitionByRange(key).withColumn("_part", F.spark_partition_id())
    counts = ranked.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_start")
    # one row per partition
    numbered = ranked.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1).join(F.broadcast(starts), "_part")
    return numbered.filter((F.col("_start") + F.col("_row")) % every == offset).drop("_part", "_row", "_start")
