"""Record tables from other tables, to try the engine on: noisy copies of ``part``, copies among ``documents``, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTRIES = ("US", "India", "France")
STREETS = ("Main Road", "Lake Avenue", "Park Street", "rue de Lille")


def _pick(values, c: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (c % len(values) + 1).cast("int"))


def part_records(part: DataFrame) -> DataFrame:
    """Source 1: one record per part. Sources 2 and 3: a corrupted copy of each, the kind of damage by key modulo 5."""
    k = F.col("p_partkey")
    name = F.concat_ws(" ", "p_name", F.replace("p_brand", F.lit("#"), F.lit(" ")), F.lower("p_type"), F.lit("Company Ltd"))
    address = F.concat(k.cast("string"), F.lit(" "), _pick(STREETS, k), F.lit(", "), F.lit("Unit "), F.col("p_size").cast("string"), F.lit(", "), (F.lit(10000) + k).cast("string"))
    country = _pick(COUNTRIES, k)
    first = F.substring_index("p_name", " ", 1)
    damaged = (
        F.when(k % 5 == 0, F.concat_ws(" ", F.substring_index("p_name", " ", -1), F.replace("p_brand", F.lit("#"), F.lit(" ")), F.lower("p_type")))
        .when(k % 5 == 1, F.concat_ws(" ", F.replace("p_brand", F.lit("#"), F.lit(" ")), "p_name", F.lower("p_type"), F.lit("Co Limited")))
        .when(k % 5 == 2, F.concat_ws(" ", F.substring(first, 1, 3), F.substring_index("p_name", " ", -1), F.replace("p_brand", F.lit("#"), F.lit(" ")), F.lit("Cie")))
        .when(k % 5 == 3, F.replace(F.replace(name, F.lit("o"), F.lit("0")), F.lit("l"), F.lit("1")))
        .otherwise(F.concat(name, F.lit(" dba "), F.initcap(first), F.lit(" Traders")))
    )
    moved = F.when(k % 7 == 0, F.lit("")).when(k % 3 == 0, F.concat(k.cast("string"), F.lit(" "), _pick(STREETS, k), F.lit(", near City Mall"))).otherwise(address)
    one = part.select(F.concat(F.lit("S1-"), k.cast("string")).alias("entity_id"), name.alias("business_name"), address.alias("business_address"), country.alias("country"))
    two = part.select(F.concat(F.when(k % 2 == 0, "S2-").otherwise("S3-"), k.cast("string")).alias("entity_id"), damaged.alias("business_name"), moved.alias("business_address"), F.upper(country).alias("country"))
    return one.unionByName(two)


def part_truth(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return part.select(F.concat(F.lit("S1-"), k.cast("string")).alias("s1_id"), F.concat(F.when(k % 2 == 0, "S2-").otherwise("S3-"), k.cast("string")).alias("s23_id"))


def document_records(documents: DataFrame) -> DataFrame:
    """Source 1: the first document of each text. Sources 2 (even) and 3 (odd): its other copies. Name: the words of its text."""
    text = F.coalesce("text", F.lit(""))
    firsts = documents.groupBy(F.md5(text).alias("h")).agg(F.min("doc_id").alias("first"))
    rows = documents.withColumn("h", F.md5(text)).join(firsts, "h")
    source = F.when(F.col("doc_id") == F.col("first"), "S1-").when(F.col("doc_id") % 2 == 0, "S2-").otherwise("S3-")
    return rows.select(
        F.concat(source, F.col("doc_id").cast("string")).alias("entity_id"),
        F.trim(F.regexp_replace(text, r"\s+", " ")).alias("business_name"),
        F.col("source").alias("business_address"),
        F.upper("lang").alias("country"),
        F.when(F.col("doc_id") != F.col("first"), F.concat(F.lit("S1-"), F.col("first").cast("string"))).alias("true_s1_id"),
    )


def page_records(pages: DataFrame) -> DataFrame:
    """Name: the title; address: the URL; country: the lang attribute."""
    return pages.select(
        F.concat(F.lit("S1-"), F.col("page_id").cast("string")).alias("entity_id"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("business_name"),
        F.col("url").alias("business_address"),
        F.upper(F.regexp_extract("html", '<html[^>]*lang="([a-z]+)"', 1)).alias("country"),
    )
