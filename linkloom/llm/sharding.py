"""Sharding by jump consistent hashing, in DataFrame expressions alone.

A key's shard follows from the key and the number of shards; no ring table
exists, and one more shard takes keys only into itself. The published generator
(key' = key * 2862933555777941757 + 1 modulo 2^64; next candidate
floor((b + 1) * 2^31 / (key' >>> 33 + 1))) runs on two 32-bit halves, so that no
product overflows a signed 64-bit number whatever the ANSI setting.

Defined cases: a null key is a key of its own (the text "null" with a line feed
before it, which no number has). A null text has no bytes. Repeated rows go to
the same shard and get slots of their own. Empty tables give empty results;
other columns of the input are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the published algorithm: the multiplier's two halves.
MULTIPLIER_HIGH, MULTIPLIER_LOW = 2862933555777941757 >> 32, 2862933555777941757 & 0xFFFFFFFF
MASK = 0xFFFFFFFF
#: Candidates grow by a factor on average; the chance that a key needs more steps than this is under 1e-80 even for 2^31 shards.
MOST_STEPS = 160
#: Each shard's rows are numbered within so many sub-buckets, so that no task holds a whole shard.
SLOT_BUCKETS = 256


def key_halves(key: Column) -> tuple[Column, Column]:
    """Two unsigned 32-bit numbers from the MD5 of the key's text: a stable key for any type."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("\nnull")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")


def _times_low(x: Column, factor: int) -> Column:
    """x * factor modulo 2^32 for 32-bit numbers, without a product above 2^48."""
    return ((x.bitwiseAND(F.lit(0xFFFF)) * F.lit(factor)).bitwiseAND(F.lit(MASK)) + F.shiftleft((F.shiftright(x, 16) * F.lit(factor)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(MASK))


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """One step of the generator on the two halves."""
    p0 = low.bitwiseAND(F.lit(0xFFFF)) * F.lit(MULTIPLIER_LOW)
    p1 = F.shiftright(low, 16) * F.lit(MULTIPLIER_LOW)
    bottom = p0.bitwiseAND(F.lit(MASK)) + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    top = F.shiftright(p0, 32) + F.shiftright(p1, 16) + F.shiftright(bottom, 32) + _times_low(low, MULTIPLIER_HIGH) + _times_low(high, MULTIPLIER_LOW)
    return top.bitwiseAND(F.lit(MASK)), bottom.bitwiseAND(F.lit(MASK))


def jump_hash(high: Column, low: Column, *shards: int) -> Column:
    """Array of the shard of a 64-bit key (its two halves) for each number in ``shards``, from one run of the generator.

    The jumps for fewer shards are the first jumps for more, so a shard is the
    last candidate below its number.
    """
    most = max(shards)
    zero, start = F.lit(0).cast("long"), F.struct(high.alias("h"), low.alias("l"), F.lit(0).cast("long").alias("j"), F.array(*[F.lit(-1).cast("long")] * len(shards)).alias("b"))

    def step(acc: Column, _: Column) -> Column:
        live = acc["j"] < F.lit(most)
        h, l = _next(acc["h"], acc["l"])
        jump = F.floor((acc["j"] + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(h, 1) + F.lit(1)).cast("double"))).cast("long")
        kept = F.array(*[F.when(acc["j"] < F.lit(n), acc["j"]).otherwise(acc["b"][i]) for i, n in enumerate(shards)])
        return F.struct(F.when(live, h).otherwise(acc["h"]).alias("h"), F.when(live, l).otherwise(acc["l"]).alias("l"), F.when(live, jump).otherwise(acc["j"]).alias("j"), kept.alias("b"))

    end = F.aggregate(F.sequence(zero, F.lit(min(most, MOST_STEPS) - 1).cast("long")), start, step)
    return F.transform(F.when(end["j"] >= F.lit(most), end["b"]).otherwise(F.raise_error(F.lit("jump hash did not end"))), lambda b: b.cast("int"))


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row.

    ``slot`` numbers a shard's rows from 0 without gaps: by sub-bucket, then key,
    then checksum. Sub-buckets are counted first; their starts come from a window
    over ``shards * SLOT_BUCKETS`` counts.
    """
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    high, low = key_halves(F.col(key))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(body) + F.lit(8)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), high.alias("_h"), low.alias("_l"))
    # digests again, so that other engines can number rows alike; rows of one key with different texts part
    mixed = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("text_crc32").cast("string"))), 1, 4), 16, 10).cast("long")
    both = jump_hash(F.col("_h"), F.col("_l"), shards, shards + 1)
    rows = rows.select("doc_id", "size", "text_crc32", both.alias("_s"), F.pmod(mixed, F.lit(SLOT_BUCKETS)).cast("int").alias("_bucket"))
    rows = rows.select("doc_id", "size", "text_crc32", F.col("_s")[0].alias("shard"), F.col("_s")[1].alias("grown_shard"), "_bucket")
    inner = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size")
    rows = rows.withColumn("_row", F.row_number().over(inner) - F.lit(1))
    counts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "_bucket", F.coalesce("_start", F.lit(0)).alias("_start"))
    # at most (shards + 1) * SLOT_BUCKETS rows, whatever the table's size
    placed = rows.join(F.broadcast(starts) if shards * SLOT_BUCKETS <= 100_000 else starts, ["shard", "_bucket"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_row")).cast("long").alias("slot"), "grown_shard")
