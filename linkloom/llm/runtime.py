"""Session helpers: the shared work folder, written stages, skew-proof look-ups."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only in local mode, where
    it is unset (as in tests), a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="linkloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


#: The tables written in the innermost ``scratch`` block that is open.
_MADE: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_path = path
    if (made := _MADE.get()) is not None:
        made.append(table)
    return table


def forget(*tables: DataFrame) -> None:
    """Delete the folders of ``written`` tables that nothing reads any more."""
    for t in tables:
        spark, path = t.sparkSession, getattr(t, "_written_path", None)
        if path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """At its end, delete the tables ``written`` inside but for those that the function it gives was called with.

    These belong to the block around it, if there is one. What leaves the block
    must be written and kept, or read nothing but kept tables.
    """
    made: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    token = _MADE.set(made)
    try:
        yield keep
    finally:
        _MADE.reset(token)
        forget(*[t for t in made if not any(t is k for k in kept)])
        if (around := _MADE.get()) is not None:
            around.extend(kept)


#: Bytes of an Arrow batch, so that a Python worker never holds many long texts at once.
BATCH_BYTES = "4m"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches bounded by bytes unless the session has a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name, "67108864b") in ("67108864b", "64m", "64MB"):
        df.sparkSession.conf.set(name, BATCH_BYTES)
    return df


def released() -> None:
    """Give freed memory of this process back, where the C library can: workers and the driver live on after a large step."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


#: A key is hot when it has this share of the rows at least, so there are at
#: most 1 / HOT_SHARE hot keys: the proven bound of what is collected and broadcast.
HOT_SHARE = 1e-3
#: A table of so few rows is joined as it is: one task can take them all.
FEW_ROWS = 4096


def skew_lookup(big: DataFrame, key: str, small: DataFrame, wide: bool = False) -> DataFrame:
    """Left join of ``big`` with ``small`` (unique in ``key``) that no hot key can skew.

    Keys with ``HOT_SHARE`` of ``big``'s rows or more number 1,000 at most, so they are
    literals of a filter that parts their rows from the others in the scan. Their
    few rows of ``small`` are broadcast, or, where rows of ``small`` are ``wide`` and so
    have no bound, dealt with ``big``'s over salts, as many as the key's rows need. All other rows go
    through a shuffled join in which no key has more than that share; without hot keys
    that is the whole join. Null keys get nulls. ``big`` is read three times and should
    be a written table.
    """
    rows = big.count()
    least = max(2, int(rows * HOT_SHARE) + 1)
    added = [c for c in small.columns if c != key]
    plain = big.join(small, key, "left").select(*big.columns, *added)
    if rows <= FEW_ROWS:
        return plain
    counts = big.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).collect()
    if not counts:
        return plain
    is_hot = F.coalesce(F.col(key).isin([r[0] for r in counts]), F.lit(False))
    few = small.filter(is_hot)
    if wide:
        salts = big.sparkSession.createDataFrame([(r[0], -(-r[1] // least)) for r in counts], StructType([big.schema[key], StructField("_hot", IntegerType())]))
        dealt = big.filter(is_hot).join(F.broadcast(salts), key).withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.col("_hot")).cast("int"))
        copies = few.join(F.broadcast(salts), key).select("*", F.explode(F.sequence(F.lit(0), F.col("_hot") - F.lit(1))).alias("_salt")).drop("_hot")
        first = dealt.join(copies, [key, "_salt"], "left")
    else:
        first = big.filter(is_hot).join(F.broadcast(few), key, "left")
    rest = big.filter(~is_hot).join(small, key, "left")
    return first.select(*big.columns, *added).unionByName(rest.select(*big.columns, *added))


def unit(col: Column) -> Column:
    """A number in [0, 1) that depends on ``col`` alone, for bounded samples."""
    return F.pmod(F.xxhash64(col), F.lit(1 << 30)) / float(1 << 30)
