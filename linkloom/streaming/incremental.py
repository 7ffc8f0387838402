"""Record streams: text is normalised as it arrives; scoring stays in batches, as assignment needs all candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.prepare import Lexicon, prepare
from ..sources.records import RECORD


def record_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Tab-separated record files as they appear in a folder."""
    return spark.readStream.schema(RECORD).option("sep", "\t").option("header", True).option("quote", "").csv(folder)


def prepare_into(stream: DataFrame, table: str, checkpoint: str, lexicon: Lexicon | None = None, romanise: bool = True):
    """Start a query that appends prepared records to the Parquet folder ``table``, each batch once.

    Chain frequencies hold within a batch; recount them with ``core_frequency`` on the whole table.
    """

    def append(batch: DataFrame, number: int) -> None:
        prepare(batch, lexicon, romanise).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
