"""Token counts of documents in flat, unindexed token files.

A token file is a run of fixed-width ids in which an end-of-document id closes
each document; nothing says where documents begin. Files are cut into blocks
without regard to documents. Each block is searched at once (vectorised) for the
separator and leaves the counts that lie wholly within it, the tokens before its
first and after its last separator. A prefix scan over these small rows, first
within super-blocks and then over them, stitches the documents that cross blocks.

Defined cases: a document without tokens counts 0; tokens after a file's last
separator are one more document; null data is an empty block; an empty table
gives an empty result. (file, block) must be unique and blocks in file order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .runtime import bounded, written
from .tokenizers_io import byte_bpe

BLOCK_TOKENS = 1 << 16
#: Blocks in a super-block of the prefix scan, as a power of two.
SUPER_BITS = 10
FILES_SCHEMA = "file string, block long, data binary, first long, doc_ids array<long>"


def write_token_files(docs: DataFrame, tokenizer: str, eod: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Encode ``docs`` into one flat file of 16-bit ids per task, kept as rows of blocks in the shared folder.

    Rows with ``data`` are the file; rows with ``doc_ids`` say which documents it holds, in order.
    """

    def run(batches):
        model = byte_bpe(tokenizer)
        file = f"part-{TaskContext.get().partitionId():06d}"
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
        names = [f.split()[0] for f in FILES_SCHEMA.split(", ")]
        row = lambda *x: pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(x, kinds, strict=True)], names=names)
        rest, block, first, width = b"", 0, 0, 2 * block_tokens
        for batch in K.small_batches(batches, "text", 2 << 20, "bytes"):
            parts = [rest]
            for text in K.column(batch, "text"):
                parts.append(np.array([*(model.encode_ordinary(text) if text else ()), eod], "<u2").tobytes())
            data = b"".join(parts)
            for at in range(0, len(data) - width + 1, width):
                yield row(file, block, data[at : at + width], None, None)
                block += 1
            rest = data[len(data) // width * width :]
            if batch.num_rows:
                yield row(file, None, None, first, K.column(batch, "doc_id"))
                first += batch.num_rows
        if rest:
            yield row(file, block, rest, None, None)

    return written(bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, FILES_SCHEMA), "tokens", "zstd")


#: Files from this size on are read in ranges: Spark's reader of binary files takes a file as one value.
RANGE_BYTES = 1 << 28


def read_token_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Blocks of flat files, in order.

    Files of up to ``range_bytes`` are read by Spark from any store that it reads. Longer ones are dealt to tasks in ranges of
    whole blocks, which read them where pyarrow's file systems reach the store (local, HDFS, S3, GCS).
    """
    size, schema = width * block_tokens, "file string, block long, data binary"
    per = max(1, range_bytes // size)  # blocks in a range

    def row(file, block, data):
        return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([data], pa.binary())], names=["file", "block", "data"])

    def whole(batches):
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = data.as_buffer() if data.is_valid else b""
                for block, at in enumerate(range(0, len(raw), size)):
                    yield row(file, block, bytes(raw[at : at + size]))

    def ranges(batches):
        from pyarrow import fs

        for batch in batches:
            for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, where = fs.FileSystem.from_uri(file if "//" in file else file.replace("file:", "file://", 1))
                with store.open_input_file(where) as f:
                    f.seek(first * size)
                    for block in range(first, first + per):
                        data = f.read(size)
                        if not data:
                            break
                        yield row(file, block, data)

    files = spark.read.format("binaryFile").load(path)
    small = files.filter(F.col("length") <= range_bytes).select("path", "content").mapInArrow(whole, schema)
    blocks = F.ceil(F.col("length") / F.lit(size)).cast("long")
    large = files.filter(F.col("length") > range_bytes).select("path", F.explode(F.sequence(F.lit(0).cast("long"), blocks - F.lit(1), F.lit(per).cast("long"))).alias("first"))
    return small.unionByName(large.repartition("path", "first").mapInArrow(ranges, schema))


def scan_blocks(blocks: DataFrame, eod: int, width: int = 2) -> DataFrame:
    """One row per block: its tokens, separators, the place after its last separator, and the counts closed in it."""
    kind = {1: "u1", 2: "<u2", 4: "<u4"}[width]

    def run(batches):
        for batch in batches:
            tokens, seps, last, closed = [], [], [], []
            for data in K.column(batch, "data"):
                ids = np.frombuffer(data or b"", kind)
                at = np.flatnonzero(ids == eod)
                tokens.append(ids.size)
                seps.append(at.size)
                last.append(int(at[-1]) + 1 if at.size else None)
                closed.append(np.diff(at, prepend=-1) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(seps, pa.int64()), pa.array(last, pa.int64()), pa.array(closed, pa.list_(pa.int64()))], names=["file", "block", "tokens", "seps", "last", "closed"])

    return blocks.select("file", F.col("block").cast("long").alias("block"), "data").mapInArrow(run, "file string, block long, tokens long, seps long, last long, closed array<long>")


def count_tokens(blocks: DataFrame, eod: int, width: int = 2) -> DataFrame:
    """(file, ordinal, n_tokens) of each document of each file; the separator is not counted."""
    s = written(scan_blocks(blocks, eod, width).withColumn("part", F.shiftright("block", SUPER_BITS)), "blocks")
    before = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    s = s.withColumn("start", zero(F.sum("tokens").over(before))).withColumn("seps_before", zero(F.sum("seps").over(before)))
    s = s.withColumn("end", F.col("start") + F.col("last")).withColumn("end_before", F.max("end").over(before))
    parts = s.groupBy("file", "part").agg(F.sum("tokens").alias("p_tokens"), F.sum("seps").alias("p_seps"), F.max("end").alias("p_end"))
    over = Window.partitionBy("file").orderBy("part")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("p_start", zero(F.sum("p_tokens").over(earlier))).withColumn("p_seps_before", zero(F.sum("p_seps").over(earlier)))
    parts = parts.withColumn("p_abs", F.col("p_start") + F.col("p_end")).withColumn("p_last", zero(F.max("p_abs").over(earlier)))
    closed = (
        s.filter("seps > 0")
        .join(parts.select("file", "part", "p_start", "p_seps_before", "p_last"), ["file", "part"])
        .withColumn("carry", F.col("p_start") + F.col("start") - F.coalesce(F.col("p_start") + F.col("end_before"), F.col("p_last")))
        .select("file", "carry", (F.col("p_seps_before") + F.col("seps_before")).alias("base"), F.posexplode("closed").alias("pos", "n"))
        .select("file", (F.col("base") + F.col("pos")).alias("ordinal"), (F.col("n") + F.when(F.col("pos") == 0, F.col("carry")).otherwise(F.lit(0))).alias("n_tokens"))
    )
    ends = parts.groupBy("file").agg(F.max(F.col("p_start") + F.col("p_tokens")).alias("total"), F.sum("p_seps").alias("ordinal"), zero(F.max("p_abs")).alias("last"))
    return closed.unionByName(ends.filter("total > last").select("file", "ordinal", (F.col("total") - F.col("last")).alias("n_tokens")))


def document_token_counts(docs: DataFrame, tokenizer: str, eod: int) -> DataFrame:
    """(doc_id, n_tokens) by writing ``docs`` to flat token files and scanning those."""
    files = write_token_files(docs, tokenizer, eod)
    counts = count_tokens(files.filter("data is not null").select("file", "block", "data"), eod)
    ids = files.filter("doc_ids is not null").select("file", "first", F.posexplode("doc_ids").alias("pos", "doc_id")).select("file", (F.col("first") + F.col("pos")).alias("ordinal"), "doc_id")
    return ids.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
