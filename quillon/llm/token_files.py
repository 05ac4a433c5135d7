"""Token ids in Parquet list columns, in ascending doc_id order, with selective reads.

Files have dictionary-coded token pages, delta-coded metadata (format version 2), row groups
and pages of a set size, and the page indexes that go with them: a reader of a few documents
or of metadata alone skips the token pages of the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.spark_util import Scratch, documents, parts_for
from quillon.llm.tokens import encoded

FILE_BYTES, ROW_GROUP_BYTES, PAGE_BYTES = 24 << 20, 16 << 20, 64 << 10
SCHEMA = "doc_id long, part int, ordinal long, n_tokens long, tokens array<int>"


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            for d, e, ids, cuts in encoded(batch.column(2), path, end):
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(d, e - d), batch.column(1).slice(d, e - d), pa.array(np.arange(done, done + e - d)), pa.array(np.diff(cuts), pa.int64()), lists], names=["doc_id", "part", "ordinal", "n_tokens", "tokens"])
                done += e - d

    return run


def write_tokens(docs: DataFrame, target: str, path: str, end: int, file_bytes: int = FILE_BYTES) -> None:
    """Encodes docs and writes token files, by ranges of doc_id, in ascending order within and across files.

    Null texts count as empty; rows of one doc_id follow by text; a null doc_id comes first.
    ordinal is a row's place in its file. An empty table gives files without rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    ranged = docs.repartitionByRange(parts_for(total, file_bytes), "doc_id").sortWithinPartitions("doc_id", "text")
    ranged = ranged.select("doc_id", F.spark_partition_id().alias("part"), "text")
    (
        ranged.mapInArrow(_encode(path, end), SCHEMA)
        .write.mode("overwrite")
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.enable.dictionary", "true")
        .parquet(target)
    )


def read_tokens(spark: SparkSession, target: str, columns: list[str] | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """The token files; columns and the range of doc_id reach the Parquet reader (projection, page index)."""
    df = spark.read.schema(SCHEMA).parquet(target)
    if low is not None:
        df = df.where(F.col("doc_id") >= low)
    if high is not None:
        df = df.where(F.col("doc_id") <= high)
    return df.select(*columns) if columns else df


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(4)
        cuts = np.asarray(lists.offsets).astype(np.int64)
        data = memoryview(np.asarray(lists.values).astype("<u4").tobytes())
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(cuts), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "part", "ordinal", "n_tokens", "ids_crc32"])


def digest(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read back from token files.

    start: a running sum within each file's rows, in their order, plus the sums of the files before it."""
    rows = read_tokens(spark, target).mapInArrow(_digest, "doc_id long, part int, ordinal long, n_tokens long, ids_crc32 long")
    sums = read_tokens(spark, target, ["part", "n_tokens"]).groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = sums.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    own = Window.partitionBy("part").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("n_tokens").over(own))
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    target = f"{Scratch(spark).root}/tokens"
    write_tokens(documents(spark, sf_dir), target, public_tokenizers.path("word_bpe_49k.json"), 2)
    return digest(spark, target)
