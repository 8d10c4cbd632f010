"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch; texts may be long, so batches stay far below Spark's default of 10,000 rows.
BATCH_ROWS = 1000
#: A null id is read as this value where ids are ordered, so it comes last and is never the smaller one.
LAST_ID = (1 << 63) - 1


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower (never raise) the session's rows per Arrow batch, which bounds a Python worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def small_bytes(spark: SparkSession, size: int) -> None:
    """Lower (never raise) the session's bytes per Arrow batch, where single rows are large."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("bB")) > size:
        spark.conf.set(key, str(size))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder, spark.checkpoint.dir; in local mode a folder of our own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: the result is stored once and survives lost executors."""
    shared_dir(df.sparkSession, "unused")
    return df.checkpoint()


def shuffled(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that never sends a side through the driver.

    Spark's sizes follow neither explode, Python steps nor long binaries, so it may broadcast a table many times as large as it thinks.
    """
    return left.hint("merge").join(right.hint("merge"), on, how)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, whatever else the table holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo the number of folds (null id: crc32 of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def id_list(batch: pa.RecordBatch, name: str = "doc_id") -> list[int]:
    return [LAST_ID if i is None else i for i in batch.column(batch.schema.get_field_index(name)).to_pylist()]
