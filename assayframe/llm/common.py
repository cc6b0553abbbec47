"""Shared helpers: staging tables in the shared folder and walking Arrow batches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import weakref

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a Python worker.
SLICE_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it on a cluster, where it is an error if it is unset; a local session gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "assayframe-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/assayframe/{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    This cuts lineage: a lost executor costs a re-read of the table, not a re-computation.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


#: Folders of the staged tables in use. A table that nothing reads any more is :func:`release`d; the last ones of a query stay
#: as long as its result can be read, and go with the shared folder.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def release(*tables: DataFrame) -> None:
    """Removes the files of staged tables that no later job reads."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Cut a batch into runs of rows whose ``column`` holds about ``limit`` bytes (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def fine_grained(df: DataFrame) -> int:
    """Shuffle partitions of the session, for operators that name a count."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


#: Tasks over which the rows of a hot key are dealt out.
SALTS = 64


def spread_join(rows: DataFrame, key: str, by: str, table: DataFrame) -> DataFrame:
    """Left join on ``key`` with a small ``table`` that has it once: the rows of a hot key are dealt out over SALTS tasks by ``by``."""
    salt = "salt"
    while salt in rows.columns or salt in table.columns:
        salt += "_"
    copies = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(copies.hint("merge"), [key, salt], "left").drop(salt)
