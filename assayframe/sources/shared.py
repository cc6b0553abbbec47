"""Tables between jobs: written once into the folder that driver and executors share, and read back."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a local session gets a folder of its own, and a cluster fails."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "assayframe-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table: later jobs read it, and so do tasks that a lost executor takes with it."""
    path = f"{folder(df.sparkSession)}/assayframe/{uuid.uuid4().hex}/{name}"
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
