"""Incremental scoring: new files of a folder as micro-batches, each written once under its batch number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def score_new_files(
    spark: SparkSession, source: str, schema: StructType | str, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str
) -> None:
    """Applies ``transform`` to files that have come since the last call and appends the results to ``target``.

    A batch that is tried again replaces its own folder, so results come exactly once.
    """

    def sink(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number:05d}")

    query = (
        spark.readStream.schema(schema).parquet(source)
        .writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
