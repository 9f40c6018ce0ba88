"""Restartable work: files are taken up as they come, and keys that are done are skipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import append_new


def run_available(spark: SparkSession, source: str, target: str, checkpoint: str, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> None:
    """Applies ``work`` to the parquet files under ``source`` that no earlier run took, and appends rows of new keys.

    A batch that is run again after a failure takes its own place."""
    schema = spark.read.parquet(source).schema

    def take(batch: DataFrame, number: int) -> None:
        append_new(work(batch), target, keys, number)

    spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
