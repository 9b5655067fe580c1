"""Structured Streaming over the ledger: an extension, as the ledger is append-only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    """New ledger files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def counts(events: DataFrame, time: str = "created_at", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows of each action by window; rows later than `late` no longer count, so the state is bounded."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "action").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("actor").alias("actors")).select(F.col("w.start").alias("start"), "action", "n", "actors")


def first_seen(events: DataFrame, key: str = "id", time: str = "created_at", late: str = "2 hours") -> DataFrame:
    """Each row once, even if it is delivered again within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
