"""The batch functions over streams: new files are parsed once, facts merged as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import last_by


def facts_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of fact rows from Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def merged_once(facts: DataFrame, out: str, checkpoint: str, key: list[str], apply: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
    """All that is new, appended as versions (``batch``); a batch that is replayed overwrites its own version."""

    def write(batch: DataFrame, number: int) -> None:
        apply(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}_")

    facts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, out: str, key: list[str]) -> DataFrame:
    """The last version of every key."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(out)
    return last_by(rows, key, "batch").drop("batch")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event type in windows of event time; the watermark bounds the state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
