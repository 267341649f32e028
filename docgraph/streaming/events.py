"""The same operators over streams, with event time."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema: Any, ts: str = "ts", **options: str) -> DataFrame:
    """New Parquet files of a folder as a stream, with the time column as an instant."""
    return spark.readStream.schema(schema).options(**options).parquet(folder).withColumn(ts, F.col(ts).cast("timestamp"))


def windowed(df: DataFrame, keys: list[str], value: str, ts: str = "ts", window: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(keys, window_start, window_end, n, total): tumbling or sliding windows; what comes later than ``late`` is dropped."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    out = df.withWatermark(ts, late).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total"))
    return out.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "total")


def sessions(df: DataFrame, keys: list[str], ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(keys, session_start, session_end, n): stretches without a gap."""
    out = df.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def deduplicated(df: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first of each key within the watermark."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def write_parquet(df: DataFrame, folder: str, checkpoint: str, once: bool = True) -> Any:
    """Appends to a folder exactly once; with ``once`` it takes what is there and ends."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
