"""Structured Streaming forms: an append-only cache kept as its latest records, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def appended(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append records exactly once; stops when what is there has been read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, time: str, every: str, late: str, *keys: str) -> DataFrame:
    """Counts and means by window and keys; records later than `late` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, every), *keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def epochs(rows: DataFrame, n: int) -> DataFrame:
    """Bounded replay: every row once in each of n epochs."""
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
