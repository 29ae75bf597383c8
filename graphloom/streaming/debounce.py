"""Quiet periods: a change is acted on once nothing has changed for a while; as a batch, and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "3 seconds") -> DataFrame:
    """(key, session, start, end, events): runs of events less than ``gap`` apart; a run's end plus gap is when it fires."""
    order = Window.partitionBy(key).orderBy(ts)
    fresh = (F.col(ts) >= F.lag(ts).over(order) + F.expr(f"INTERVAL {gap}")).cast("int")
    numbered = events.withColumn("session", F.sum(F.coalesce(fresh, F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("events"))


def stream_sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "3 seconds", late: str = "10 minutes") -> DataFrame:
    """The same on a stream: event-time session windows that are given out when the watermark passes their end."""
    windows = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events"), F.max(ts).alias("end"))
    return windows.select(key, F.col("w.start").alias("start"), "end", F.col("w.end").alias("fires_at"), "events")


def poll(spark, path: str, schema, every: str = "4 seconds") -> tuple[DataFrame, dict[str, str]]:
    """(stream, trigger): new files of a folder, looked for at an interval."""
    return spark.readStream.schema(schema).parquet(path), {"processingTime": every}
