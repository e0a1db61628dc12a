"""Streaming jobs over files: tumbling aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.registry import query, table
from lodestone.streaming.stateful import arrivals

#: The type of an event that only moves the watermark on.
_END = "__end__"


def _events(spark: SparkSession, sf: str) -> list[DataFrame]:
    """The events in two parts in order of time, and an end mark two days after the last."""
    own = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = own.agg(F.max("ts").alias("ts"), F.expr("percentile_approx(unix_micros(ts), 0.5)").alias("half")).first()
    if last["ts"] is None:
        return [own]
    mark = own.limit(1).select(*[(F.lit(_END) if c == "event_type" else F.lit(last["ts"]) + F.expr("INTERVAL 2 DAYS") if c == "ts" else F.lit(None)).cast(own.schema[c].dataType).alias(c) for c in own.columns])
    return [own.filter(F.unix_micros("ts") <= last["half"]), own.filter(F.coalesce(F.unix_micros("ts") > last["half"], F.lit(True))), mark]


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 4) AS mean, max(value) AS top FROM events GROUP BY 1, 2")
def stream_telemetry_tumbling(spark, sf):
    """Hourly windows in append mode: a window is written when the watermark has passed it, and its state goes. An end mark two
    days after the last event closes the windows of a finite input."""
    def hourly(events: DataFrame) -> DataFrame:
        w = events.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
        return w.agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("top"))

    found = arrivals(spark, _events(spark, sf), hourly).filter(F.col("event_type") != _END)
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "mean", "top")
