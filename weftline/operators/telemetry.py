"""Telemetry rows: tails, rates, summaries and formats of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.config import DEFAULT


def last_events(events: DataFrame, n: int = DEFAULT.ring, keys: list[str] | None = None, order: str = "event_id") -> DataFrame:
    """The last n events, of each key if there are keys. Without keys it is a top-n, not a window over everything."""
    if not keys:
        return events.orderBy(F.desc(order)).limit(n)
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    return events.withColumn("i", F.row_number().over(newest)).filter(F.col("i") <= n).drop("i")


def sse(events: DataFrame, kind: str, payload: Column) -> DataFrame:
    """event_id and data: each event as one line of a server-sent stream. payload: a struct, flattened into the top level."""
    return events.select("event_id", F.concat(F.lit("data: "), F.to_json(payload), F.lit("\n\n")).alias("data"))


def hit_rate(events: DataFrame, hit: Column, key: str) -> DataFrame:
    return events.groupBy(key).agg(F.round(F.avg(hit.cast("int")) * 100, 4).alias("hit_rate"), F.count("*").alias("n"))


def trace_summary(spans: DataFrame) -> DataFrame:
    """Count, mean times (zero if empty) and the spans of the native engine."""
    mean = lambda c: F.coalesce(F.round(F.avg(c), 2), F.lit(0.0)).alias(f"avg_{c}")
    return spans.agg(F.count("*").alias("n_spans"), mean("total_ms"), mean("vector_ms"), mean("graph_ms"), F.count_if("native").alias("n_native"))


def dashboard(events: DataFrame) -> DataFrame:
    """State of each user: events, last event, last value, and counts by type."""
    kinds = ["signup", "purchase", "view", "click", "error"]
    count = lambda k: F.count_if(F.col("event_type") == k).alias(f"n_{k}")
    return events.groupBy("user_id").agg(
        F.count("*").alias("n"), F.max("event_id").alias("last_event"), F.max_by("value", "event_id").alias("last_value"), F.round(F.sum("value"), 4).alias("total"), *[count(k) for k in kinds]
    )


def sparkline(events: DataFrame, n: int = 60, key: str = "user_id") -> DataFrame:
    """The last n values of each key, scaled to 0..1."""
    tail = last_events(events, n, [key])
    own = Window.partitionBy(key)
    low, high = F.min("value").over(own), F.max("value").over(own)
    span = F.when(high > low, high - low).otherwise(F.lit(1.0))
    return tail.select(key, "event_id", F.round((F.col("value") - low) / span, 6).alias("y"))
