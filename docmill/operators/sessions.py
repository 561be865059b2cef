"""Session expiry and slow requests, over stored events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDLE_SECONDS = 3600
SLOW_MS = 500.0
# Request paths that are not timed.
UNTIMED_PATHS = ["/health", "/favicon.ico", "/docs", "/redoc", "/openapi.json"]


def sessions(
    events: DataFrame, key: str, ts: str = "ts", idle_seconds: int = IDLE_SECONDS
) -> DataFrame:
    """Sessions per key, ended by ``idle_seconds`` without an event: start, last event, events.

    Events of one key inside one idle-long stretch of the clock belong together, so they are
    merged first (map-side too). The window then reads one row per key and stretch, a number
    bounded by the time covered and not by the events.
    """
    stretch = F.floor(F.unix_micros(ts) / F.lit(idle_seconds * 1_000_000))
    merged = events.groupBy(key, stretch.alias("_s")).agg(
        F.min(ts).alias("_from"), F.max(ts).alias("_to"), F.count(F.lit(1)).alias("_n")
    )
    w = Window.partitionBy(key).orderBy("_s")
    idle = F.unix_micros("_from") - F.unix_micros(F.lag("_to").over(w))
    is_new = F.when(idle < idle_seconds * 1_000_000, 0).otherwise(1)
    numbered = merged.withColumn("_new", is_new).withColumn(
        "session_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    return numbered.groupBy(key, "session_no").agg(
        F.min("_from").alias("session_start"),
        F.max("_to").alias("last_event"),
        F.sum("_n").alias("events"),
    )


def expired(rows: DataFrame, now: Column, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Sessions of ``sessions`` that have been idle too long at ``now``."""
    return rows.where(
        F.unix_micros(now) - F.unix_micros("last_event") >= idle_seconds * 1_000_000
    )


def slow_requests(
    requests: DataFrame,
    threshold_ms: float = SLOW_MS,
    untimed: list[str] | None = None,
    path: str = "path",
    latency: str = "latency_ms",
) -> DataFrame:
    """Timed requests above the threshold. Stateless: works on tables and streams."""
    timed = F.lit(True)
    for prefix in UNTIMED_PATHS if untimed is None else untimed:
        timed = timed & ~F.startswith(F.col(path), F.lit(prefix))
    return requests.where(timed & (F.col(latency) > threshold_ms))
