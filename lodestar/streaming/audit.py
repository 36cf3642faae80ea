"""Streams of tool calls: audit lines, and limits that hold across batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.govern import WINDOW_SECONDS, audit_lines
from .limits import limited


def write_audit(calls: DataFrame, folder: str, checkpoint: str, patterns: list[str] | None = None, verbose: bool = False) -> StreamingQuery:
    """Appends a redacted JSON line for each call of a stream, once what is there has been read."""
    lines = audit_lines(calls, patterns, verbose)
    return lines.writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def token_buckets(calls: DataFrame, limits: dict[str, int] | None = None, seconds: int = WINDOW_SECONDS, keys: tuple[str, ...] = (), late: str = "10 minutes") -> DataFrame:
    """(call_id, tool, accepted, retry_after_ms) of a stream of (call_id, tool, timestamp): limits.limited() without a queue."""
    return limited(calls, limits, seconds, keys, late=late).select("call_id", "tool", "accepted", "retry_after_ms")


def once_each(calls: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream of calls without repeats of a call_id that come within `late` of the first; state is let go after that."""
    return calls.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["call_id"])


def sessions(calls: DataFrame, gap: str = "30 minutes", keys: tuple[str, ...] = ("caller",), late: str | None = None) -> DataFrame:
    """(keys, began, ended, calls, tools): runs of calls of a caller with pauses under `gap`; ended is the last call's time.

    Of a stream each session comes once, when the watermark (`late` behind) has passed its end
    by the gap; calls later than that are left out.
    """
    if late is not None:
        calls = calls.withWatermark("timestamp", late)
    made = calls.groupBy(*keys, F.session_window("timestamp", gap).alias("session")).agg(F.min("timestamp").alias("began"), F.max("timestamp").alias("ended"), F.count("*").alias("calls"), F.approx_count_distinct("tool").alias("tools"))
    return made.select(*keys, "began", "ended", "calls", "tools")


def rolling_counts(calls: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Calls by tool and window of a stream, with late ones counted up to the watermark."""
    return calls.withWatermark("timestamp", late).groupBy(F.window("timestamp", window), "tool").agg(F.count("*").alias("calls"))
