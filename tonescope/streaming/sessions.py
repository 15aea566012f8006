"""Feedback as a stream with state: repeated events dropped, sliding counts, and sessions of a user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without_repeats(events: DataFrame, keys: list[str], ts: str, late: str = "2 days") -> DataFrame:
    """One event for each key. A stream keeps keys for as long as events may be late, so a repeat that comes within that
    time is dropped, and the first that came is kept; a batch keeps the earliest, of equal ones any."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
    first = events.groupBy(*keys).agg(F.min_by(F.struct(*events.columns), ts).alias("_e"))
    return first.select("_e.*")


def sliding_counts(events: DataFrame, ts: str, kind: str, window: str = "2 days", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, kind, n) by windows that overlap; the same plan serves a stream and a batch."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, window, slide).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def sessions(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "2 days", measures: dict[str, Column] | None = None) -> DataFrame:
    """(user, session_start, session_end, n, measures...): runs of a user's events with less than ``gap`` from one to the next;
    the end is the last event's time plus the gap. A stream gives a session when the watermark has passed its end."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    found = rows.groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count("*").alias("n"), *[c.alias(n) for n, c in (measures or {}).items()])
    return found.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", *(measures or {}))
