"""Daily counts and deduplicated decisions of a stream of review events; run to its end they equal the batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Rows of each day and action once the day can't change any more. events: ts (timestamp), action."""
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "action").agg(F.count("*").alias("n"))
    return days.select(F.to_date("window.start").alias("day"), "action", "n")


def first_decisions(events: DataFrame, within: str = "7 days") -> DataFrame:
    """The first event of each match and action that comes within a time of it; state older than that is dropped."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(["match_id", "action"])
