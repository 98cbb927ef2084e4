"""Scores and counts over streams: the operators of the batch side, which keep to a row, and windows with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.lexicon import Lexicon
from quillstone.operators import detector


def score_stream(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Documents of a stream or a table with probability and level. All is computed in the row, so there is no state."""
    return detector.detect(docs, lexicon).select(*docs.columns, "probability", "level")


def event_windows(events: DataFrame, length: str = "1 hour", late: str | None = None) -> DataFrame:
    """Of each window of ts and each event_type: n, users (how many differ; streams count them approximately), low and high.

    late, for streams: how far behind the newest ts a row may be; state of older windows is dropped.
    """
    if late is not None:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    users = F.approx_count_distinct("user_id") if events.isStreaming else F.countDistinct("user_id")
    out = events.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), users.alias("users"), F.min("value").alias("low"), F.max("value").alias("high"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("starts"), "event_type", "n", "users", "low", "high")
