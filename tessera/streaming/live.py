"""Streaming forms of two plans: scenes of a live cue stream, and the newest review of each reviewer.

Extensions: a stream has no end, so a scene is closed by the watermark, and the cap on a scene's cues is left to the batch plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_scenes(cues: DataFrame, gap: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Scenes of cues (source_id, ts): runs without a pause of `gap`; rows later than `late` are dropped."""
    found = cues.withWatermark("ts", late).groupBy("source_id", F.session_window("ts", gap).alias("w"))
    return found.agg(F.count(F.lit(1)).alias("n_cues")).select("source_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n_cues")


def live_reviews(events: DataFrame) -> DataFrame:
    """The newest label of each boundary and reviewer by seq, for output mode update or complete; state is one row a key."""
    return events.groupBy("boundary_id", "reviewer_id").agg(F.max_by("label", "seq").alias("label"), F.max("seq").alias("seq"))


def gap_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each type in windows of fixed width, closed by the watermark."""
    found = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return found.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start_ts"), "event_type", "n")
