"""Footage and drives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def footage_summary(footage: DataFrame) -> DataFrame:
    """Segments, bytes, first mime type, start and end of each drive; a missing start falls back to the end."""
    start = F.when(F.col("recording_started_at_ms").isNotNull() & ~F.isnan(F.col("recording_started_at_ms").cast("double")), F.col("recording_started_at_ms") / 1000).otherwise(F.col("at"))
    told = footage.withColumn("start_s", F.nullif(start, F.lit(0.0))).withColumn("end_s", F.coalesce(F.nullif(F.col("at"), F.lit(0.0)), F.col("start_s")))
    return told.groupBy("drive_id").agg(
        F.count("*").alias("segments"), F.sum("bytes").alias("bytes"), F.min_by("mime", F.struct("seq", "key")).alias("mime"), F.min("start_s").alias("started_at"), F.max("end_s").alias("ended_at")
    )


def sessions_with_footage(sessions: DataFrame, footage: DataFrame) -> DataFrame:
    """Sessions, newest first by id order left to the reader, with their footage or zeros."""
    totals = footage.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("clips"), F.sum("bytes").alias("bytes"), F.sum("duration_s").alias("duration_s"))
    return sessions.join(totals, "id", "left").na.fill(0, ["clips", "bytes"]).na.fill(0.0, ["duration_s"])


def merge_analysis(drives: DataFrame, analyses: DataFrame) -> DataFrame:
    """Drives after an analysis: repeat ids united in order, the repeat count never below their number."""
    new = analyses.select(F.col("id").alias("_id"), F.col("already_ids").alias("_ids"), "checked_now", "found_now", "already_now")
    none = F.array().cast("array<string>")
    ids = F.array_distinct(F.transform(F.concat(F.coalesce("already_ids", none), F.coalesce("_ids", none)), lambda x: F.substring(x, 1, 64)))
    joined = drives.join(new, F.col("id") == F.col("_id"), "left").withColumn("already_ids", ids)
    low = lambda c: F.greatest(F.lit(0), F.coalesce(F.col(c), F.lit(0)))
    return joined.select(
        "id",
        "already_ids",
        F.greatest(F.coalesce("already", F.lit(0)), F.size("already_ids")).alias("already"),
        low("checked_now").alias("analysis_checked"),
        low("found_now").alias("analysis_found"),
        F.greatest(low("already_now"), F.size(F.coalesce("_ids", none))).alias("analysis_already"),
    )


def best_frames(frames: DataFrame) -> DataFrame:
    """The best frame of each burst; the earliest of equals."""
    return frames.groupBy("drive_id", "seq").agg(F.min_by("frame_idx", F.struct(-F.col("score"), "frame_idx")).alias("frame_idx"), F.max("score").alias("score"))


def segment_summary(segments: DataFrame, key: str) -> DataFrame:
    """Segments of each drive, and those that are complete: with a file, and ended by a roll-over rather than an error."""
    return segments.groupBy(key).agg(F.count("*").alias("segments"), F.count_if(F.col("has_file") & F.col("rolled_over")).alias("complete"))
