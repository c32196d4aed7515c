"""Usage events: quotas and funnels, the same in batch and over a stream's batches.

usage_events: (key, device_id, event_type, metadata, ts); limits: (key, upload_limit).
One recorded upload counts one; keys of any size combine map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V

EVENT = "key string, device_id string, event_type string, metadata string, ts timestamp"
STEPS = ("ocr_started", "ocr_completed", "ocr_failed", "marks_insertion_started", "marks_insertion_completed", "marks_insertion_failed")


def known_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin(*V.USAGE_EVENTS))


def uploads_by_key(events: DataFrame) -> DataFrame:
    """(key, uploads): the recorded uploads of every key."""
    return events.groupBy("key").agg(F.count_if(F.col("event_type") == "image_uploaded").alias("uploads"))


def quota_report(events: DataFrame, limits: DataFrame, warn_below: int = 5) -> DataFrame:
    """(key, uploads, upload_limit, remaining, percentage, state): state is blocked, warning (up to ``warn_below`` left) or allowed."""
    return quota_states(uploads_by_key(events), limits, warn_below)


def quota_states(used: DataFrame, limits: DataFrame, warn_below: int = 5) -> DataFrame:
    """The quota report from uploads already counted (key, uploads); a key of ``limits`` without a count has none."""
    joined = limits.join(used, "key", "left").select("key", F.coalesce("uploads", F.lit(0)).alias("uploads"), "upload_limit")
    left = F.greatest(F.col("upload_limit") - F.col("uploads"), F.lit(0)).cast("long")
    share = F.coalesce(F.round(F.try_divide(F.col("uploads") * F.lit(100.0), F.col("upload_limit")), 2), F.lit(100.0))
    state = F.when(left == 0, "blocked").when(left <= warn_below, "warning").otherwise("allowed")
    return joined.select("key", "uploads", "upload_limit", left.alias("remaining"), share.alias("percentage"), state.alias("state"))


def decided(left: Column, warn_below: int) -> list[Column]:
    """decision, remaining and suspends of an upload before which ``left`` were left."""
    decision = F.when(left <= 0, "blocked").when(left <= warn_below, "warned").otherwise("allowed")
    return [decision.alias("decision"), F.greatest(left - 1, F.lit(0)).cast("long").alias("remaining"), (left == 1).alias("suspends")]


def upload_decisions(uploads: DataFrame, limits: DataFrame, warn_below: int = 5) -> DataFrame:
    """(key, event_id, ts, decision, remaining, suspends) per upload (key, event_id, ts), decided in the order of ts and event_id.

    An upload is allowed while its key has some left, warned at up to
    ``warn_below`` left, and blocked after that; the last one suspends the key. A
    repeated event counts once, at its first time. A key without a limit has none
    left. Uploads without key, event_id or ts are none.
    """
    once = uploads.where("key is not null and event_id is not null and ts is not null").groupBy("key", "event_id").agg(F.min("ts").alias("ts"))
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("ts", "event_id")))
    left = F.coalesce("upload_limit", F.lit(0)) - F.col("place") + 1
    return placed.join(limits, "key", "left").select("key", "event_id", "ts", *decided(left, warn_below))


def funnel(events: DataFrame) -> DataFrame:
    """Per key how often each recognition and insertion step was recorded, and how often uploads were blocked by errors."""
    counts = [F.count_if(F.col("event_type") == s).alias(s) for s in (*STEPS, "image_uploaded", "error_occurred")]
    return events.groupBy("key").agg(*counts)
