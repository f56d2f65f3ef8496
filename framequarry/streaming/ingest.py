"""Requests and detections as streams, through the same operators as in batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from framequarry.operators import requests, scoring


def request_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """JSON request files, as they arrive."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_trigger).text(path)
    return requests.parse_requests(lines)


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Runs work on every micro-batch; the checkpoint makes a restart go on where the last run ended."""
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def live_regions(detections: DataFrame, event_time: str = "at", margin_seconds: int = 1, late: str = "1 minute", threshold: float = 0.6) -> DataFrame:
    """Regions of interest of live streams: detections of a video no more than twice the margin apart are one session.

    A region closes when the watermark passes it; late detections beyond that are dropped by the engine.
    """
    seen = scoring.confident(detections, threshold).withWatermark(event_time, late)
    grouped = seen.groupBy("video_id", F.session_window(event_time, f"{2 * margin_seconds} seconds").alias("w"))
    found = grouped.agg(F.count(F.lit(1)).alias("points"), F.max("det_score").alias("best_score"))
    margin = F.expr(f"INTERVAL {margin_seconds} SECONDS")
    return found.select("video_id", (F.col("w.start") - margin).alias("start"), (F.col("w.end") - margin).alias("end"), "points", "best_score")
