"""The best detection of each person."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def best_per_group(rows: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """One row per group: the highest score, of equals the first in order. Null scores lose; ties beyond order are any.

    A single aggregate with partial maxima, so a hot group shrinks before the shuffle.
    """
    rest = [c for c in rows.columns if c not in keys]
    lead = F.struct(F.col(score).isNotNull().alias("some"), F.col(score).alias("s"), (-F.col(order)).alias("o"))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), lead).alias("best")).select(*keys, *(F.col(f"best.{c}").alias(c) for c in rest))


def best_per_person(detections: DataFrame, labels: DataFrame) -> DataFrame:
    """The best detection of each cluster, noise excluded; person_id numbers clusters from 0."""
    joined = detections.join(labels.where(F.col("label") != -1), ["video_id", "det_ord"])
    return best_per_group(joined, ["video_id", "label"], "score", "det_ord").withColumnRenamed("label", "person_id")


def drop_unreadable(winners: DataFrame, frames: DataFrame) -> DataFrame:
    """Winners whose frame can be read again, with the frame's columns; the others are dropped."""
    return winners.join(frames, ["video_id", "frame_idx"])
