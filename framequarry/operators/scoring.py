"""Scores and thresholds of detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framequarry.plans.profiles import Profile


def confident(detections: DataFrame, threshold: float = 0.6, inclusive: bool = False, score: str = "det_score") -> DataFrame:
    """Detections above the threshold, or from it on; scores are compared as doubles."""
    value = F.col(score).cast("double")
    return detections.where(value >= threshold if inclusive else value > threshold)


def pose_score(yaw: Column, pitch: Column, roll: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(100.0) - (F.abs(yaw) * 1.2 + F.abs(pitch) + F.abs(roll) * 0.5))


def quality_score(det: Column, pose: Column, box_area: Column, frame_area: Column) -> Column:
    """40 of detection, 0.4 of pose, 20 of the share of the frame."""
    return det.cast("double") * 40 + pose * 0.4 + F.coalesce(F.try_divide(box_area, frame_area), F.lit(0.0)) * 20


def scored(detections: DataFrame, videos: DataFrame, profile: Profile) -> DataFrame:
    """Confident detections with the profile's ranking score."""
    kept = confident(detections, profile.threshold, profile.inclusive)
    if not profile.composite_score:
        return kept.withColumn("score", F.col("det_score").cast("double"))
    sized = kept.join(videos.select("video_id", "width", "height"), "video_id")
    area = (F.col("bbox.x2") - F.col("bbox.x1")) * (F.col("bbox.y2") - F.col("bbox.y1"))
    pose = pose_score(F.col("pose.yaw"), F.col("pose.pitch"), F.col("pose.roll"))
    return sized.withColumn("score", quality_score(F.col("det_score"), F.coalesce(pose, F.lit(100.0)), area, F.col("width").cast("double") * F.col("height"))).drop("width", "height")
