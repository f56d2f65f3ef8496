"""Which frames to look at: strides, coarse and refined passes, representative frames.

Every plan is made before a frame is read, from the video's row alone: frames are generated by explode(sequence), and
no plan needs a shuffle except the merging of regions of interest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framequarry.operators.islands import merged
from framequarry.plans.profiles import Profile

COARSE_SECONDS, COARSE_CHECKS = 5, 100
REFINE_CHECKS, REFINE_LEAST = 150, 5
MARGIN = 1.0
PICKS = 10


def duration(total_frames: Column, fps: Column) -> Column:
    """Seconds; 0 where the rate is not positive."""
    return F.when(fps > 0, total_frames / F.nullif(fps, F.lit(0.0))).otherwise(F.lit(0.0))


def timestamp(frame_idx: Column, fps: Column) -> Column:
    return F.try_divide(frame_idx.cast("double"), fps)


def stride_frames(profile: Profile, seconds: Column, fps: Column) -> Column:
    """Frames between samples, 1 at least, by the profile's tiers of duration."""
    step = None
    for bound, stride in profile.strides:
        if bound is None:
            step = F.lit(stride) if step is None else step.otherwise(F.lit(stride))
        else:
            step = (F if step is None else step).when(seconds < bound, F.lit(stride))
    return F.greatest(F.lit(1).cast("long"), (fps * step).cast("long"))


def stepped(n: Column, step: Column) -> Column:
    """0, step, 2 step, ... below n, as an array; empty for n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"), F.greatest(step, F.lit(1)).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def quarantine(videos: DataFrame) -> DataFrame:
    """Adds error: set where a video has no frames or no rate and so can't be sampled."""
    return videos.withColumn("error", F.when((F.coalesce("fps", F.lit(0.0)) <= 0) | (F.coalesce("total_frames", F.lit(0)) <= 0), F.lit("video is empty or corrupt")))


def uniform_samples(videos: DataFrame, profile: Profile) -> DataFrame:
    """video_id, frame_idx, ts at the profile's stride."""
    rows = videos.withColumn("seconds", duration(F.col("total_frames"), F.col("fps")))
    rows = rows.withColumn("step", stride_frames(profile, F.col("seconds"), F.col("fps")))
    return rows.select("video_id", "fps", F.explode(stepped(F.col("total_frames"), F.col("step"))).alias("frame_idx")).select("video_id", "frame_idx", timestamp(F.col("frame_idx"), F.col("fps")).alias("ts"))


def modulo_samples(frames: DataFrame, interval: str = "interval") -> DataFrame:
    """Frames whose index is a multiple of their video's interval."""
    return frames.where(F.col("frame_idx") % F.greatest(F.col(interval), F.lit(1)) == 0)


def coarse_step(n: Column, fps: Column) -> Column:
    """Every five seconds, or as far apart as keeps about a hundred checks; 1 at least."""
    step = F.greatest((fps * COARSE_SECONDS).cast("long"), F.lit(1).cast("long"))
    return F.when(n / step > COARSE_CHECKS, F.greatest((n / COARSE_CHECKS).cast("long"), F.lit(1).cast("long"))).otherwise(step)


def coarse_samples(videos: DataFrame) -> DataFrame:
    return videos.select("video_id", "fps", F.explode(stepped(F.col("total_frames"), coarse_step(F.col("total_frames"), F.col("fps")))).alias("frame_idx")).select("video_id", "frame_idx", timestamp(F.col("frame_idx"), F.col("fps")).alias("ts"))


def with_faces(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """Frames that have a detection, whatever its score."""
    return frames.join(detections.select("video_id", "frame_idx"), ["video_id", "frame_idx"], "left_semi")


def regions(points: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Merged ranges around points (video_id, ts): video_id, range_no, start, end, points.

    Ranges that touch or overlap become one. A range that begins at the largest end so far continues it.
    """
    return merged(points.select("video_id", F.greatest(F.lit(0.0), F.col("ts") - margin).alias("start"), (F.col("ts") + margin).alias("end")))


def refine_step(total_seconds: Column, fps: Column) -> Column:
    return F.greatest(F.lit(REFINE_LEAST).cast("long"), (total_seconds * fps / REFINE_CHECKS).cast("long"))


def refine_plan(ranges: DataFrame, videos: DataFrame) -> DataFrame:
    """Per video the summed length of its ranges and the step of the second pass."""
    lengths = ranges.groupBy("video_id").agg(F.sum(F.col("end") - F.col("start")).alias("total_seconds"))
    return lengths.join(videos.select("video_id", "fps", "total_frames"), "video_id").withColumn("step", refine_step(F.col("total_seconds"), F.col("fps")))


def refined_samples(ranges: DataFrame, videos: DataFrame) -> DataFrame:
    """Frames of the second pass: from int(start fps) to int(end fps) by the video's step, in the video, not deduplicated."""
    plan = refine_plan(ranges, videos)
    rows = ranges.join(plan, "video_id").withColumn("first", (F.col("start") * F.col("fps")).cast("long")).withColumn("last", (F.col("end") * F.col("fps")).cast("long"))
    spread = rows.select("video_id", "range_no", "fps", "total_frames", F.explode(F.sequence("first", F.greatest("first", "last"), "step")).alias("frame_idx"))
    return spread.where(F.col("frame_idx") < F.col("total_frames")).select("video_id", "range_no", "frame_idx", timestamp(F.col("frame_idx"), F.col("fps")).alias("ts"))


def readable(samples: DataFrame, misses: DataFrame) -> DataFrame:
    """A scan stops at the first frame that can't be read: samples before it; misses: video_id, frame_idx."""
    first = misses.groupBy("video_id").agg(F.min("frame_idx").alias("stop"))
    return samples.join(first, "video_id", "left").where(F.col("stop").isNull() | (F.col("frame_idx") < F.col("stop"))).drop("stop")


def candidate_picks(n: Column) -> Column:
    """Indices near both ends and, beyond ten frames, eight evenly spaced between; distinct, ascending."""
    n = n.cast("long")
    ends = F.array(F.lit(0).cast("long"), F.least(F.lit(29).cast("long"), n - 1), F.greatest(F.lit(0).cast("long"), n - 31), F.greatest(F.lit(0).cast("long"), n - 2))
    between = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: (F.lit(30.0) + k * ((n - 61).cast("double") / 9)).cast("long"))
    return F.array_sort(F.array_distinct(F.when(n > 10, F.concat(ends, between)).otherwise(ends)))


def padded_picks(n: Column) -> Column:
    """Candidates filled up to min(10, n): with successive sizes of the set, and for the few lengths where those are
    taken already with the smallest missing indices."""
    n = n.cast("long")
    picks, want = candidate_picks(n), F.least(F.lit(PICKS).cast("long"), n)
    size = F.size(candidate_picks(n)).cast("long")
    by_size = F.array_union(picks, F.sequence(size, F.greatest(size, want - 1)))
    missing = F.slice(F.array_except(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0).cast("long"))), picks), 1, F.greatest(F.lit(0).cast("long"), want - size).cast("int"))
    odd = n.between(4, 10) | (n == 15)
    return F.array_sort(F.when((n < 1) | (size >= want), picks).when(odd, F.array_union(picks, missing)).otherwise(by_size))


def representative_frames(videos: DataFrame, padded: bool = False, strict: bool = False) -> DataFrame:
    """video_id, ordinal, frame_idx of at most ten frames.

    Ordinals are given before indices outside the video are dropped, so they may have gaps; strict keeps such indices.
    """
    picks = padded_picks(F.col("total_frames")) if padded else candidate_picks(F.col("total_frames"))
    rows = videos.select("video_id", "total_frames", F.posexplode(F.slice(picks, 1, PICKS)).alias("ordinal", "frame_idx"))
    return (rows if strict else rows.where(F.col("frame_idx").between(0, F.col("total_frames") - 1))).select("video_id", "ordinal", "frame_idx")
