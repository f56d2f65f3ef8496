"""A pivot index over the vectors of each video: cells that the triangle inequality tells apart.

A video of more than BLOCK points gets some of them as pivots. Every point belongs to the cell of its nearest pivot and,
in it, to a ring of distances; a cell of more than BLOCK points is dealt to several blocks by hash. A block knows the
least and greatest distance of its points to each pivot, so two blocks whose ranges for any pivot lie further apart than
the radius hold no neighbours and never meet, and blocks within half the radius of one pivot hold nothing else.

Small videos are one block. Nothing gathers a video in one task: points meet their pivots in parts of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Points that a block holds on average at most, pivots of a video, and points that meet its pivots in one task.
BLOCK, PIVOTS, PART = 1024, 256, 8192
#: Rings of a cell are a quarter of the radius wide.
RINGS = 4
#: Distances are compared with this much to spare, far above what rounding can do.
MARGIN = 1e-6


def normalised(vector: Column) -> Column:
    """Length 1, in double precision; a zero vector stays zero."""
    wide = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(wide, lambda x: F.coalesce(x / F.nullif(norm, F.lit(0.0)), F.lit(0.0)))


def cosine_floor(eps: float) -> float:
    """Unit vectors lie within eps of each other exactly from this inner product on."""
    return 1 - eps * eps / 2


def matrix(column) -> np.ndarray:
    """Equally long lists as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def celled(points: DataFrame, eps: float, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """points (video_id, det_ord, embedding) as video_id, det_ord, unit, cell and far: their distances to the pivots.

    cell: pivot and ring as one number; 0 and no distances for small videos, and where the radius is too large for
    distances to tell points apart.
    """
    kind = points.schema["video_id"].dataType.simpleString()
    unit = points.select("video_id", F.col("det_ord").cast("long").alias("det_ord"), normalised(F.col("embedding")).alias("unit"))
    sizes = points.groupBy("video_id").agg(F.count(F.lit(1)).alias("points"))
    sized = unit.join(sizes, "video_id")
    one = F.lit(0).cast("long").alias("cell"), F.array().cast("array<double>").alias("far")
    if eps >= 1.4:
        return unit.select("video_id", "det_ord", "unit", *one)
    small = sized.where(F.col("points") <= block).select("video_id", "det_ord", "unit", *one)
    parts = F.ceil(F.col("points") / PART).cast("int")
    large = sized.where(F.col("points") > block).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("det_ord"), F.col("parts")).cast("int"))
    # About one point in so many is a pivot: no more, on average, than a block has points or a video pivots.
    every = F.greatest(F.ceil(F.col("points") / pivots), F.lit(block // 8))
    chosen = large.where(F.pmod(F.xxhash64("det_ord", F.lit(7)), every) == 0).select(F.col("video_id").alias("of_video"), F.col("det_ord").alias("pivot"), F.col("unit").alias("pivot_unit"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("of_part"))

    def measured(left, right):
        left = left.set_column(left.schema.get_field_index("unit"), "unit", left["unit"].cast(pa.list_(pa.float64())))
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in (left["video_id"].type, pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.list_(pa.float64()))], names=names)
        own = matrix(left["unit"])
        right = right.sort_by("pivot")
        if right.num_rows:
            far = np.sqrt(np.maximum(0.0, 2 - 2 * own @ matrix(right["pivot_unit"]).T))
            nearest = far.argmin(axis=1)
            ring = (far[np.arange(len(far)), nearest] / (eps / RINGS)).astype(np.int64)
            cell = nearest * 1024 + np.minimum(ring, 1023)
        else:
            far, cell = np.zeros((len(own), 0)), np.zeros(len(own), np.int64)
        ends = pa.array(np.arange(len(far) + 1) * far.shape[1], pa.int32())
        return pa.table([left["video_id"], left["det_ord"], left["unit"], pa.array(cell), pa.ListArray.from_arrays(ends, pa.array(far.reshape(-1)))], names=names)

    names = ["video_id", "det_ord", "unit", "cell", "far"]
    both = large.select("video_id", "part", "det_ord", "unit").groupBy("video_id", "part").cogroup(chosen.groupBy("of_video", "of_part"))
    return small.unionByName(both.applyInArrow(measured, f"video_id {kind}, det_ord long, unit array<double>, cell long, far array<double>"))


def blocked(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds block: a cell's number and, where it has more points than a block, a part of it."""
    sizes = cells.groupBy("video_id", "cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    part = F.pmod(F.xxhash64("det_ord", F.lit(3)), F.col("parts"))
    return cells.join(sizes, ["video_id", "cell"]).withColumn("block", F.col("cell") * F.lit(1 << 24) + part).drop("parts")


def near_blocks(blocks: DataFrame, eps: float) -> DataFrame:
    """(video_id, low, high, low_about, high_about): blocks low < high of a video that may hold neighbours; blocks: video_id,
    block, low_far and high_far, the least and greatest distances of its points to the pivots, and about."""
    reach = eps + MARGIN
    a = blocks.select("video_id", F.col("block").alias("low"), F.col("low_far").alias("a_low"), F.col("high_far").alias("a_high"), F.col("about").alias("low_about"))
    b = blocks.select("video_id", F.col("block").alias("high"), F.col("low_far").alias("b_low"), F.col("high_far").alias("b_high"), F.col("about").alias("high_about"))
    touching = F.expr(f"forall(zip_with(a_low, b_high, (x, y) -> x - y), d -> d <= {reach}) and forall(zip_with(b_low, a_high, (x, y) -> x - y), d -> d <= {reach})")
    return a.join(b, "video_id").where(F.col("low") < F.col("high")).where(touching).select("video_id", "low", "high", "low_about", "high_about")
