"""Ranges that touch or overlap merged into one: a parallel prefix scan.

Ranges lie in partitions by (video, start), so one video may span any number of them. A partition merges what it holds as
a stream and sums itself up in one row: its first and last video, and how far the last one reaches. These rows, one a
partition, are scanned on the driver, which tells each partition how far its first video reaches already, and then how
many merged ranges that video has before it. Everything else is decided row by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from framequarry.runtime import materialise, shuffle_width


def running_most(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The greatest value so far inside each group of consecutive rows."""
    known, rank = np.unique(values, return_inverse=True)
    return known[np.maximum.accumulate(group * len(known) + rank) - group * len(known)] if len(values) else values


def islands(ranges: DataFrame) -> DataFrame:
    """Ranges (video_id, start, end) merged inside partitions: part, seq (in the video and partition), video_id, start, end,
    points; and a row for each partition, without seq: its first video as video_id, its last as last_video, and end, how
    far that one reaches."""
    kind = ranges.schema["video_id"].dataType.simpleString()
    names = ["part", "seq", "video_id", "last_video", "start", "end", "points"]

    def run(batches):
        part, held, first, seq, reach = TaskContext.get().partitionId(), None, None, 0, None

        def found(video, seq, start, end, points):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(seq), part), pa.int64()), pa.array(seq, pa.int64()), video, pa.nulls(len(seq), video.type), pa.array(start), pa.array(end), pa.array(points, pa.int64())], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            video, start, end = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            points = np.ones(len(start), np.int64)
            first = video[:1] if first is None else first
            if held is not None:  # the range that was open comes before the others, as one
                video = pa.concat_arrays([held[0], video])
                start, end, points = (np.concatenate([[h], x]) for h, x in zip(held[1:], (start, end, points)))
            code = video.dictionary_encode().indices.to_numpy()
            opens_video = np.concatenate([[True], code[1:] != code[:-1]])
            group = np.cumsum(opens_video) - 1
            most = running_most(end, group)
            opens = opens_video.copy()
            opens[1:] |= start[1:] > most[:-1]
            at = np.flatnonzero(opens)
            last = np.append(at[1:], len(start)) - 1
            number = np.cumsum(opens) - 1
            own = number[at] - number[np.flatnonzero(opens_video)][group[at]]
            own[group[at] == 0] += seq
            merged_points = np.add.reduceat(points, at)
            if len(at) > 1:
                yield found(video.take(pa.array(at[:-1])), own[:-1], start[at[:-1]], most[last[:-1]], merged_points[:-1])
            held, seq = (video.slice(at[-1], 1), start[at[-1]], most[-1], merged_points[-1]), int(own[-1])
        if held is not None:
            yield found(held[0], np.array([seq]), np.array([held[1]]), np.array([held[2]]), np.array([held[3]]))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.nulls(1, pa.int64()), first, held[0], pa.nulls(1, pa.float64()), pa.array([held[2]]), pa.nulls(1, pa.int64())], names=names)

    order = ["video_id", "start", "end"]
    rows = ranges.where("video_id is not null and start is not null").select(*(F.col(c) if c == "video_id" else F.col(c).cast("double").alias(c) for c in order))
    return rows.repartitionByRange(shuffle_width(ranges.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(run, f"part long, seq long, video_id {kind}, last_video {kind}, start double, end double, points long")


def carried(parts: list) -> list[tuple]:
    """(part, reach): how far the first video of each partition reaches before it, null where it begins there. A
    partition that holds one video alone hands on what it was told."""
    out, video, reach = [], None, None
    for p in sorted(parts, key=lambda p: p["part"]):
        told = reach if p["video_id"] == video else None
        out.append((p["part"], told))
        alone = p["video_id"] == p["last_video"]
        reach = max(p["end"], told) if alone and told is not None else p["end"]
        video = p["last_video"]
    return out


def numbered(parts: list) -> list[tuple]:
    """(part, before): merged ranges that the first video of each partition has before it; parts tell how many of the last
    video open in them."""
    out, video, count = [], None, 0
    for p in sorted(parts, key=lambda p: p["part"]):
        before = count if p["first_video"] == video else 0
        out.append((p["part"], before))
        count = p["opened"] + (before if p["first_video"] == p["last_video"] else 0)
        video = p["last_video"]
    return out


def merged(ranges: DataFrame) -> DataFrame:
    """Ranges (video_id, start, end) as video_id, range_no (from 1 by start), start, end and points (how many became one).

    A range that begins no later than the end of those before it continues them. Rows without video or start are dropped.
    """
    spark = ranges.sparkSession
    rows = materialise(islands(ranges), "islands")
    parts = rows.where("seq is null").select("part", "video_id", "last_video", "end").collect()  # one row a partition
    if not parts:
        return rows.select("video_id", F.col("seq").alias("range_no"), "start", "end", "points")
    told = dict(carried(parts))
    kind = rows.schema["video_id"].dataType.simpleString()
    known = spark.createDataFrame([(p["part"], p["video_id"], p["last_video"], told[p["part"]]) for p in parts], f"part long, first_video {kind}, last_video_of {kind}, reach double")
    mine = rows.where("seq is not null").join(F.broadcast(known), "part")
    goes_on = (F.col("video_id") == F.col("first_video")) & F.coalesce(F.col("start") <= F.col("reach"), F.lit(False))
    mine = mine.withColumn("goes_on", goes_on)
    sums = mine.groupBy("part", "first_video", "last_video_of").agg(
        F.sum(F.when(F.col("goes_on"), 1).otherwise(0)).alias("gone"),
        F.sum(F.when(~F.col("goes_on") & (F.col("video_id") == F.col("last_video_of")), 1).otherwise(0)).alias("opened"),
    ).withColumnRenamed("last_video_of", "last_video").collect()
    before = dict(numbered(sums))
    offsets = spark.createDataFrame([(p["part"], before[p["part"]], p["gone"]) for p in sums], "part long, before long, gone long")
    of_first = F.col("video_id") == F.col("first_video")
    number = F.when(F.col("goes_on"), F.col("before")).when(of_first, F.col("before") + F.col("seq") - F.col("gone") + 1).otherwise(F.col("seq") + 1)
    told_rows = mine.join(F.broadcast(offsets), "part").withColumn("range_no", number)
    return told_rows.groupBy("video_id", "range_no").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("points").alias("points"))
