"""The line being spoken at a moment: an interval join with a fallback, as a sweep.

A moment takes the first caption, in list order, that contains it (both ends included); without one, the first that
starts less than two seconds away; else nothing. A match without a speaker counts as a match.

Captions and moments are sorted together by video and time and range-partitioned, so a hot video spreads over tasks. A
caption is one row, however long it lasts; where it is still open when a partition ends, it is carried into the later
partitions that it reaches, as their first times, one row a partition, tell. Each task then sweeps its rows in order and
holds the open captions only, the first of them on top.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framequarry.runtime import materialise, shuffle_width

NEAR_SECONDS = 2.0
#: Captions are taken up this long before they start, a little more than the fallback reaches, and kept as long after.
EARLY = 2.5


class Open:
    """Captions that are open, the first in list order on top; those that have ended go when they are met, or when they
    are more than half of all."""

    def __init__(self):
        self.heap, self.checked = [], 64

    def add(self, ordinal, until, number, place):
        heapq.heappush(self.heap, (ordinal, until, number, place))

    def first(self, now, ended):
        """The first caption for which ended(until, now) does not hold."""
        heap = self.heap
        if len(heap) > 2 * self.checked:
            heap[:] = [c for c in heap if not ended(c[1], now)]
            heapq.heapify(heap)
            self.checked = max(64, len(heap))
        while heap and ended(heap[0][1], now):
            heapq.heappop(heap)
        return heap[0] if heap else None


class Sweep:
    """The state of one video: captions that have started, that lie near, and that are yet to start."""

    def __init__(self):
        self.inside, self.near, self.coming, self.number = Open(), Open(), [], 0

    def caption(self, start, end, ordinal, place):
        self.number += 1  # no two captions tie
        heapq.heappush(self.coming, (start, self.number, end, ordinal, place))
        self.near.add(ordinal, start, self.number, place)

    def match(self, ts):
        while self.coming and self.coming[0][0] <= ts:
            _, number, end, ordinal, place = heapq.heappop(self.coming)
            if end >= ts:
                self.inside.add(ordinal, end, number, place)
        hit = self.inside.first(ts, lambda end, now: end < now)
        if hit is None:
            # All that are near have come up, as captions are taken up early enough.
            hit = self.near.first(ts, lambda start, now: not abs(start - now) < NEAR_SECONDS and start < now)
            if hit is not None and not abs(hit[1] - ts) < NEAR_SECONDS:
                hit = min((c for c in self.near.heap if abs(c[1] - ts) < NEAR_SECONDS), default=None)
        return None if hit is None else hit[3]


def laid_out(moments: DataFrame, captions: DataFrame, ts: str) -> DataFrame:
    """Captions and moments in one order: part, video_id, at, kind (0: a caption), ts, start, end, until, ordinal, speaker,
    context_text and row, the moment's own columns."""
    row = F.struct(*moments.columns)
    nothing = lambda c, kind: F.lit(None).cast(kind).alias(c)
    number = lambda c: F.col(c).cast("double")
    spoken = captions.where("video_id is not null and start is not null").select(
        "video_id", (number("start") - EARLY).alias("at"), F.lit(0).alias("kind"), nothing("ts", "double"), number("start").alias("start"), F.coalesce(number("end"), number("start") - 1).alias("end"),
        F.greatest(F.coalesce(number("end"), number("start")), number("start") + EARLY).alias("until"), F.col("ordinal").cast("long").alias("ordinal"), "speaker", F.col("text").alias("context_text"), F.lit(None).cast(moments.schema).alias("row"))
    asked = moments.where(F.col("video_id").isNotNull() & F.col(ts).isNotNull()).select(
        "video_id", number(ts).alias("at"), F.lit(1).alias("kind"), number(ts).alias("ts"), *(nothing(c, "double") for c in ("start", "end", "until")), nothing("ordinal", "long"), nothing("speaker", "string"), nothing("context_text", "string"), row.alias("row"))
    order = ["video_id", "at", "kind"]
    return spoken.unionByName(asked).repartitionByRange(shuffle_width(moments.sparkSession), *order).withColumn("part", F.spark_partition_id())


def with_context(moments: DataFrame, captions: DataFrame, ts: str = "ts") -> DataFrame:
    """moments with speaker and context_text of their caption, null without one; moments without video or time have none."""
    spark = moments.sparkSession
    rows = materialise(laid_out(moments, captions, ts), "sweep")
    firsts = rows.groupBy("part").agg(F.min(F.struct("video_id", "at")).alias("first")).select(F.col("part").alias("to"), F.col("first.video_id").alias("of_video"), F.col("first.at").alias("from_at"))
    # One row a partition; a caption goes into those later ones that begin in its video while it is open.
    open_there = (F.col("of_video") == F.col("video_id")) & (F.col("to") > F.col("part")) & (F.col("from_at") <= F.col("until"))
    over = rows.where("kind = 0").join(F.broadcast(firsts), open_there).withColumn("part", F.col("to")).select(*rows.columns)
    width = shuffle_width(spark)
    order = ["part", "video_id", "at", "kind"]
    names = ["row", "speaker", "context_text"]

    def run(batches):
        video, state = None, None
        for batch in batches:
            known = {c: batch.column(batch.schema.get_field_index(c)) for c in ("video_id", "kind", "ts", "start", "end", "ordinal", "speaker", "context_text")}
            row = batch.column(batch.schema.get_field_index("row"))
            asked, told = [], []
            for i, (v, kind, at, start, end, ordinal) in enumerate(zip(*(known[c].to_pylist() for c in ("video_id", "kind", "ts", "start", "end", "ordinal")))):
                if v != video:
                    video, state = v, Sweep()
                if kind == 0:
                    state.caption(start, end, ordinal, (known["speaker"][i].as_py(), known["context_text"][i].as_py()))
                else:
                    asked.append(i)
                    told.append(state.match(at) or (None, None))
            if asked:
                yield pa.RecordBatch.from_arrays([row.take(pa.array(asked)), *(pa.array([t[k] for t in told], pa.string()) for k in range(2))], names=names)

    swept = rows.unionByName(over).repartitionById(width, F.col("part").cast("int")).sortWithinPartitions(*order)
    kind = moments.schema.simpleString()
    found = swept.drop("until", "at", "part").mapInArrow(run, f"row {kind}, speaker string, context_text string")
    alone = moments.where(F.col("video_id").isNull() | F.col(ts).isNull()).select(*moments.columns, *(F.lit(None).cast("string").alias(c) for c in names[1:]))
    return found.select(*(F.col("row").getField(c).alias(c) for c in moments.columns), "speaker", "context_text").unionByName(alone)
