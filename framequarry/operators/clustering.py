"""Density clustering of embeddings per video, as relations or per group in numpy.

The relational form never lists pairs. Points lie in the blocks of a pivot index (operators.metric), where blocks too far
apart for any neighbours do not meet. Each block first counts neighbours inside itself and joins the core points it can
tell already; blocks whose points are all within half the radius of one pivot need no comparison for that. Blocks are
gathered in tiles, a few for each video and of bounded size, and a point travels once for a pair of tiles, however many
blocks of the two meet. Every tile first counts and joins by itself. What is open then is counted between tiles, up to the
least number that makes a core point, and, when all core points are known, components are joined. Points that are known
to be core, or in one component with what they meet, are not compared again. What a meeting returns is a spanning forest
over the components it saw, one edge less than these at most, and the few core points that border points touch; forests
merge in operators.components. The grouped form runs one video in one task and is exact for the same definition; it
computes distances in blocks, so memory stays linear in the video's detections.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from framequarry.operators.components import connected_components
from framequarry.operators.metric import BLOCK, MARGIN, blocked, celled, cosine_floor, matrix, near_blocks, normalised
from framequarry.runtime import materialise

EPS, MIN_SAMPLES = 0.65, 3
#: Tiles that a video of many blocks has at least, blocks that a tile holds at most, numbers in its vectors at most, and
#: columns compared at once.
TILES, TILE_BLOCKS, TILE_VALUES, COLUMNS = 8, 64, 4 << 20, 4096


def neighbours(points: DataFrame, eps: float = EPS, block: int = BLOCK) -> DataFrame:
    """Pairs (video_id, a, b) within eps, each point with itself; points: video_id, det_ord, embedding.

    For those who want the pairs themselves, as many as there are; clusters are found without them.
    """
    floor = cosine_floor(eps)

    def near(key, got):
        low, high = key[-2].as_py(), key[-1].as_py()
        ordinal, mine = got["det_ord"].to_numpy(), got["mine"].to_numpy()
        unit = np.array(got["unit"].to_pylist(), np.float64).reshape(got.num_rows, -1)
        left, right = np.flatnonzero(mine == low), np.flatnonzero(mine == high)
        close = unit[left] @ unit[right].T >= floor
        if low == high:
            np.fill_diagonal(close, True)
        i, j = np.nonzero(close)
        a, b = ordinal[left[i]], ordinal[right[j]]
        if low != high:
            a, b = np.concatenate([a, b]), np.concatenate([b, a])
        video = pa.array([key[0].as_py()] * len(a), got["video_id"].type)
        return pa.table([video, pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["video_id", "a", "b"])

    unit = points.select("video_id", F.col("det_ord").cast("long").alias("det_ord"), normalised(F.col("embedding")).alias("unit"))
    sizes = points.groupBy("video_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = unit.join(sizes, "video_id").withColumn("mine", F.pmod(F.xxhash64("det_ord"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = dealt.select("video_id", "det_ord", "unit", "mine", other).withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")})
    kind = points.schema["video_id"].dataType.simpleString()
    return met.drop("other").groupBy("video_id", "low", "high").applyInArrow(near, f"video_id {kind}, a long, b long")


def reached_in_block(close: np.ndarray, core: np.ndarray) -> np.ndarray:
    """For each core point the first core point that it is joined with; each row of close is looked at once."""
    first = np.full(len(core), -1)
    for seed in np.flatnonzero(core):
        if first[seed] >= 0:
            continue
        front = np.array([seed])
        first[seed] = seed
        while len(front):
            fresh = np.flatnonzero(close[front].any(axis=0) & core & (first < 0))
            first[fresh] = seed
            front = fresh
    return first


def merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root, the least member of each component, after the edges (a, b)."""
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


class Tiled:
    """Points of one or two tiles and the pairs of blocks among them that meet, each block with its partners."""

    def __init__(self, points: pa.Table, pairs: pa.Table, floor: float):
        self.points, self.floor = points, floor
        self.unit, self.ordinal = matrix(points["unit"].cast(pa.list_(pa.float64()))), points["det_ord"].to_numpy()
        order = np.argsort(points["block"].to_numpy(), kind="stable")
        known, starts = np.unique(points["block"].to_numpy()[order], return_index=True)
        self.rows = dict(zip(known.tolist(), np.split(order, starts[1:])))
        self.partners: dict[int, list[int]] = {}
        self.later: dict[int, list[int]] = {}
        for low, high in zip(pairs["low"].to_pylist(), pairs["high"].to_pylist()):
            self.later.setdefault(low, []).append(high)
            self.partners.setdefault(low, []).append(high)
            if low != high:
                self.partners.setdefault(high, []).append(low)

    def of(self, blocks: list[int]) -> np.ndarray:
        return np.concatenate([self.rows[b] for b in blocks])

    def close(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        return (self.unit[rows] @ self.unit[columns].T >= self.floor) | (rows[:, None] == columns[None, :])

    def count(self, hits: np.ndarray, least: int) -> np.ndarray:
        """hits with the neighbours in partners, for points that have fewer than least, until they have as many."""
        hits = hits.copy()
        for block, others in self.partners.items():
            rows, columns = self.rows[block], self.of(others)
            for at in range(0, len(columns), COLUMNS):
                rows = rows[hits[rows] < least]
                if not len(rows):
                    break
                hits[rows] += self.close(rows, columns[at : at + COLUMNS]).sum(axis=1)
        return hits

    def join(self, core: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names of the core points' components, sorted, and for each the place of the least that it is joined with."""
        names, place = np.unique(comp[core], return_inverse=True)
        of = np.full(len(core), -1)
        of[core] = place
        root = np.arange(len(names))
        for block, others in self.later.items():
            mine, theirs = self.rows[block], self.of(others)
            mine, theirs = mine[core[mine]], theirs[core[theirs]]
            for at in range(0, len(theirs), COLUMNS):
                columns = theirs[at : at + COLUMNS]
                if not len(mine):
                    break
                tops = root[of[mine]]
                common = np.bincount(tops).argmax()  # most rows are in one component: only what is not in it can tell them more
                for rows, met in ((mine[tops == common], columns[root[of[columns]] != common]), (mine[tops != common], columns)):
                    if len(rows) and len(met):
                        i, j = np.nonzero(self.close(rows, met))
                        root = merged(root, of[rows[i]], of[met[j]])
        return names, root

    def touched(self, core: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (ordinal of a point that is not core, component of a core point within the radius)."""
        found = [np.zeros((2, 0), np.int64)]
        for block, others in self.partners.items():
            rows, columns = self.rows[block], self.of(others)
            rows, columns = rows[~core[rows]], columns[core[columns]]
            for at in range(0, len(columns) if len(rows) else 0, COLUMNS):
                i, j = np.nonzero(self.close(rows, columns[at : at + COLUMNS]))
                found.append(np.stack([self.ordinal[rows[i]], comp[columns[at : at + COLUMNS][j]]]))
        border, of = np.unique(np.concatenate(found, axis=1), axis=1)
        return border, of


def core_and_components(got: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which points are core, and their components, whatever these are for the others."""
    return got["comp"].is_valid().to_numpy(), got["comp"].fill_null(0).to_numpy()


@dataclass
class Meetings:
    """Points with what their own block tells, and the blocks that must meet.

    points: video_id, block, tile, det_ord, unit, hits (neighbours in the tile, at most min_samples) and comp (the first
    core point of its component in the tile, null for points not yet core). blocks: video_id, block, tile, size, tight and
    whether all its points are core. pairs: video_id, low, high, their tiles, and full (both hold core points only); those
    within a tile have met once, and meet again where they are not full. sure: edges (video_id, u, v) between components
    that need no comparison.
    """

    points: DataFrame
    blocks: DataFrame
    pairs: DataFrame
    sure: DataFrame

    def comparisons(self) -> int:
        """Pairs of points that are compared, each once, while neighbours are counted and components joined."""
        inside = self.blocks.where("not tight").agg(F.sum(F.expr("size * (size - 1) div 2"))).first()[0] or 0
        sized = self.blocks.select("video_id", "block", "size")
        low, high = (sized.withColumnsRenamed({"block": c, "size": f"{c}_size"}) for c in ("low", "high"))
        across = self.pairs.join(low, ["video_id", "low"]).join(high, ["video_id", "high"]).agg(F.sum(F.col("low_size") * F.col("high_size"))).first()[0]
        return int(inside + (across or 0))


def meetings(points: DataFrame, eps: float = EPS, min_samples: int = MIN_SAMPLES, block: int = BLOCK) -> Meetings:
    floor, kind = cosine_floor(eps), points.schema["video_id"].dataType.simpleString()
    names = ["video_id", "block", "det_ord", "unit", "hits", "comp", "tight", "low_far", "high_far"]

    def local(key, got):
        got = got.sort_by("det_ord")
        ordinal, n = got["det_ord"].to_numpy(), got.num_rows
        unit, far = matrix(got["unit"]), matrix(got["far"])
        pivot = int(got["cell"][0].as_py()) // 1024
        tight = bool(n >= min_samples and far.shape[1] and 2 * far[:, pivot].max() <= eps - MARGIN)
        if tight:
            hits, first = np.full(n, min_samples), np.zeros(n, np.int64)
        else:
            close = unit @ unit.T >= floor
            np.fill_diagonal(close, True)
            hits = np.minimum(close.sum(axis=1), min_samples)
            first = reached_in_block(close, hits >= min_samples)
        told = pa.table([got["video_id"], pa.array([key[1].as_py()] * n, pa.int64()), got["det_ord"], got["unit"].cast(pa.list_(pa.float64())), pa.array(hits, pa.int32()), pa.array(ordinal[first], pa.int64(), mask=first < 0), pa.array([tight] * n), pa.nulls(n, pa.list_(pa.float64())), pa.nulls(n, pa.list_(pa.float64()))], names=names)
        ranges = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (far.min(axis=0), far.max(axis=0))]
        about = pa.table([got["video_id"][:1], pa.array([key[1].as_py()], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.float64())), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([tight]), *ranges], names=names)
        return pa.concat_tables([told, about])

    schema = f"video_id {kind}, block long, det_ord long, unit array<double>, hits int, comp long, tight boolean, low_far array<double>, high_far array<double>"
    told = materialise(blocked(celled(points, eps, block), block).groupBy("video_id", "block").applyInArrow(local, schema), "blocks")
    seen = told.where("det_ord is not null").drop("low_far", "high_far")
    sums = seen.groupBy("video_id", "block").agg(F.count(F.lit(1)).alias("size"), F.min(F.col("comp").isNotNull()).alias("full"), F.min("comp").alias("least"), F.max("comp").alias("most"))
    ranges = told.where("det_ord is null").select("video_id", "block", "tight", "low_far", "high_far")
    blocks = materialise(ranges.join(sums, ["video_id", "block"]), "block-sums")
    pivot = F.floor(F.col("block") / F.lit(1024 << 24))
    near = near_blocks(blocks.select("video_id", "block", "low_far", "high_far", F.struct("full", "least", "most", "tight", pivot.alias("pivot")).alias("about")), eps)
    # Tiles: blocks in order, as many points as a share of the video has, between a block and what one task can hold.
    dims = seen.agg(F.max(F.size("unit"))).first()[0] or 1
    most = max(block, min(TILE_BLOCKS * block, TILE_VALUES // max(1, dims)))
    video = Window.partitionBy("video_id")
    share = F.greatest(F.lit(block), F.least(F.lit(most), F.ceil(F.sum("size").over(video) / TILES)))
    before = F.coalesce(F.sum("size").over(video.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tiles = materialise(blocks.select("video_id", "block", F.floor(before / share).alias("tile")), "tiles")
    one = lambda side: F.col(f"{side}.full") & (F.col(f"{side}.least") == F.col(f"{side}.most"))
    both = near.where(~(one("low_about") & one("high_about") & (F.col("low_about.least") == F.col("high_about.least"))))
    sure = F.col("low_about.tight") & F.col("high_about.tight") & (F.col("low_about.pivot") == F.col("high_about.pivot"))
    both = materialise(both.withColumn("sure", sure), "block-pairs")
    low, high = (tiles.withColumnsRenamed({"block": c, "tile": f"{c}_tile"}) for c in ("low", "high"))
    pairs = materialise(both.where("not sure").select("video_id", "low", "high").join(low, ["video_id", "low"]).join(high, ["video_id", "high"]), "tile-pairs")
    points = materialise(tile_by_itself(seen.join(tiles, ["video_id", "block"]), pairs, floor, min_samples), "tiled")
    ends = points.groupBy("video_id", "block").agg(F.min(F.col("comp").isNotNull()).alias("full"), F.min("comp").alias("least"))
    blocks = materialise(blocks.select("video_id", "block", "size", "tight").join(tiles, ["video_id", "block"]).join(ends, ["video_id", "block"]), "block-ends")
    low, high = (blocks.select("video_id", F.col("block").alias(c), F.col("least").alias(f"{c}_least"), F.col("full").alias(f"{c}_full")) for c in ("low", "high"))
    told = lambda rows: rows.join(low, ["video_id", "low"]).join(high, ["video_id", "high"])
    edges = told(both.where("sure").select("video_id", "low", "high")).select("video_id", F.col("low_least").alias("u"), F.col("high_least").alias("v"))
    pairs = told(pairs).select("video_id", "low", "high", "low_tile", "high_tile", (F.col("low_full") & F.col("high_full")).alias("full"))
    return Meetings(points, blocks.select("video_id", "block", "tile", "size", "tight", "full"), materialise(pairs, "meeting-blocks"), materialise(edges, "sure-edges"))


def tile_by_itself(points: DataFrame, pairs: DataFrame, floor: float, min_samples: int) -> DataFrame:
    """points (video_id, tile, block, det_ord, unit, hits, comp) with the neighbours and components of their tile."""
    names = ["video_id", "tile", "block", "det_ord", "unit", "hits", "comp"]

    def run(left, right):
        if not left.num_rows:
            return left
        tiled, hits = Tiled(left, right, floor), left["hits"].to_numpy()
        was, comp = core_and_components(left)
        hits = tiled.count(hits, min_samples)
        core = hits >= min_samples
        comp = np.where(was, comp, tiled.ordinal)
        for block, rows in tiled.rows.items():  # points that are core only now have not been joined with their own block
            if (core[rows] & ~was[rows]).any():
                tiled.later.setdefault(block, []).append(block)
        joined, root = tiled.join(core, comp)
        comp[core] = joined[root[np.searchsorted(joined, comp[core])]]
        return pa.table([*(left[c] for c in names[:4]), left["unit"].cast(pa.list_(pa.float64())), pa.array(np.minimum(hits, min_samples), pa.int32()), pa.array(comp, pa.int64(), mask=~core)], names=names)

    kind = points.schema["video_id"].dataType.simpleString()
    inside = pairs.where("low_tile = high_tile").select(F.col("video_id").alias("of_video"), F.col("low_tile").alias("of_tile"), "low", "high")
    both = points.select(*names).groupBy("video_id", "tile").cogroup(inside.groupBy("of_video", "of_tile"))
    return both.applyInArrow(run, f"video_id {kind}, tile long, block long, det_ord long, unit array<double>, hits int, comp long")


def meeting_tiles(points: DataFrame, pairs: DataFrame, columns: list[str], run, schema: str) -> DataFrame:
    """run(points, pairs) for every two tiles with blocks that meet; points travel once for each such pair of tiles.

    pairs: video_id, low, high and their tiles; points: video_id, block and columns, of which only those whose blocks meet
    others are there.
    """
    met = pairs.select(F.col("video_id").alias("of_video"), F.least("low_tile", "high_tile").alias("of_first"), F.greatest("low_tile", "high_tile").alias("of_second"), "low", "high")
    role = met.select(F.col("of_video").alias("video_id"), F.col("of_first").alias("first"), F.col("of_second").alias("second"), F.explode(F.array("low", "high")).alias("block")).distinct()
    rows = points.select("video_id", "block", *columns).join(role, ["video_id", "block"])
    return rows.groupBy("video_id", "first", "second").cogroup(met.groupBy("of_video", "of_first", "of_second")).applyInArrow(run, schema)


def core_points(met: Meetings, floor: float, min_samples: int) -> DataFrame:
    """points with comp set for all core points: those that the meetings of their tile have made core are their own."""
    kind = met.points.schema["video_id"].dataType.simpleString()

    def counted(left, right):
        hits = left["hits"].to_numpy().astype(np.int64)
        more = Tiled(left, right, floor).count(hits, min_samples) - hits if left.num_rows else hits
        rows = np.flatnonzero(more > 0)
        return pa.table([left["video_id"].take(pa.array(rows)), left["det_ord"].take(pa.array(rows)), pa.array(more[rows], pa.int64())], names=["video_id", "det_ord", "more"])

    # Within a tile all is counted.
    more = meeting_tiles(met.points, met.pairs.where("not full and low_tile <> high_tile"), ["det_ord", "unit", "hits"], counted, f"video_id {kind}, det_ord long, more long")
    more = more.groupBy("video_id", "det_ord").agg(F.sum("more").alias("more"))
    enough = F.col("hits") + F.coalesce("more", F.lit(0)) >= min_samples
    return met.points.join(more, ["video_id", "det_ord"], "left").withColumn("comp", F.coalesce("comp", F.when(enough, F.col("det_ord")))).drop("more")


def forest(points: DataFrame, met: Meetings, floor: float) -> DataFrame:
    """(video_id, border, u, v): edges between components where border is null, else a point that is not core and u the
    component of a core point that it touches."""
    kind = points.schema["video_id"].dataType.simpleString()
    names = ["video_id", "border", "u", "v"]

    def joined(left, right):
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in (left["video_id"].type, pa.int64(), pa.int64(), pa.int64())], names=names)
        tiled = Tiled(left, right, floor)
        core, comp = core_and_components(left)
        known, root = tiled.join(core, comp)
        moved = np.flatnonzero(root != np.arange(len(root)))
        border, of = tiled.touched(core, comp)
        video = pa.array([left["video_id"][0].as_py()] * (len(moved) + len(border)), left["video_id"].type)
        return pa.table([video, pa.concat_arrays([pa.nulls(len(moved), pa.int64()), pa.array(border, pa.int64())]), pa.array(np.concatenate([known[moved], of]), pa.int64()), pa.concat_arrays([pa.array(known[root[moved]], pa.int64()), pa.nulls(len(border), pa.int64())])], names=names)

    alone = met.blocks.where("not full").select("video_id", F.col("block").alias("low"), F.col("block").alias("high"), F.col("tile").alias("low_tile"), F.col("tile").alias("high_tile"))
    pairs = met.pairs.where("not full or low_tile <> high_tile").drop("full").unionByName(alone)
    return meeting_tiles(points, pairs, ["det_ord", "unit", "comp"], joined, f"video_id {kind}, border long, u long, v long")


def clusters(points: DataFrame, eps: float = EPS, min_samples: int = MIN_SAMPLES, block: int = BLOCK) -> DataFrame:
    """(video_id, det_ord, label): labels number clusters from 0 in the order of their first core point; noise is -1.

    A border point takes the lowest label among the core points that it neighbours.
    """
    floor = cosine_floor(eps)
    met = meetings(points, eps, min_samples, block)
    known = materialise(core_points(met, floor, min_samples), "core-points")
    found = materialise(forest(known, met, floor), "forest")
    # Nodes are (video, ordinal) structs, whose order is that of ordinals inside a video.
    node = lambda c: F.struct(F.col("video_id"), F.col(c).alias("det_ord"))
    edges = found.where("border is null").select("video_id", "u", "v").unionByName(met.sure)
    tops = connected_components(edges.select(node("u").alias("x"), node("v").alias("y")), "x", "y")
    tops = tops.select("node.video_id", F.col("node.det_ord").alias("comp"), F.col("component.det_ord").alias("top"))
    cores = known.where("comp is not null").select("video_id", "comp").distinct().join(tops, ["video_id", "comp"], "left").withColumn("top", F.coalesce("top", "comp"))
    cores = cores.withColumn("label", F.dense_rank().over(Window.partitionBy("video_id").orderBy("top")) - 1)  # a row a component of a block
    labels = materialise(cores.select("video_id", "comp", "label"), "components")
    border = found.where("border is not null").select("video_id", F.col("border").alias("det_ord"), F.col("u").alias("comp")).join(labels, ["video_id", "comp"])
    border = border.groupBy("video_id", "det_ord").agg(F.min("label").alias("near"))
    rows = known.select("video_id", "det_ord", "comp").join(labels, ["video_id", "comp"], "left").join(border, ["video_id", "det_ord"], "left")
    return rows.select("video_id", "det_ord", F.coalesce("label", "near", F.lit(-1)).cast("int").alias("label"))


def dbscan(vectors: np.ndarray, eps: float = EPS, min_samples: int = MIN_SAMPLES, block: int = 1024) -> np.ndarray:
    """Labels of rows in order, by the same definition."""
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
    floor, n = cosine_floor(eps), len(unit)

    def near(rows: np.ndarray) -> np.ndarray:
        hit = unit[rows] @ unit.T >= floor
        hit[np.arange(len(rows)), rows] = True
        return hit

    counts = np.concatenate([near(np.arange(at, min(n, at + block))).sum(axis=1) for at in range(0, n, block)]) if n else np.zeros(0)
    core, labels, label = counts >= min_samples, np.full(n, -1), 0
    for seed in range(n):
        if not core[seed] or labels[seed] >= 0:
            continue
        labels[seed], front = label, np.array([seed])
        while len(front):
            hit = np.zeros(n, bool)
            for at in range(0, len(front), block):
                hit |= near(front[at : at + block]).any(axis=0)
            fresh = np.flatnonzero(hit & (labels < 0))
            labels[fresh] = label
            front = fresh[core[fresh]]
        label += 1
    return labels


def clusters_grouped(points: DataFrame, eps: float = EPS, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """The same labels, each video in one task; for many videos of moderate size."""

    def run(got):
        got = got.sort_by("det_ord")
        vectors = np.array(got["embedding"].to_pylist(), dtype=np.float64).reshape(got.num_rows, -1)
        return pa.table({"video_id": got["video_id"], "det_ord": got["det_ord"], "label": pa.array(dbscan(vectors, eps, min_samples), pa.int32())})

    kind = points.schema["video_id"].dataType.simpleString()
    return points.select("video_id", F.col("det_ord").cast("long").alias("det_ord"), "embedding").groupBy("video_id").applyInArrow(run, f"video_id {kind}, det_ord long, label int")
