"""Clusters by the pivot index against plain density clustering."""

import numpy as np
import pytest

from framequarry.operators import clustering, metric


def cloud(rng, people, each, spread, dims=32, noise=0):
    """Unit vectors around `people` directions, and some in no direction."""
    centres = rng.standard_normal((people, dims))
    rows = np.repeat(centres / np.linalg.norm(centres, axis=1, keepdims=True), each, axis=0)
    rows = rows + spread / np.sqrt(dims) * rng.standard_normal(rows.shape)
    rows = np.concatenate([rows, rng.standard_normal((noise, dims))])
    return rng.permutation(rows)


def frame(spark, videos):
    rows = [(v, int(i), [float(x) for x in r]) for v, vectors in videos.items() for i, r in enumerate(vectors)]
    return spark.createDataFrame(rows, "video_id string, det_ord long, embedding array<float>").repartition(6)


def labels_of(found):
    out = {}
    for r in found.collect():
        assert (r["video_id"], r["det_ord"]) not in out
        out[r["video_id"], r["det_ord"]] = r["label"]
    return out


@pytest.mark.parametrize("eps, min_samples, spread", [(0.65, 3, 0.4), (0.65, 3, 0.75), (0.5, 6, 0.45), (1.2, 3, 0.9), (1.5, 3, 1.0)])
def test_many_blocks_equal_plain_clustering(spark, eps, min_samples, spread):
    rng = np.random.default_rng(int(100 * spread))
    videos = {"a": cloud(rng, 12, 40, spread, noise=60), "b": cloud(rng, 1, 300, spread), "c": cloud(rng, 2, 2, spread), "d": np.zeros((5, 32))}
    videos["a"][7] = 0
    points = frame(spark, videos)
    want = {}
    for v, vectors in videos.items():
        for i, label in enumerate(clustering.dbscan(vectors.astype(np.float32).astype(np.float64), eps, min_samples)):
            want[v, i] = label
    for block in (16, 1024):
        assert labels_of(clustering.clusters(points, eps, min_samples, block)) == want


def test_chain_over_blocks(spark):
    """A cluster that is a long chain, so components meet over many blocks, and border points at both its ends."""
    angle = np.concatenate([np.arange(0, 3.0, 0.01), [3.3, -0.3]])
    vectors = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    points = frame(spark, {"a": vectors})
    want = {("a", i): label for i, label in enumerate(clustering.dbscan(vectors.astype(np.float32).astype(np.float64), 0.32, 4))}
    assert labels_of(clustering.clusters(points, 0.32, 4, 8)) == want and set(want.values()) == {0}


def test_points_travel_once_for_two_tiles(spark):
    """Vectors that no pivot tells apart, as of many strangers: all blocks meet, but points travel once for every two tiles."""
    vectors = np.random.default_rng(5).standard_normal((3000, 64))
    points = frame(spark, {"a": vectors})
    want = {("a", i): label for i, label in enumerate(clustering.dbscan(vectors.astype(np.float32).astype(np.float64), 1.1))}
    assert labels_of(clustering.clusters(points, 1.1, block=64)) == want and len(set(want.values())) > 2
    met = clustering.meetings(points, 1.1, block=64)
    blocks, tiles = met.blocks.count(), met.blocks.select("tile").distinct().count()
    assert tiles <= clustering.TILES and met.pairs.count() > 0.3 * blocks * (blocks - 1) / 2
    travelling = met.points.select("video_id", "block", "det_ord")
    trips = clustering.meeting_tiles(travelling, met.pairs, ["det_ord"], lambda rows, pairs: rows.select(["det_ord"]), "det_ord long").count()
    assert trips <= (tiles + 1) * 3000


def dense(spark, people, count, spread):
    """A video of many vectors made in Spark, from seeds."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_numpy()
            rows = []
            for i in ids:
                centre = np.random.default_rng(int(i) % people).standard_normal(32)
                rows.append(centre / np.linalg.norm(centre) + spread / np.sqrt(32) * np.random.default_rng(10**6 + int(i)).standard_normal(32))
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(ids), pa.int64()), pa.array(ids), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], names=["video_id", "det_ord", "embedding"])

    return spark.range(0, count, 1, 8).mapInArrow(run, "video_id long, det_ord long, embedding array<double>")


def test_one_dense_cluster_writes_no_pairs(spark):
    """4,000 points of one person: what the meetings write is below two rows a point."""
    points = dense(spark, 1, 4000, 0.45)
    met = clustering.meetings(points)
    floor = metric.cosine_floor(clustering.EPS)
    written = clustering.forest(clustering.core_points(met, floor, 3), met, floor).count() + met.sure.count()
    assert written < 8000 and clustering.clusters(points).where("label = 0").count() == 4000


def test_a_long_video_compares_a_part_of_its_pairs(spark):
    """100,000 points of fifty persons: about a tenth of all pairs are compared, and clusters are the persons."""
    count, people = 100_000, 50
    points = dense(spark, people, count, 0.35)
    assert clustering.meetings(points).comparisons() < 0.12 * count * count / 2
    found = clustering.clusters(points).selectExpr("label", f"det_ord % {people} as person").distinct().collect()
    assert len(found) == people and {r["label"] for r in found} == set(range(people))
