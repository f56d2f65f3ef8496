"""Connected components: local contraction, then alternating star contraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framequarry.runtime import checkpointed

#: Edges that one task contracts in memory, about 100 MB.
LOCAL_EDGES = 1_000_000


def contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """Every task's edges (u, v) replaced by a star per component that they make: each node with its least one."""

    def run(batches):
        parent: dict = {}

        def top(node):
            while parent[node] != node:
                parent[node] = parent[parent[node]]
                node = parent[node]
            return node

        kinds = None
        for batch in batches:
            kinds = [c.type for c in batch.columns]
            columns = [c.to_pylist() for c in batch.columns]
            if pa.types.is_struct(kinds[0]):
                columns = [[tuple(x.values()) for x in c] for c in columns]
            for u, v in zip(*columns):
                parent.setdefault(u, u)
                parent.setdefault(v, v)
                a, b = top(u), top(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        if not parent:
            return
        back = (lambda x: dict(zip([f.name for f in kinds[0]], x))) if pa.types.is_struct(kinds[0]) else (lambda x: x)
        nodes = list(parent)
        for at in range(0, len(nodes), 1 << 16):
            part = nodes[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([back(x) for x in part], kinds[0]), pa.array([back(top(x)) for x in part], kinds[0])], names=["u", "v"])

    return edges.coalesce(tasks).mapInArrow(run, edges.schema)


def connected_components(edges: DataFrame, left: str, right: str, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) for every end of an edge; component is the least node reachable.

    Tasks of at most about local_edges edges contract what they hold; one task's stars are the answer, those of several
    go on to alternating star contraction: large star links every greater neighbour of a node to the node's least
    neighbour, small star links the node itself and its lesser neighbours to it, and a few rounds leave each component
    a star. Minima are partial aggregates and neighbours meet them by joins that can be split, so a hub does not gather
    in one task; each round is checkpointed. Null ends are dropped; self links keep their node.
    """
    pairs = checkpointed(edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null"))
    tasks = max(1, -(-pairs.count() // local_edges))
    stars = contracted(pairs, tasks)
    if tasks == 1:
        return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    stars = checkpointed(stars)
    nodes = stars.where("u = v").select("u").distinct()
    current = checkpointed(stars.where("u <> v").distinct())
    before = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = checkpointed(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        current = checkpointed(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    tops = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    found = current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
    alone = nodes.select(F.col("u").alias("node")).join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(alone)
