"""Near-duplicates in crowded regions: the windows of the forest leave pairs out, the exact join of their rows does not."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from test_models import exact

from framequarry.llm import near_dedup


def changed(words, places, tag):
    out = list(words)
    for p in places:
        out[p] = f"{tag}at{p}"
    return out


def components(spark, texts):
    rows = [(i, " ".join(words)) for i, words in enumerate(texts)]
    got = near_dedup.near_duplicate_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == exact(rows, 3, 85)
    return {r["doc_id"]: r["component_id"] for r in got}


def test_one_link_into_a_crowd(spark):
    """Each of 40 documents is at 0.83 from a crowd's base and reaches the similarity with one of its members only."""
    base = [f"w{i}" for i in range(200)]
    places = range(5, 65, 10)
    outside = [changed(base, places, f"x{k}") for k in range(40)]
    bridges = [base[:5] + [f"x{k}at5"] + base[6:] for k in range(40)]
    crowd = [changed(base, [70 + i % 120], f"m{i}") for i in range(600)]
    found = components(spark, [base, *crowd, *bridges, *outside])
    assert set(found.values()) == {0}


def test_one_link_between_crowds(spark):
    """Pairs of groups of hundreds, at 0.83 to each other, of which one pair of members reaches the similarity."""
    texts, pairs = [], []
    for k in range(4):
        shared = [f"p{k}w{i}" for i in range(182)]
        one, two = (shared + [f"p{k}g{g}w{i}" for i in range(18)] for g in range(2))
        first = len(texts)
        for g, base in enumerate((one, two)):
            texts += [base, *(changed(base, [10 + i % 160], f"p{k}m{g}i{i}") for i in range(300))]
        texts.append(one[:192])
        pairs.append((first, len(texts)))
    rows = [(i, " ".join(words)) for i, words in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicate_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: first for first, end in pairs for i in range(first, end)}


@pytest.mark.parametrize("width", [4, 200])
def test_pairs_inside_one_crowd(spark, width):
    """5,000 near copies at 0.69 to 0.83 to each other, of which each two make a component of their own, at any number of
    partitions; and cells of fewer rows than the crowd has."""
    base = [f"w{i}" for i in range(200)]
    rng = random.Random(3)
    rows = []
    for k in range(2500):
        one = changed(base, rng.sample(range(3, 195, 5), 6), f"k{k}")
        rows += [(k, " ".join(one)), (10_000 + k, " ".join(changed(one, [1], f"z{k}")))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(width))
    try:
        got = near_dedup.near_duplicate_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: d % 10_000 for d, _ in rows}


def test_cells_hold_every_pair_once(monkeypatch):
    """All pairs of different components of one shingle, whatever the numbers of salts and parts."""
    rng = np.random.default_rng(4)
    for rows, main, salts, parts in ((40, 15, 1, 1), (60, 20, 3, 4), (50, 0, 2, 5), (30, 29, 4, 2)):
        rep = np.arange(rows) * 7
        component = np.where(np.arange(rows) < main, -1, rng.integers(0, 12, rows))
        outside = component != -1
        part = np.where(outside, rng.integers(0, parts, rows), -1)
        salt = rng.integers(0, salts, rows)
        found = collections.Counter()
        for cell in range(salts * parts + parts * parts):
            if cell < salts * parts:
                here = np.where(outside, part == cell % parts, (salt == cell // parts))
            else:
                low, high = divmod(cell - salts * parts, parts)
                here = outside & (low < high) & ((part == low) | (part == high))
            mine = np.flatnonzero(here)
            if len(mine) < 2:
                continue
            own = {"rep": rep[mine], "component": component[mine], "n": np.full(len(mine), 9), "parity": np.zeros((len(mine), 1), np.uint64), "outside": outside[mine], "part": part[mine], "cell": cell, "salts": salts, "parts": parts}
            for i, j, _ in near_dedup.pairs_of_cell(own, 85):
                found.update(frozenset((int(mine[a]), int(mine[b]))) for a, b in zip(i, j))
        want = {frozenset((a, b)) for a in range(rows) for b in range(a) if component[a] != component[b]}
        assert set(found) == want and max(found.values(), default=1) == 1


def test_borders_span_small_partitions():
    assert near_dedup.borders({0: 32, 3: 32}) == [(0, 0, 3), (3, 1, 3)]
    got = near_dedup.borders({0: 32, 1: 5, 2: 5, 3: 32})
    assert {(p, s) for p, s, b in got if b == 1} == {(0, 0), (1, 1), (2, 1), (3, 1)}
    assert {(p, s) for p, s, b in got if b == 3} == {(2, 0), (1, 0), (0, 0), (3, 1)}


@pytest.mark.parametrize("chunk", [100, 1 << 15])
def test_chunks_give_the_pairs_of_the_whole(monkeypatch, chunk):
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(8)
    rows, width = 3000, 4 * near_dedup.DEPTH
    key = rng.integers(0, 2, (rows, width + 1)).astype(np.uint8)
    key[:, :9] = 0  # crowded regions of every depth
    key[500:900] = key[500]
    key = key[np.lexsort(key.T[::-1])]
    bits = rng.integers(0, 256, (rows, near_dedup.MINHASHES // 8)).astype(np.uint8)
    bits[:] = bits[0]
    bits[:, 0] = rng.integers(0, 256, rows)
    table = pa.table({"key": [bytes(k) for k in key], "rep": np.arange(rows), "n": np.full(rows, 100), "bits": [bytes(b) for b in bits]})
    whole = {(int(a), int(b)) for i, j, _ in near_dedup.pairs_in_order(near_dedup.arrays_of(table), 0.85) for a, b in zip(i, j)}
    parts, crowded = set(), []
    for part, low, high in near_dedup.chunks(table.to_batches(max_chunksize=64)):
        own = near_dedup.arrays_of(part)
        for i, j, _ in near_dedup.pairs_in_order(own, 0.85, low, high):
            parts |= {(int(own["rep"][a]), int(own["rep"][b])) for a, b in zip(i, j)}
        crowded += own["rep"][low:high][near_dedup.crowded_rows(own["key"])[low:high]].tolist()
    assert parts == whole
    assert crowded == np.flatnonzero(near_dedup.crowded_rows(near_dedup.arrays_of(table)["key"])).tolist()
