"""The n-gram join against all pairs, and its parts."""

import collections
import random

import numpy as np
import pytest
from tables import TEXTS, awkward, empty
from test_models import exact

from framequarry.llm import near_dedup, ngram_join


def found(spark, rows, words_per=3, percent=90):
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), words_per, percent)
    assert got.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    return collections.Counter(tuple(r) for r in got.collect())


def copies(rng, base, most):
    out = list(base)
    for _ in range(rng.randrange(0, most + 1)):
        at = rng.randrange(len(out))
        out[at : at + rng.choice([0, 1, 1])] = [f"x{rng.randrange(10**6)}"]
    return out


@pytest.mark.parametrize("words_per, percent", [(3, 90), (5, 80), (1, 60)])
def test_all_pairs(spark, words_per, percent):
    rng = random.Random(percent)
    rows = [(i, t) for i, t, _ in TEXTS]
    for g in range(14):
        base = [f"g{g}w{rng.randrange(300)}" for _ in range(rng.randint(3, 150))]
        rows += [(1000 + 100 * g + k, " ".join(copies(rng, base, max(1, len(base) // 10)))) for k in range(rng.choice([2, 3, 8, 30]))]
    assert found(spark, rows, words_per, percent) == exact(rows, words_per, percent)


def test_crowd_with_stragglers(spark):
    """One large group of near copies, some of which reach the similarity with few of its members only."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(180)]
    rows = [(k, " ".join(copies(rng, base, rng.choice([1, 2, 3, 4])))) for k in range(700)]
    assert found(spark, rows) == exact(rows, 3, 90)


def test_template_pages(spark):
    """Pages of a shared template, whose own words come first in the columns' order: no pair is listed for them."""
    shared = [f"t{i}" for i in range(87)]
    rows = [(k, " ".join([f"own{k}n{i}" for i in range(13)] + shared)) for k in range(1500)] + [(5000, " ".join([f"own3n{i}" for i in range(13)] + shared + ["end"]))]
    got = found(spark, rows)
    assert got == collections.Counter({(k, 98, k): 1 for k in range(1500)} | {(5000, 99, 3): 1})


def test_sizes_and_borders(spark):
    """A text inside longer ones, at sizes on either side of the bound, over many partitions."""
    words = [f"w{i}" for i in range(222)]
    rows = [(k, " ".join(words[: 202 - k])) for k in range(30)] + [(40 + k, " ".join(words[k:])) for k in range(20)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    try:
        assert found(spark, rows) == exact(rows, 3, 90)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_accumulation_equals_plain_overlap(monkeypatch):
    monkeypatch.setattr(ngram_join, "COLUMN_BLOCK", 16)
    rng = np.random.default_rng(2)
    for _ in range(300):
        pool = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
        x, y = (np.sort(rng.choice(pool, rng.integers(1, len(pool)), replace=False)) for _ in range(2))
        if rng.random() < 0.6:
            y = np.delete(x, rng.integers(0, len(x), rng.integers(0, max(1, len(x) // 9)))) if len(x) > 3 else x
        both = len(np.intersect1d(x, y))
        assert ngram_join.reaches(x, y, ngram_join.needed_overlap(len(x), len(y), 90)) == (100 * both >= 90 * (len(x) + len(y) - both))


def test_first_columns_follow_one_order():
    rng = np.random.default_rng(5)
    for _ in range(200):
        x = np.unique(rng.integers(0, 1 << 40, rng.integers(1, 60)).astype(np.uint64))
        often = rng.integers(0, 4, len(x))
        for count in range(1, len(x) + 1):
            assert ngram_join.first_columns(x, often, count).tolist() == [int(v) for _, v in sorted(zip(often, x))[:count]]


def test_small_cells_at_once():
    """The pairs of many small cells, as each cell on its own gives them."""
    rng = np.random.default_rng(6)
    sizes = rng.integers(2, near_dedup.SMALL + 1, 60)
    cell_of, rows = np.repeat(np.arange(60), sizes), int(sizes.sum())
    own = {"component": rng.integers(0, 5, rows), "n": rng.integers(80, 120, rows), "pos": rng.integers(0, 20, rows), "parity": rng.integers(0, 3, (rows, 8)).astype(np.uint64), "rep": np.arange(rows)}
    got = {(int(a), int(b)) for i, j, _ in near_dedup.pairs_of_small_cells(own, cell_of, 85) for a, b in zip(i, j)}
    want = set()
    for c in range(60):
        at = np.flatnonzero(cell_of == c)
        one = {k: v[at] for k, v in own.items()} | {"outside": own["component"][at] != 0, "cell": 0, "salts": 1, "parts": 1, "part": np.where(own["component"][at] != 0, 0, -1)}
        want |= {(min(int(at[a]), int(at[b])), max(int(at[a]), int(at[b]))) for i, j, _ in near_dedup.pairs_of_cell(one, 85) for a, b in zip(i, j)}
    assert got == want and want


def test_bounds_are_exact():
    for percent in (60, 85, 90):
        for n in range(1, 60):
            for m in range(n, 60):
                needed = int(near_dedup.least_overlap(n, m, percent))
                assert [100 * o >= percent * (n + m - o) for o in range(n + 1)] == [o >= needed for o in range(n + 1)]
                if needed <= n:
                    assert max(n - needed, m - needed) < max(ngram_join.prefix_length(n, percent), ngram_join.prefix_length(m, percent))


def test_awkward_rows(spark):
    got = ngram_join.jaccard_digests(awkward(spark)).collect()
    assert collections.Counter(tuple(r) for r in got) == exact([(i, t) for i, t, _ in TEXTS], 3, 90)
    assert ngram_join.jaccard_digests(empty(spark)).count() == 0
