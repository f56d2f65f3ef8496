"""Phrase collocations against plain counting."""

import collections
import random
import re

import pytest
from tables import awkward, empty

from framequarry.llm import collocations


def plain_collocations(rows, least=30, percent=80, first=2000):
    total, f = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    f[lang, tuple(words[i : i + n])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    most = collections.Counter()
    for (lang, p), a in found.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                most[lang, p[i : i + n]] = max(most[lang, p[i : i + n]], a)
    kept = collections.defaultdict(list)
    for (lang, p), a in found.items():
        if 100 * most[lang, p] < percent * a:
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            kept[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, got in kept.items() for i, (s, a, p, l, r) in enumerate(sorted(got)[:first]))


def rows_of(found):
    assert found.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *((c, "bigint") for c in ("a", "l", "r", "n", "score"))]
    return sorted(tuple(r) for r in found.collect())


def texts(seed, count):
    rng = random.Random(seed)
    words = ["The", "of", "new", "york", "été", "x-ray", "日本", "a b", "City", "hall", "one", "two"]
    fixed = ["new york city hall", "x-ray of the été", "one two one two one two"]
    ends = [". ", ", ", "\n", "; ", " \t ", "\r\n", "! ", " "]
    return [(rng.choice(["en", "fr", None]), "".join(rng.choice(fixed + [rng.choice(words)] * 3) + rng.choice(ends) for _ in range(rng.randint(0, 60)))) for _ in range(count)]


@pytest.mark.parametrize("chunk", [37, 1 << 20])
@pytest.mark.parametrize("first", [7, 2000])
def test_plain_counting(spark, chunk, first):
    rows = texts(4, 300) + [("fr", None), ("en", ""), ("fr", " , .")]
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    got = rows_of(collocations.collocations(frame, first=first, chunk=chunk))
    assert got == plain_collocations(rows, first=first) and len(got) > 20


def test_long_pieces_and_copies(spark):
    """A piece of many chunks, and a piece that a third of all rows hold."""
    rows = [("en", "round and round it goes " * 2000), *[("de", "immer wieder das gleiche Lied")] * 500, *texts(5, 100)]
    assert rows_of(collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), chunk=1000)) == plain_collocations(rows)


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_map_of_pairs_of_any_size(spark, monkeypatch, bits):
    """A map far too small lets every window travel; results are the same."""
    monkeypatch.setattr(collocations, "MAP_BITS", bits)
    rows = texts(6, 200)
    assert rows_of(collocations.collocations(spark.createDataFrame(rows, "lang string, text string"))) == plain_collocations(rows)


def test_exact_beyond_64_bits(spark):
    big = 1 << 62
    counts = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 3)], collocations.COUNT_SCHEMA)
    got = collocations.scored(counts).collect()
    assert [(r["a"], r["l"], r["r"], r["score"]) for r in got] == [(big - 3, big, big - 1, 2_000_000 * (big - 3) // (2 * big - 1))]


def test_awkward_rows(spark):
    from tables import TEXTS

    assert rows_of(collocations.collocations(awkward(spark))) == plain_collocations([("en", t) for _, t, _ in TEXTS])
    assert rows_of(collocations.collocations(empty(spark))) == []
