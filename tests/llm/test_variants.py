"""Spelling variants against a plain search of all pairs of words."""

import collections
import random
import re
import zlib

import pytest
from comparing import SMALL
from tables import TEXTS, awkward, empty

from framequarry.llm import variants
from framequarry.runtime import table


def plain_words(rows, least=5):
    total = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= least}


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def plain_variants(words):
    near = collections.defaultdict(list)
    by_length = collections.defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    for length, same in by_length.items():
        for i, u in enumerate(same):
            for v in same[i + 1 :] + by_length.get(length + 1, []):
                if one_edit(u, v):
                    near[u].append(v)
                    near[v].append(u)
    form = {w: f for w, got in near.items() for f in [min(got, key=lambda x: (-words[x], x))] if words[f] >= 5 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items())


def rows_of(found):
    assert found.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    return sorted(tuple(r) for r in found.collect())


def test_query_equals_all_pairs(spark):
    from framequarry.llm import queries

    rows = [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").collect()]
    got = rows_of(queries.queries()["op13_variants"](spark, SMALL))
    assert got == plain_variants(plain_words(rows)) and sum(r[4] for r in got) > 20


@pytest.mark.parametrize("block", [2, 5, 64])
def test_blocks_of_any_size(spark, block):
    """Few letters, so that halves are shared by many words and blocks are subdivided again and again."""
    rng = random.Random(block)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 9))): rng.randint(5, 400) for _ in range(900)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = variants.near_words(frame, block=block).collect()
    want = {(u, v, n) for u in words for v, n in words.items() if u != v and one_edit(u, v)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_chains_and_ties(spark):
    texts = ["spelling " * 3000, "spellin " * 500, "spelin " * 60, "spelinx " * 7, "harbour " * 30, "harbous " * 30, "harbouy " * 6, "Ältere ältere Ältere " * 9]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "Spelling " * 5), (99, None), (100, "")]
    got = rows_of(variants.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == plain_variants(plain_words(rows))
    by_word = {r[0]: r for r in got}
    assert by_word["spelinx"][1:3] == ("spelin", "spelling") and by_word["harbouy"][1] == "harbour"


def test_letters_that_slip(spark):
    """Of many documents, about one in 199 loses a letter of the same word."""
    rows = [(i, "Überraschung lighthouse") for i in range(6000)]
    got = rows_of(variants.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == plain_variants(plain_words(rows)) and len(got) > 2


def test_awkward_rows(spark):
    assert rows_of(variants.variants(awkward(spark))) == plain_variants(plain_words([(i, t) for i, t, _ in TEXTS]))
    assert rows_of(variants.variants(empty(spark))) == []
