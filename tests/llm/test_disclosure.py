"""Terms count and are marked over whole texts, wherever they stand and however short they are."""

import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from framequarry.llm import pii


@pytest.mark.parametrize("buckets", [pii.BUCKETS, 3])
def test_terms_far_from_the_entity(spark, monkeypatch, buckets):
    monkeypatch.setattr(pii, "BUCKETS", buckets)
    gap = " ".join(["filler"] * 60)
    rows = [(i, f"Zed x7 {gap} text{'abcd'[i]} from zed@corp.org {gap} zed's") for i in range(4)]
    rows += [(9, f"only Zed {gap}"), *((10 + i, f"{gap} more{i}") for i in range(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"].split(",") for r in pii.find_digests(docs).collect()}
    for i in range(4):
        text = rows[i][1]
        end = text.rindex("zed")
        email = text.index("zed@")
        assert {"term:0:3", "term:4:6", f"term:{end}:{end + 3}"} <= set(found[i])
        assert f"term:{email}:{email + 3}" not in found[i]
    assert found[9] == ["term:5:8"]
    assert all(found[10 + i] == [""] for i in range(60))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[9] == f"only [TERM] {gap}" and "Zed" not in clean[0] and "x7" not in clean[0]


def test_endless_matches(spark):
    """100,000 addresses in one text: counted, located and replaced in a time that is about linear."""
    many = " ".join(f"a{i}@b.cd" for i in range(100_000))
    text = f"x {many} y"
    docs = spark.createDataFrame([(1, text), (2, "plain")], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in pii.find_digests(docs).collect()}
    assert time.time() - began < 30  # about 6 on eight cores
    want = ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(r"\S+@\S+", text))
    assert got[1]["n_email"] == 100_000 and got[1]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean == {1: "x " + " ".join(["[EMAIL]"] * 100_000) + " y", 2: "plain"}


def test_lists_of_addresses(spark):
    """Two near-copies of a list of 20,000 addresses: its names disclose them, in a time that is about linear."""
    lists = "\n".join(f"name{i} a{i}@b.cd" for i in range(20_000))
    rows = [(1, f"{lists} first"), (2, f"{lists} second"), (3, "also name7 here"), *((10 + i, f"plain{i} text") for i in range(9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.find_digests(docs).collect()}
    assert time.time() - began < 45
    names = {f"term:{m.start()}:{m.end()}" for m in re.finditer(r"name\d+", rows[0][1])}
    seven = re.search(r"name7\b", rows[0][1])
    # name7 is in three documents of twelve, two of which have the address: log2(2 * 12 / (3 * 2)) / log2(12 / 2) = 0.77.
    want = names - {f"term:{seven.start()}:{seven.end()}"}
    for doc in (1, 2):
        assert {s for s in got[doc] if s.startswith("term")} == want
        assert sum(s.startswith("email") for s in got[doc]) == 20_000
    assert all(got[k] == [""] for k in got if k > 2)


def test_locating_and_merging(spark):
    rng = random.Random(2)
    for n in (1, 2, 63, 64, 65, 500):
        text = "".join(rng.choice(["é", "-", "👍 "]) * rng.randint(1, 3) + "w" * rng.randint(1, 4) for _ in range(n))
        spans, at = [], 0
        for _ in range(n):
            at += rng.randint(0, 4)
            spans.append((at, at + rng.randint(1, 6), str(rng.randint(0, 9))))
        row = spark.createDataFrame([(re.findall("w+", text), re.split("w+", text), sorted(spans))], "m array<string>, p array<string>, s array<struct<start:int,end:int,label:string>>").selectExpr(f"{pii.located('m', 'p')} AS located", f"{pii.merged('s')} AS merged").first()
        assert [tuple(x) for x in row["located"]] == [(m.start(), m.end(), m[0]) for m in re.finditer("w+", text)]
        want = []
        for start, end, label in sorted(spans):
            if want and start < want[-1][1]:
                want[-1] = (want[-1][0], max(want[-1][1], end), want[-1][2])
            else:
                want.append((start, end, label))
        assert [tuple(x) for x in row["merged"]] == want


def test_replacing_across_pieces(spark, monkeypatch):
    monkeypatch.setattr(pii, "PIECE", 8)
    rng = random.Random(3)
    for _ in range(20):
        text = "".join(rng.choice("ab\n👍é ") for _ in range(rng.randint(1, 60)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randint(1, 4)) // 2 * 2))
        spans = [(a, b, "<>") for a, b in zip(cuts[::2], cuts[1::2])]
        if not spans:
            continue
        got = spark.createDataFrame([(text, spans)], "t string, s array<struct<start:int,end:int,label:string>>").selectExpr(f"{pii.replaced('t', 's', 'x.label')} AS r").first()["r"]
        want, at = "", 0
        for a, b, label in spans:
            want, at = want + text[at:a] + label, b
        assert got == want + text[at:]


@pytest.mark.parametrize("seed, lists", [(6, 0), (7, 12), (8, 40)])
def test_strengths_against_plain_counts(spark, seed, lists):
    """lists: texts that hold several entities, in overlapping ranges."""
    rng = random.Random(seed)
    people = [f"p{i}@x.org" for i in range(6)]
    texts = []
    for i in range(300):
        words = [f"w{rng.randint(0, 60)}" for _ in range(12)]
        if rng.random() < 0.4:
            who = rng.randrange(len(people))
            words += [people[who], f"name{who}", f"city{who // 2}"]
        rng.shuffle(words)
        texts.append(" ".join(words))
    for i in range(lists):
        first = rng.randrange(30)
        texts.append(" ".join(f"p{k}@x.org name{k} city{k // 2}" for k in range(first, first + rng.randint(2, 9))) + f" w{rng.randint(0, 60)}")
    people += [f"p{k}@x.org" for k in range(6, 40)]
    texts += texts[:40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string").withColumn("key", F.md5("t"))
    named = pii.base_spans(docs, ["doc_id", "key"])
    found = named.select("key", F.transform("s_email", lambda x: F.concat(F.lit("email:"), x["text"])).alias("entity_names"), pii.words_of("t").alias("words")).where("size(entity_names) > 0")
    found = found.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("words").alias("words"), F.first("entity_names").alias("entity_names"))
    got = {r["term"]: r["strength"] for r in pii.disclosures(found, docs, len(texts)).collect()}
    n, has = len(texts), [set(re.findall(r"[a-z0-9]+", t)) for t in texts]
    want = {}
    for who in people:
        holding = [who in t.split() for t in texts]
        n_e, kinds = sum(holding), len({t for t, h in zip(texts, holding) if h})
        for term in set().union(*has):
            n_t, n_te = sum(term in h for h in has), sum(term in h and e for h, e in zip(has, holding))
            seen = len({t for t, h, e in zip(texts, has, holding) if e and term in h})
            if kinds >= pii.SUPPORT and seen >= pii.SUPPORT and n_e < n:
                strength = math.log2(n_te * n / (n_t * n_e)) / math.log2(n / n_e)
                if strength >= pii.GENERALISE:
                    want[term] = max(want.get(term, 0), strength)
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in want)
    assert want
