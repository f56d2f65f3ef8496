"""Texts of a million characters of every awkward kind, through every operator, against plain versions."""

import hashlib
import re
import time

import numpy as np
from test_documents import BASE, WORD, base_counts
from test_tokens import library

from framequarry.llm import audio, bpe, licenses, near_dedup, pii, quality, sharding, toxicity

N = 1_000_000
TEXTS = ["x" * N, " " * N, "1" * N, "é" * N, "a\n" * (N // 2), "+1 " * (N // 3), "1." * (N // 2), "a@b." * (N // 4), " ".join(f"w{i}" for i in range(N // 8))]


def test_every_operator(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(len(TEXTS)).cache()
    began = time.time()
    tok = library("word_bpe_49k.json")
    for r in bpe.encode_digests(docs).collect():
        ids = tok.encode(TEXTS[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert {r["doc_id"]: r["n_bytes"] for r in audio.media_digests(docs).collect()} == {i: len(t.encode()) for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: tuple(r)[1:7] for r in quality.judge_digests(docs).collect()} == {i: base_counts(t) for i, t in enumerate(TEXTS)}
    shingles = {i: len({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))}) if (w := WORD.findall(t)) else 0 for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["n_shingles"] for r in near_dedup.near_duplicate_digests(docs).collect()} == shingles
    model = toxicity.train(["one bad", "two good"] * 20, [1, 0] * 20)
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, model).collect())
    assert sorted(r["size"] for r in sharding.shard_digests(docs).collect()) == sorted(len(t.encode()) + 1 for t in TEXTS)
    # The plain patterns backtrack without end on most of these; only two texts hold anything, of one kind each.
    for r in pii.find_digests(docs).collect():
        text, spans = TEXTS[r["doc_id"]], []
        for kind, sign in (("email", "@"), ("ip", "1.1")):
            if sign in text:
                spans = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(BASE[kind], text)]
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
    words = {i: len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)) for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["n_words"] for r in licenses.scan_digests(docs).collect()} == words
    docs.unpersist()
    assert time.time() - began < 400
