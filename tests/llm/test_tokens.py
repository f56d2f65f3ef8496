"""Encoding and packing against the tokenizers library."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tables import TEXTS, awkward, empty, texts_of

from framequarry.llm import bpe, packing


def library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def test_encode_digests_match_library(spark):
    tok = library("word_bpe_49k.json")
    want = collections.Counter()
    for doc_id, text in texts_of(TEXTS):
        ids = tok.encode(text, add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False)
        want[(doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())] += 1
    got = collections.Counter(tuple(r) for r in bpe.encode_digests(awkward(spark)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == want


def test_small_blocks_and_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 200)
    assert sorted(map(tuple, bpe.encode_digests(awkward(spark)).collect()), key=repr) == sorted(map(tuple, bpe.encode_digests(awkward(spark).coalesce(1)).collect()), key=repr)


def test_splitter_on_random_text():
    tok = library("word_bpe_49k.json")
    split, encoder = bpe.Splitter(bpe.default_tokenizer()), bpe.WordEncoder(bpe.default_tokenizer())
    rng = random.Random(5)
    pool = "aZ é'İßſǅ  \t\n\r\x0b\x1c\x85\xa0 ́१Ⅷ²½.,!<|>_-0123sdtΣςمर" + "ABCdef"
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))
        words = split.split(text)
        ids = sum(encoder.encode(words), []) if words else []
        assert ids == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_decode_joins_pieces(spark):
    rows = spark.createDataFrame([(1, [320, 1125]), (1, [320, 1125]), (2, []), (3, None), (None, [49407, 320])], "doc_id long, ids array<int>")
    tok = library("word_bpe_49k.json")
    got = sorted(map(tuple, bpe.decode(rows).collect()), key=repr)
    want = [(d, tok.decode(i or [], skip_special_tokens=False)) for d, i in [(1, [320, 1125])] * 2 + [(2, []), (3, []), (None, [49407, 320])]]
    assert got == sorted(want, key=repr)


def test_byte_bpe_matches_library():
    tok, own = library("byte_bpe_50k.json"), packing.byte_bpe(packing.default_tokenizer(), packing.default_ranks())
    rng = random.Random(6)
    pool = "ab é'  \t\n\r\x0b\x1c\x85\xa0 ́१Ⅷ²½.,!<|>_-01日本👍sdtre"
    plain = [c for c in pool if c < "\u0250"]
    texts = [t for _, t in texts_of(TEXTS)] + ["".join(rng.choice(p) for _ in range(rng.randint(0, 40))) for p in (pool, plain) for _ in range(2000)]
    texts += [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}." for c in range(0x250)]
    for text in texts:
        assert own.encode(text) == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text[:80])


def test_packing_of_hot_ids_and_endless_texts(spark):
    """20,000 rows of one id and as many of none, and millions of equal characters: no group beyond twice GROUP_PIECES."""
    rows = [(7, "one two three")] * 20_000 + [(None, "")] * 20_000 + [(8, " " * 2_000_000), (9, "x" * 1_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_digests(docs).collect()
    groups = collections.Counter(r["sequence_id"] >> 32 for r in got)
    assert max(groups.values()) <= 2 * packing.GROUP_PIECES
    check_packing(got, [(i, t) for i, t in rows])


def check_packing(rows, texts, window=packing.WINDOW):
    tok = library("byte_bpe_50k.json")
    ids = collections.defaultdict(list)
    for doc_id, text in texts:
        ids[doc_id].append(tok.encode(text, add_special_tokens=False).ids + [1])
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc_id, copies in ids.items():
        want = collections.Counter((s, min(window, len(i) - s), zlib.crc32(np.array(i[s : s + window], "<u4").tobytes()), len(i)) for i in copies for s in range(0, len(i), window))
        assert want == collections.Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in by_doc[doc_id])
    assert set(by_doc) == set(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window


def test_packing(spark):
    check_packing(packing.pack_digests(awkward(spark)).collect(), texts_of(TEXTS))


def test_packing_keeps_ids(spark):
    rows = packing.pack(awkward(spark)).select("*", F.crc32("ids").alias("ids_crc32")).collect()
    check_packing(rows, texts_of(TEXTS))


@pytest.mark.parametrize("window", [8, 64])
def test_best_fit_matches_brute_force(window):
    rng = random.Random(window)
    for _ in range(50):
        lengths = sorted((rng.randint(1, window) for _ in range(rng.randint(0, 60))), reverse=True)
        sequences, offsets = packing.best_fit_decreasing(lengths, window)
        free: list[int] = []
        for n, sequence, offset in zip(lengths, sequences, offsets):
            fits = [c for c in free if c >= n]
            if fits:
                assert window - offset == min(fits)
                assert free[sequence] == min(fits)
            else:
                assert offset == 0 and sequence == len(free)
                free.append(window)
            free[sequence] -= n


def test_empty_tables(spark):
    assert bpe.encode_digests(empty(spark)).count() == 0
    assert packing.pack_digests(empty(spark)).count() == 0
