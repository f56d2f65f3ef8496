"""Toxicity and near-duplicates."""

import collections
import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from tables import TEXTS, awkward, empty

from framequarry.llm import gru, near_dedup, toxicity


def test_gradients_are_right():
    rng = np.random.default_rng(3)
    p = {k: v.astype(np.float64) for k, v in gru.new_parameters(4, 3, 2, 1).items()}
    x, mask = rng.standard_normal((5, 6, 4)), np.ones((5, 6))
    mask[3:, 2] = 0
    target, weight = (rng.random(6) > 0.5).astype(float), np.ones(6)
    _, g, d_x = gru.gradients(p, x, mask, target, weight)
    p, g = p | {"x": x}, g | {"x": d_x}
    for name in p:
        flat = p[name].reshape(-1)
        for at in rng.integers(len(flat), size=3):
            keep, step, loss = flat[at], 1e-3, []
            for sign in (1, -1):
                flat[at] = keep + sign * step
                loss.append(gru.gradients(p, x, mask, target, weight)[0])
            flat[at] = keep
            assert abs((loss[0] - loss[1]) / (2 * step) - g[name].reshape(-1)[at]) < 2e-3, name


def test_embeddings_are_trained():
    """Gradients of the embeddings by differences, and that training moves those of words and n-grams it meets."""
    rows = made_up(120, 4)
    sample = toxicity.Sample([t for _, t, _ in rows], [y for _, _, y in rows], 0)
    rng = np.random.default_rng(1)
    p = {"chars": rng.standard_normal((toxicity.BUCKETS, toxicity.CHAR_CODE)), "words": rng.standard_normal((toxicity.WORD_BUCKETS, toxicity.WORD_CODE))}
    words, evidence = sample.docs[0][:20], sample.crossed(0)
    v, buckets, of_word = sample.vectors(evidence, words, p)
    d_v = rng.standard_normal(v.shape)
    g = toxicity.embedding_gradients(p, d_v, buckets, of_word, sample.own[words])
    for name, at in (("chars", buckets[3]), ("words", sample.own[words[2]])):
        for c in range(2):
            keep, value = p[name][at, c], []
            for sign in (1, -1):
                p[name][at, c] = keep + sign * 1e-3
                value.append(float((sample.vectors(evidence, words, p)[0] * d_v).sum()))
            p[name][at, c] = keep
            assert abs((value[0] - value[1]) / 2e-3 - g[name][at, c]) < 1e-2
    one = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows])
    rng = np.random.default_rng(0)
    moved = one.parameters["words"][np.unique(sample.own)]
    assert np.abs(moved).max() > 1 and np.isfinite(one.parameters["chars"]).all()


def plain_score(model, words):
    """The worst window's score, word by word and number by number."""
    p = {k: v.astype(float) for k, v in model.parameters.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    best = -np.inf
    for start in toxicity.window_starts(len(words)):
        inputs = []
        for w in words[start : start + toxicity.WINDOW]:
            raw = b"\n" + w.encode() + b"\n"
            grams = []
            for n in toxicity.GRAMS:
                for at in range(len(raw) - n + 1):
                    h = 0
                    for c in raw[at : at + n]:
                        h = (h * 0x01000193 & 0xFFFFFFFF) ^ c
                    h ^= h >> 15
                    h = h * 0x2C1B3C6D & 0xFFFFFFFF
                    grams.append((h ^ (h >> 13)) % toxicity.BUCKETS)
            odds = [float(model.evidence.grams[g]) for g in grams] or [0.0]
            chars = np.mean([p["chars"][g] for g in grams], axis=0) if grams else np.zeros(toxicity.CHAR_CODE)
            inputs.append(np.concatenate([[model.evidence.words.get(w, 0.0), np.mean(odds), max(odds)], chars, p["words"][zlib.crc32(w.encode()) % toxicity.WORD_BUCKETS]]))
        states = [[], []]
        for side, name in enumerate("fb"):
            h = np.zeros(toxicity.HIDDEN)
            for x in inputs if side == 0 else inputs[::-1]:
                a, b = x @ p[f"W{name}"] + p[f"c{name}"], h @ p[f"U{name}"]
                k = toxicity.HIDDEN
                z, r = sigmoid(a[:k] + b[:k]), sigmoid(a[k : 2 * k] + b[k : 2 * k])
                h = (1 - z) * np.tanh(a[2 * k :] + r * b[2 * k :]) + z * h
                states[side].append(h)
        both = np.concatenate([states[0], states[1][::-1]], axis=1)
        s = np.tanh(both @ p["A"]) @ p["v"]
        e = np.exp(s - s.max())
        best = max(best, float((e / e.sum()) @ both @ p["w"] + p["b"][0]))
    return sigmoid(best)


def test_scores_against_a_plain_forward_pass():
    rows = made_up(200, 2)
    model = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows])
    docs = [toxicity.words_of(t.lower()) for _, t, _ in made_up(25, 7)] + [["a"], ["a", "b"] * 40, ["zorkan"] * 49]
    scores, _ = model.score(docs)
    assert np.allclose(scores, [plain_score(model, d) for d in docs], atol=1e-4)
    assert model.score([[]])[0][0] == 0


def test_long_texts_are_sampled_whole(spark):
    text = " ".join(f"w{i}" for i in range(30_000))
    docs = spark.createDataFrame([(1, text), (2, "short text"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    rows, toxic, _ = toxicity.training_sample(docs, labels)
    assert toxic == [1, 0]
    assert [r["text"] for r in rows.orderBy("doc_id").collect()] == [text, "short text"]


def test_toxic_words_amid_long_texts_are_learned(spark):
    """The only toxic words stand once, amid a text of 40,000 characters or more."""
    rng = random.Random(5)
    plain = [f"{a}{b}" for a in ("ran", "ter", "lo", "mi", "sen") for b in ("der", "ka", "pol", "us", "ti")]
    rows = []
    for i in range(150):
        words = [rng.choice(plain) for _ in range(8_000)]
        if i % 3 == 0:
            words[rng.randint(3_500, 4_500)] = "vilething"
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_digests(docs, labels).collect()}
    assert got == {i: y for i, _, y in rows}


def made_up(n, seed):
    rng = random.Random(seed)
    syllables = ["an", "er", "ti", "on", "re", "st", "ou", "le"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 150))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["vilething", "zork" + word()]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_learns_and_holds_out(spark):
    rows = made_up(900, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_digests(docs, labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.93
    # What held-out labels say must not matter.
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    assert {r["doc_id"]: r["score"] for r in toxicity.score_digests(docs, flipped).collect()} == {i: r["score"] for i, r in got.items()}


def test_awkward_texts_score(spark):
    model = toxicity.train([t for _, t, _ in made_up(200, 2)], [y for _, _, y in made_up(200, 2)])
    rows = toxicity.score(awkward(spark), model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    same = {r["score"] for r in rows if r["doc_id"] in (9, 10)}
    assert len(same) == 1
    assert toxicity.score(empty(spark), model).count() == 0


def test_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.score_digests(awkward(spark), labels).collect()
    assert len(rows) == len(TEXTS) and {r["score"] for r in rows} == {0.0}


def test_windows_cover_texts():
    for n in range(0, 200):
        starts = toxicity.window_starts(n)
        covered = set()
        for s in starts:
            covered |= set(range(s, min(n, s + toxicity.WINDOW)))
        assert covered == set(range(n))
        assert all(b - a == toxicity.STRIDE for a, b in zip(starts, starts[1:]))


def exact(rows, words_per, percent):
    sets = []
    for i, (doc_id, text) in enumerate(rows):
        words = (text or "").encode().lower().split()
        n = min(words_per, len(words))
        sets.append({tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set())
    parent = {d: d for d, _ in rows if d is not None}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                continue
            shared = len(sets[a] & sets[b])
            if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = top(rows[a][0]), top(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return collections.Counter((d, len(s), top(d) if d is not None else None) for (d, _), s in zip(rows, sets))


def test_components_match_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, t) for i, t, _ in TEXTS]
    for g in range(12):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.randint(20, 120))]
        for k in range(rng.choice([2, 3, 6, 40])):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((1000 + 100 * g + k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for words_per, percent in ((3, 85), (5, 80)):
        got = near_dedup.near_duplicates(docs, words_per, percent / 100).collect()
        assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == exact(rows, words_per, percent)
        assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_crowded_group(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(300):
        copy = list(base)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(len(copy))] = f"y{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    got = near_dedup.near_duplicate_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == exact(rows, 3, 85)


def test_clashing_columns_and_empty(spark):
    assert near_dedup.near_duplicate_digests(awkward(spark)).count() == len(TEXTS)
    assert near_dedup.near_duplicate_digests(empty(spark)).count() == 0
