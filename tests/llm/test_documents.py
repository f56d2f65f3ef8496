"""Media, quality, licences, sharding and personal data against brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tables import TEXTS, awkward, empty, texts_of

from framequarry.llm import audio, licenses, pii, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_media(spark):
    want = collections.Counter()
    for doc_id, text in texts_of(TEXTS):
        raw = text.encode()
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        media = audio.wav(payload)
        assert audio.samples_of(media) == payload
        want[(doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())] += 1
    rows = audio.media_digests(awkward(spark)).collect()
    assert collections.Counter(tuple(r)[:7] for r in rows) == want
    by_text = collections.defaultdict(set)
    for r in rows:
        by_text[r["payload_sha256"]].add(r["feature"])
    assert all(len(v) == 1 for v in by_text.values())


def test_resampling_and_spans():
    x = np.sin(2 * np.pi * 200 * np.arange(8000) / 8000)
    y = audio.resample(x)
    assert len(y) == 3200
    want = np.sin(2 * np.pi * 200 * np.arange(3200) / 3200)
    lag = max(range(-8, 9), key=lambda k: float(np.dot(np.roll(want, k)[100:-100], y[100:-100])))
    assert np.corrcoef(np.roll(want, lag)[100:-100], y[100:-100])[0, 1] > 0.97
    n, up, down = 37, 2, 5
    bank, z = audio.phases(up, down), np.random.default_rng(0).standard_normal(n)
    width = bank.shape[1]
    padded = np.concatenate([np.zeros(width // 2), z, np.zeros(width)])
    direct = [padded[m * down // up : m * down // up + width] @ bank[m * down % up] for m in range(-(-n * up // down))]
    assert np.allclose(audio.resample(z), direct)
    assert audio.segments(np.array([0, 1, 2, 1, 0, 1, 1, 0, 3.0]), 1, 2) == [(1, 4), (8, 9)]


def plain_mel(payload):
    """Log-mel energies by sums over samples, without blocks, strides or a fast transform."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    up, down, taps = audio.UP, audio.DOWN, 12
    n = taps * max(up, down) + -(taps * max(up, down)) % up
    k = np.arange(n) - (n - 1) / 2
    h = np.sinc(k / max(up, down)) * np.hamming(n)
    h *= up / h.sum()
    width, y = n // up, []
    for m in range(-(-len(x) * up // down)):
        at, phase = divmod(m * down, up)
        taken = [(x[at - width // 2 + t] if 0 <= at - width // 2 + t < len(x) else 0.0) * h[phase + up * (width - 1 - t)] for t in range(width)]
        y.append(sum(taken))
    rate = audio.RATE * up / down
    frames = 1 + max(0, -(-(len(y) - audio.FRAME) // audio.HOP))
    y = np.concatenate([y, np.zeros((frames - 1) * audio.HOP + audio.FRAME - len(y))])
    turn = np.exp(-2j * np.pi * np.outer(np.arange(audio.FRAME // 2 + 1), np.arange(audio.FRAME)) / audio.FRAME)
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(rate / 2) * i / (audio.MELS + 1) / 2595) - 1) for i in range(audio.MELS + 2)]
    out = np.zeros((frames, audio.MELS))
    for f in range(frames):
        power = np.abs(turn @ (y[f * audio.HOP : f * audio.HOP + audio.FRAME] * np.hanning(audio.FRAME))) ** 2
        for b in range(audio.MELS):
            low, mid, high = edges[b : b + 3]
            weights = [max(0, min((i * rate / audio.FRAME - low) / (mid - low), (high - i * rate / audio.FRAME) / (high - mid))) for i in range(len(power))]
            out[f, b] = math.log(float(np.dot(power, weights)) + 1e-6)
    return out


def test_features_against_plain_sums():
    rng = np.random.default_rng(5)
    for size in (64, 128, 1024, 6400):
        payload = rng.integers(0, 256, size).astype(np.uint8).tobytes()
        want = plain_mel(payload)
        feature, spans, mel = audio.features(payload)
        assert np.allclose(mel, want, atol=1e-8)
        energy = want.mean(axis=1)
        low, high, runs, at = energy.mean(), energy.mean() + 0.5 * energy.std(), [], 0
        while at < len(energy):  # hysteresis, frame by frame
            end = at
            while end < len(energy) and energy[end] >= low:
                end += 1
            if end > at and max(energy[at:end]) >= high:
                runs.append((at, end))
            at = max(end, at + 1)
        rate = audio.RATE * audio.UP / audio.DOWN
        assert [(s["start_s"], s["end_s"]) for s in spans] == [(a * audio.HOP / rate, ((b - 1) * audio.HOP + audio.FRAME) / rate) for a, b in runs]
        profile = ",".join(f"{v:.2f}" for v in want.mean(axis=0) + 0.0)
        assert feature == f"frames={len(want)};segments={len(runs)};active={sum(b - a for a, b in runs)};mel={profile}"


def test_tensors_are_stored(spark):
    """What the stored streams hold are tensors of one fixed shape with their time spans; the query digests just these."""
    import pyarrow as pa

    rows = audio.media_columns(awkward(spark)).collect()
    digests = collections.Counter(hashlib.sha256(r["tensors"]).hexdigest() for r in rows)
    assert digests == collections.Counter(r["tensors_sha256"] for r in audio.media_digests(awkward(spark)).collect())
    for r in rows:
        table = audio.tensors_of(bytes(r["tensors"]))
        assert isinstance(table.schema.field("tensor").type, pa.FixedShapeTensorType)
        cube = table["tensor"].combine_chunks().to_numpy_ndarray()
        mel = audio.features(audio.samples_of(bytes(r["media"])))[2]
        assert cube.shape == (r["n_tensors"], audio.PATCH, audio.MELS)
        assert np.array_equal(cube.reshape(-1, audio.MELS)[: len(mel)], mel.astype(np.float32)) and not cube.reshape(-1, audio.MELS)[len(mel) :].any()
        assert sum(table["frames"].to_pylist()) == len(mel)
        assert all(a < b for a, b in zip(table["start_s"].to_pylist(), table["end_s"].to_pylist()))


def base_counts(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_counts(spark):
    want = collections.Counter((doc_id, *base_counts(text)) for doc_id, text in texts_of(TEXTS))
    rows = quality.judge_digests(awkward(spark)).collect()
    assert collections.Counter(tuple(r)[:7] for r in rows) == want
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert next(r for r in rows if r["doc_id"] == 11)["kept"]


def test_host_verdicts(spark):
    good = " ".join(f"w{i}" for i in range(60))
    junk = " ".join(f"w{i}***" for i in range(60))
    rows = [(i, good, "fine", 0) for i in range(40)] + [(100 + i, junk if i else good, "bad", 0) for i in range(40)] + [(200, junk, "fine", 0)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")).collect()}
    assert all(got[i]["kept"] for i in range(40))
    assert got[200]["kept"] and not got[101]["kept"]
    assert got[101]["rate"] > 0.5 > got[0]["rate"]
    salted = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long"), limits=quality.Limits(broadcast_hosts=0)).collect()
    assert {r["doc_id"]: r["kept"] for r in salted} == {i: r["kept"] for i, r in got.items()}
    assert quality.beta_prior(spark.createDataFrame([], "host string, docs long, failed long")) == (1.0, 1.0)


def test_word_array(spark):
    for text in [t for _, t in texts_of(TEXTS)] + [" a", "a ", " ", "", "a  b\x0b c"]:
        got = spark.range(1).select(quality.word_array(F.lit(text)).alias("w")).first()["w"]
        assert got == WORD.findall(text)


def phrases(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    hits = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in hits}))


def test_license_base(spark):
    more = [(50, "under the MIT license under the mit license: apache license version 2.0 cc-by-nc", "s"), (51, "ünder the mit license", "s")]
    docs = awkward(spark).unionByName(spark.createDataFrame(more, "doc_id long, text string, source string"), allowMissingColumns=True)
    want = collections.Counter((doc_id, *phrases(text)) for doc_id, text in texts_of(TEXTS) + [(i, t) for i, t, _ in more])
    rows = licenses.scan_digests(docs).collect()
    assert collections.Counter(tuple(r)[:6] for r in rows) == want
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize(
    "text,labels,permissive",
    [
        ("MIT", {"mit"}, True),
        ("MIT OR GPL-3.0-only", {"mit", "gpl"}, True),
        ("MIT AND GPL-3.0-only", {"mit", "gpl"}, False),
        ("GPL-2.0-or-later WITH Classpath-exception-2.0 OR Apache-2.0", {"gpl", "apache-2"}, True),
        ("(MIT OR GPL-2.0-only) AND Apache-2.0", {"mit", "gpl", "apache-2"}, True),
        ("MIT OR GPL-2.0-only AND LGPL-2.1-only", {"mit", "gpl", "lgpl"}, True),
        ("MIT and more prose", {"mit", "more"}, False),
        ("(MIT", {"mit"}, False),
        ("", set(), False),
        ("AND", set(), False),
        ("MIT)", {"mit"}, False),
        ("MIT OR )", {"mit"}, False),
        ("MIT (see the file)", {"mit"}, True),
    ],
)
def test_expressions(text, labels, permissive):
    assert licenses.evaluate(*licenses.to_postfix(text)) == (labels, permissive)


def test_tags_however_written(spark):
    texts = ["SPDX License Identifier: GPL-2.0-only", "spdx-license-identifier MIT", "x SPDX_License--Identifier = (MIT)", "xspdx license identifier: MIT", "spdx license identifiers: MIT", "SPDX-License-Identifier:\nMIT", "ſpdx license identifier: MIT"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in licenses.scan_digests(rows).collect()} == {0: "gpl", 1: "mit", 2: "mit", 3: "", 4: "", 5: "", 6: ""}


def test_sharding(spark):
    rows = sharding.shard_digests(awkward(spark)).collect()
    want = collections.Counter((d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts_of(TEXTS))
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    places = collections.defaultdict(list)
    for r in rows:
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert {r["law"] for r in rows} == {"bytes"}


def test_sizes_are_near_equal_and_hot_rows_part(spark):
    """The query's own output: sizes, also where a third of all rows share a text, or both id and text."""
    rng = np.random.default_rng(2)
    rows = [(i, "a" * int(n)) for i, n in enumerate(rng.integers(1, 400, 4000))]
    rows += [(10_000 + i, "the same text of many copies") for i in range(2000)] + [(5, "one id and text")] * 2000 + [(None, None)] * 500
    got = sharding.shard_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes = collections.Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert set(sizes) == set(range(8)) and max(sizes.values()) <= 1.001 * min(sizes.values())
    for mine in ([r for r in got if r["doc_id"] == 5], [r for r in got if (r["doc_id"] or 0) >= 10_000], [r for r in got if r["doc_id"] is None]):
        slots = collections.Counter(r["vslot"] for r in mine)
        assert max(slots.values()) < 30
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got))) for s in range(8))


def test_map_lasts(spark, tmp_path):
    """A second session reads the map that a first one stored, edits it to what has changed, and writes the next version."""
    folder = f"file://{tmp_path}/map"
    docs = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(3000)], "doc_id long, text string")
    rows, first, version = sharding.shard(docs, folder)
    before = {(r["doc_id"], r["vslot"]): r["shard"] for r in rows.collect()}
    other = sharding.SlotMap(spark.newSession(), folder)
    assert other.versions() == first.versions() and version == other.versions()[-1] == 2
    placed = other.placed(version)
    assert all(placed[slot] == shard for (_, slot), shard in before.items())
    assert other.placed(1) == sharding.deal(8)
    more = docs.unionByName(spark.createDataFrame([(9000 + i, "y" * 400) for i in range(200)], "doc_id long, text string"))
    rows, again, third = sharding.shard(more, folder)
    assert third == 3 and other.versions() == [1, 2, 3]
    old, new = other.placed(2), other.placed(3)
    after = {(r["doc_id"], r["vslot"]): r["shard"] for r in rows.collect()}
    assert all(after[k] == new[k[1]] for k in after) and 0 < sum(old[s] != new[s] for s in old) < 1500
    grown = other.edit(lambda placed: sharding.grow(placed, {s: 1 for s in placed}, 8))
    assert grown == 4 and all(shard in (new[s], 8) for s, shard in other.placed(4).items())


def test_maps_move_little():
    rng = np.random.default_rng(1)
    totals = {s: int(n) for s, n in enumerate(rng.integers(0, 2000, sharding.SLOTS))}
    first = sharding.rebalance(sharding.deal(8), totals, 0.0002)
    load = collections.Counter()
    for s, h in first.items():
        load[h] += totals[s]
    assert max(load.values()) <= 1.001 * min(load.values())
    grown = sharding.grow(first, totals, 8)
    assert all(grown[s] in (first[s], 8) for s in first)
    load = collections.Counter()
    for s, h in grown.items():
        load[h] += totals[s]
    assert max(load.values()) - min(load.values()) <= 2 * max(totals.values())
    drifted = totals | {s: 5000 for s in [s for s, h in first.items() if h == 0][:20]}
    after = sharding.rebalance(first, drifted)
    assert 0 < sum(after[s] != first[s] for s in first) < 100


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(q) <= 255 for q in match.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1]))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if holds(k, m[0])]


def test_personal_data_base(spark):
    import random

    rng = random.Random(8)
    pieces = ["a@b.c", "x.y@z-1.org_q@r.st", "1.2.3.4.5.6.7.8", "0001.2.3.255", "256.1.1.1", "4111111111111111", "4111-1111 1111 1111", "+1 (2) 345-6789", "+12345678", "@", ".", "9", " ", "é", "日", "_", "+", "-"]
    texts = [(100 + i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))) for i in range(300)] + texts_of(TEXTS)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = collections.Counter()
    for doc_id, text in texts:
        spans = base_spans(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want[(doc_id, *(sum(s[0] == k for s in spans) for k in BASE), hashlib.sha256(joined.encode()).hexdigest())] += 1
    rows = pii.find_digests(docs).collect()
    assert collections.Counter(tuple(r)[:6] for r in rows) == want


def test_terms_disclose(spark):
    rng = np.random.default_rng(0)
    common = [f"common{chr(97 + i)}" for i in range(20)]
    filler = lambda: " ".join(rng.choice(common, 12))
    rows = [(i, f"{filler()} Zebraman wrote from zed@corp.org about {filler()} text{'abcd'[i]} ") for i in range(4)] + [(10 + i, filler()) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.find_digests(docs).collect()}
    text = dict(rows)[0]
    at = text.index("Zebraman")
    assert f"term:{at}:{at + 8}" in found[0]
    assert all(found[i] == "" for i in range(10, 70))
    assert not any(text[int(a) : int(b)].startswith("common") for _, a, b in (s.split(":") for s in found[0].split(",")))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "zed@corp.org" not in clean[0] and "[EMAIL]" in clean[0] and "Zebraman" not in clean[0]
    assert all(clean[i] == dict(rows)[i] for i in range(10, 70))


def test_shuffled_joins_agree(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"Zebraman wrote from zed@corp.org text{'abcd'[i % 4]}") for i in range(8)] + [(10 + i, " ".join(rng.choice(["some", "other", "words"], 9))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(map(tuple, pii.find_digests(docs).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert one == sorted(map(tuple, pii.find_digests(docs).collect())) and any("term:" in r[-1] for r in one)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sanitise_keeps_rows(spark):
    docs = awkward(spark)
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len(TEXTS)
    assert next(r["text"] for r in rows if r["doc_id"] == 17) == "mail [EMAIL] and [IP] or 300.1.1.1, card [CARD], call [PHONE]; x@y"
    assert sum(r["text"] is None for r in rows) == 2


def test_empty_tables(spark):
    none = empty(spark)
    for digests in (audio.media_digests, quality.judge_digests, licenses.scan_digests, sharding.shard_digests, pii.find_digests, pii.sanitise):
        assert digests(none).count() == 0
