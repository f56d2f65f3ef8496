"""The pipeline's stages against versions in plain Python that share no code with the operators but the trained model."""

import collections
import math

import regex
from test_documents import base_counts, base_spans
from test_models import exact, plain_score
from test_tokens import check_packing

import corpus_pipeline
from comparing import SMALL
from framequarry.llm import pii, quality, toxicity
from framequarry.runtime import table


def plain_toxic(spark, docs):
    model = toxicity.fit(table(spark, SMALL, "documents"), table(spark, SMALL, "labels"))
    scores = {}
    for d in docs:
        words = toxicity.words_of((d["text"] or "").lower())
        scores[d["doc_id"]] = float(plain_score(model, words)) if words else 0.0
    assert not any(abs(s - 0.5) < 1e-5 for s in scores.values())
    return [d for d in docs if scores[d["doc_id"]] < 0.5]


def plain_quality(docs):
    limits, rows, hosts = quality.Limits(), [], collections.defaultdict(lambda: [0, 0])
    for d in docs:
        text = d["text"] or ""
        n, chars, symbols, dups, _, base = base_counts(text)
        lines = sum(bool(regex.search(r"[^\x20\x09-\x0D]", line)) for line in text.split("\n"))
        soft = (100 * symbols > limits.max_symbols_per_100_words * n) + (100 * dups > limits.max_dup_line_percent * lines) + (chars > limits.max_word_length * n)
        rows.append((d, base, soft))
        hosts[d["source"]][0] += 1
        hosts[d["source"]][1] += base or soft > 0
    rates = [k / n for n, k in hosts.values()]
    mean = min(max(sum(rates) / len(rates), 1e-3), 1 - 1e-3)
    spread = sum((r - sum(rates) / len(rates)) ** 2 for r in rates) / len(rates)
    between = max(spread - mean * (1 - mean) * sum(1 / n for n, _ in hosts.values()) / len(rates), 0.0)
    strength = min(max(mean * (1 - mean) / between - 1, 2.0), 1000.0) if between > 0 else 1000.0
    kept = []
    for d, base, soft in rows:
        n, k = hosts[d["source"]]
        rate = (k + mean * strength) / (n + strength)
        if not (base or rate >= limits.block_rate or soft >= 2 or soft and rate >= limits.reject_rate):
            kept.append(d)
    return kept


def plain_distinct(docs):
    component = {d: c for (d, _, c) in exact([(d["doc_id"], d["text"]) for d in docs], 5, 80)}
    return [d for d in docs if component[d["doc_id"]] == d["doc_id"]]


def plain_sanitised(docs):
    texts = {d["doc_id"]: d["text"] or "" for d in docs}
    name = {"email": str.lower, "ip": str, "card": lambda m: regex.sub("[^0-9]", "", m), "phone": lambda m: regex.sub("[^0-9]", "", m)}
    spans = {i: base_spans(t) for i, t in texts.items()}
    holds = {i: {f"{k}:{name[k](texts[i][a:b])}" for k, a, b in own} for i, own in spans.items()}
    term = regex.compile(r"[\p{L}\p{M}\p{N}]+")
    words = {i: {m[0].lower() for m in term.finditer(t)} for i, t in texts.items()}
    n_t = collections.Counter(w for own in words.values() for w in own)
    by_entity = collections.defaultdict(list)
    for i, own in holds.items():
        for e in own:
            by_entity[e].append(i)
    n, strong = len(texts), collections.defaultdict(float)
    for ids in by_entity.values():
        if len({texts[i] for i in ids}) < pii.SUPPORT or len(ids) >= n:
            continue
        together = collections.Counter(w for i in ids for w in words[i])
        kinds = collections.Counter(w for i in {texts[i]: i for i in ids}.values() for w in words[i])
        for w, count in together.items():
            if kinds[w] >= pii.SUPPORT:
                strong[w] = max(strong[w], math.log2(count * n / (n_t[w] * len(ids))) / math.log2(n / len(ids)))
    out = []
    for d in docs:
        text, bare = texts[d["doc_id"]], list(texts[d["doc_id"]])
        own = [(a, b, pii.LABELS[k]) for k, a, b in spans[d["doc_id"]]]
        for a, b, _ in own:
            bare[a:b] = " " * (b - a)
        for m in term.finditer("".join(bare)):
            s = strong.get(m[0].lower(), 0.0)
            if s >= pii.GENERALISE:
                own.append((m.start(), m.end(), "" if s >= pii.REMOVE else pii.LABELS["generalised"]))
        clean, at, reach = "", 0, 0
        for a, b, label in sorted(own):
            if a >= reach:
                clean, at = clean + text[at:a] + label, b
            reach = max(reach, b)
            at = max(at, b)
        out.append((d["doc_id"], clean + text[at:]))
    return out


def test_stages_against_plain_versions(spark):
    docs = [r.asDict() for r in table(spark, SMALL, "documents").collect()]
    held = table(spark, SMALL, "documents")
    stages = dict(corpus_pipeline.STAGES)
    for name, plain in (("toxicity", lambda rows: plain_toxic(spark, rows)), ("quality", plain_quality), ("near_dedup", plain_distinct)):
        before, docs = docs, plain(docs)
        assert len(docs) < len(before), name
        out = stages[name](spark, held, SMALL)
        rows = out.collect()
        assert {r["doc_id"]: r["text"] for r in rows} == {d["doc_id"]: d["text"] for d in docs}, name
        held = spark.createDataFrame(rows, out.schema)
    clean = plain_sanitised(docs)
    assert any(text != d["text"] for (_, text), d in zip(clean, docs))
    assert {r["doc_id"]: r["text"] or "" for r in stages["pii"](spark, held, SMALL).collect()} == dict(clean)
    check_packing(corpus_pipeline.run(spark, SMALL).collect(), clean)


def test_rows_that_share_ids(spark):
    """One row of each group stays, also where ids are shared or missing, and no row goes for another's sake."""
    words = lambda tag, n=30: " ".join(f"{tag}{i}" for i in range(n))
    rows = [(5, words("a"), 1), (5, words("a"), 1), (5, words("b"), 2), (None, words("c"), 3), (None, words("c"), 4), (None, words("a"), 5), (2, words("b") + " more", 6), (9, "", 7), (9, "", 8), (None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = sorted((tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()), key=repr)
    assert [r for r in got if r[1]] in ([(2, words("b") + " more", 6), (5, words("a"), 1), (None, words("c"), 3)], [(2, words("b") + " more", 6), (5, words("a"), 1), (None, words("c"), 4)])
    assert sorted(r[2] for r in got if not r[1]) == [7, 8, 9]
