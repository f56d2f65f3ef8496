"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

Every word becomes one vector: evidence of the word itself (its smoothed log-odds in toxic against other training
documents), evidence of its character n-grams (mean and largest log-odds, which reaches words never seen in training),
and trained embeddings of both: the mean of its n-grams' and its own, by hash. A text is cut into windows that overlap;
the network scores every window of every text and a text scores as its worst window. Network and embeddings are trained
by numpy on the driver, on a bounded sample of labelled rows: windows are chosen by the network itself (the worst of
each document, and others of clean ones), as only documents carry labels. Evidence for a training document comes from
the other folds of the sample.

The sample: at most SAMPLE_ROWS rows of each label, in the order of a hash of doc_id, only with
crc32(doc_id as text) mod 5 other than 0. Their texts are learned from whole, however long: they reach the driver one
after another and stay there as four bytes a word. Scoring covers all texts whole, too.

Defined cases: null and empty texts, and texts without a word, score 0; a null doc_id is scored, counts as held out and
is never learned from; of rows with one doc_id, one is learned from; a label other than 0 or 1 is not learned from;
with one label only, or none, the score is that label's rate, 0 without any; equal texts score alike; an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framequarry.llm import gru
from framequarry.runtime import bounded_batches, give_back, lean, materialise, resident

SAMPLE_ROWS = 2000
WINDOW, STRIDE = 48, 32
HIDDEN, ATTENTION = 8, 8
GRAMS = (3, 4, 5)
BUCKETS, WORD_BUCKETS = 1 << 15, 1 << 12
CHAR_CODE, WORD_CODE = 6, 4
INPUTS = 3 + CHAR_CODE + WORD_CODE
STEPS, BATCH, FOLDS, CHOOSE_EVERY = 320, 128, 5, 80
#: Documents that a training word's evidence needs.
OFTEN = 3
#: Distinct words whose vectors a worker keeps, and windows that it scores at a time.
CACHE_WORDS, SCORE_BATCH = 100_000, 2048

SCORE_SCHEMA = "doc_id long, score double, worst_window int"

words_of = re.compile(r"[^\W_]+").findall


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of words, edges included, and for each the index of its word, ascending."""
    raw = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
    edge = raw == 10
    owner = np.cumsum(edge) - 1
    found, owners = [], []
    for n in GRAMS:
        if len(raw) < n:
            continue
        count = len(raw) - n + 1
        h = np.zeros(count, np.uint32)
        inner = np.zeros(count, bool)
        for k in range(n):
            h = h * np.uint32(0x01000193) ^ raw[k : k + count]
            if 0 < k < n - 1:
                inner |= edge[k : k + count]
        ok = np.flatnonzero(~inner)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        found.append((h[ok] % BUCKETS).astype(np.int32))
        owners.append(owner[ok])
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    owners_all = np.concatenate(owners)
    order = np.argsort(owners_all, kind="stable")
    return np.concatenate(found)[order], owners_all[order]


def spread(owners: np.ndarray, n: int) -> np.ndarray:
    """Where each of n words' n-grams begin, and end, among ascending owners."""
    return np.searchsorted(owners, np.arange(n + 1))


def of_grams(values: np.ndarray, bounds: np.ndarray, operation=np.add) -> np.ndarray:
    """The operation over each word's n-grams; 0 for words without any."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), np.float32)
    have = np.flatnonzero(np.diff(bounds))
    if len(have):
        out[have] = operation.reduceat(values, bounds[have])
    return out


def word_buckets(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_BUCKETS for w in words), np.int64, len(words))


def gram_evidence(odds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean and largest of the words' n-grams' log-odds."""
    counts = np.maximum(np.diff(bounds), 1)
    return np.stack([of_grams(odds, bounds) / counts, of_grams(odds, bounds, np.maximum)], axis=1)


class Evidence:
    """Log-odds of words and of n-gram buckets."""

    def __init__(self, words: dict[str, float], grams: np.ndarray):
        self.words, self.grams = words, grams.astype(np.float32)

    def vectors(self, words: list[str], p: dict[str, np.ndarray]) -> np.ndarray:
        """One vector a word, from its evidence and from the embeddings among the parameters."""
        out = np.zeros((len(words), INPUTS), np.float32)
        if words:
            buckets, owners = gram_buckets(words)
            bounds = spread(owners, len(words))
            out[:, 0] = np.fromiter((self.words.get(w, 0.0) for w in words), np.float32, len(words))
            out[:, 1:3] = gram_evidence(self.grams[buckets], bounds)
            out[:, 3 : 3 + CHAR_CODE] = of_grams(p["chars"][buckets], bounds) / np.maximum(np.diff(bounds), 1)[:, None]
            out[:, 3 + CHAR_CODE :] = p["words"][word_buckets(words)]
        return out


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Smoothed, and shrunk where few documents have the feature."""
    seen = toxic + clean
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return odds * seen / (seen + 3.0)


def window_starts(n: int) -> list[int]:
    """Starts of overlapping windows that cover n words: every STRIDE words, and no window that adds nothing."""
    return list(range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)) if n else []


def projected(x: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """Vectors as the network's inputs in either direction."""
    return np.concatenate([x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"]], axis=1)


def worst_windows(table: np.ndarray, docs: list[np.ndarray], p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Largest logit of each document's windows, and that window's index (-1 without words). docs: rows of table, whose
    row 0 is padding."""
    out, worst = np.full(len(docs), -np.inf), np.full(len(docs), -1)
    cut = [(d, k, at) for d, own in enumerate(docs) for k, at in enumerate(window_starts(len(own)))]
    for first in range(0, len(cut), SCORE_BATCH):
        part = cut[first : first + SCORE_BATCH]
        index = np.zeros((len(part), WINDOW), np.int64)
        for i, (d, _, at) in enumerate(part):
            got = docs[d][at : at + WINDOW]
            index[i, : len(got)] = got
        index = np.ascontiguousarray(index.T)
        x = table[index]
        found = gru.logits(p, x[:, :, : 3 * HIDDEN], x[:, :, 3 * HIDDEN :], (index > 0).astype(np.float32))
        for (d, k, _), value in zip(part, found.tolist()):
            if value > out[d]:
                out[d], worst[d] = value, k
    return out, worst


class Model:
    """Evidence, embeddings and network; scores lists of words."""

    def __init__(self, evidence: Evidence | None, parameters: dict[str, np.ndarray], constant: float | None = None):
        self.evidence, self.parameters, self.constant = evidence, parameters, constant
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table, self.used = np.zeros((1, 6 * HIDDEN), np.float32), 1

    def __getstate__(self):
        return {"evidence": self.evidence, "parameters": self.parameters, "constant": self.constant}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def rows_of(self, docs: list[list[str]]) -> list[np.ndarray]:
        """Indices into the table of projected vectors, for each word; row 0 is padding."""
        fresh = list(dict.fromkeys(w for ws in docs for w in ws if w not in self.known))
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.forget()
            fresh = list(dict.fromkeys(w for ws in docs for w in ws))
        if fresh:
            end = self.used + len(fresh)
            if end > len(self.table):  # grown by halves, not copied for every batch
                table = np.zeros((max(end, len(self.table) * 3 // 2), 6 * HIDDEN), np.float32)
                table[: self.used] = self.table[: self.used]
                self.table = table
            for at in range(0, len(fresh), 1 << 14):
                part = fresh[at : at + (1 << 14)]
                self.table[self.used + at : self.used + at + len(part)] = projected(self.evidence.vectors(part, self.parameters), self.parameters)
            self.known.update(zip(fresh, range(self.used, end)))
            self.used = end
        return [np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws)) for ws in docs]

    def score(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Score of each document and the index of its worst window (-1 without words)."""
        if self.constant is not None:
            return np.where([bool(ws) for ws in docs], self.constant, 0.0), np.full(len(docs), -1)
        out, worst = worst_windows(self.table_of(docs), self.rows, self.parameters)
        return np.where(worst >= 0, gru.sigmoid(out.astype(np.float64)), 0.0), worst

    def table_of(self, docs: list[list[str]]) -> np.ndarray:
        self.rows = self.rows_of(docs)
        return self.table


class Sample:
    """Labelled texts as numbers: their words, the words' n-grams, and evidence from all folds but one."""

    def __init__(self, texts: Iterable[str], labels: list[int], seed: int):
        index: dict[str, int] = {}
        docs = [np.fromiter((index.setdefault(w, len(index)) for w in words_of(t.lower())), np.int32) for t in texts]
        have = [i for i, own in enumerate(docs) if len(own)]
        self.docs, self.y, self.words = [docs[i] for i in have], np.array(labels, np.int64)[have], list(index)
        self.buckets, owners = gram_buckets(self.words)
        self.bounds = spread(owners, len(self.words))
        self.own = word_buckets(self.words)
        rng = np.random.default_rng(seed)
        self.fold = np.zeros(len(self.y), np.int64)
        for label in (0, 1):
            own = np.flatnonzero(self.y == label)
            self.fold[own[rng.permutation(len(own))]] = np.arange(len(own)) % FOLDS
        self.word_counts = np.zeros((FOLDS, 2, len(self.words)), np.float32)
        self.gram_counts = np.zeros((FOLDS, 2, BUCKETS), np.float32)
        self.sizes = np.zeros((FOLDS, 2))
        for own, fold, label in zip(self.docs, self.fold, self.y):
            distinct = np.unique(own)
            self.word_counts[fold, label, distinct] += 1
            self.gram_counts[fold, label, np.unique(np.concatenate([self.buckets[self.bounds[c] : self.bounds[c + 1]] for c in distinct]))] += 1
            self.sizes[fold, label] += 1

    def odds(self, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of words (0 for rare ones) and of n-gram buckets, from all folds or from all but one."""
        use = [k for k in range(FOLDS) if k != without]
        words, grams, sizes = self.word_counts[use].sum(axis=0), self.gram_counts[use].sum(axis=0), self.sizes[use].sum(axis=0)
        of_words = np.where(words.sum(axis=0) >= OFTEN, log_odds(words[1], words[0], sizes[1], sizes[0]), 0).astype(np.float32)
        return of_words, log_odds(grams[1], grams[0], sizes[1], sizes[0]).astype(np.float32)

    def crossed(self, k: int) -> np.ndarray:
        """Evidence of every word for the documents of fold k."""
        of_words, of_buckets = self.odds(k)
        return np.column_stack([of_words, gram_evidence(of_buckets[self.buckets], self.bounds)])

    def vectors(self, evidence: np.ndarray, words: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors of words given by number; and which n-grams, of which of these words, they are made of."""
        counts = np.diff(self.bounds)[words]
        starts = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(starts[-1]) + np.repeat(self.bounds[words] - starts[:-1], counts)
        buckets = self.buckets[at]
        chars = of_grams(p["chars"][buckets], starts) / np.maximum(counts, 1)[:, None]
        return np.concatenate([evidence[words], chars, p["words"][self.own[words]]], axis=1), buckets, np.repeat(np.arange(len(words)), counts)

    def worst(self, k: int, evidence: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """worst_windows of the documents of fold k."""
        docs = [self.docs[i] for i in np.flatnonzero(self.fold == k)]
        words, rows = np.unique(np.concatenate(docs), return_inverse=True) if docs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        table = np.zeros((len(words) + 1, 6 * HIDDEN), np.float32)
        for at in range(0, len(words), 1 << 14):
            part = words[at : at + (1 << 14)]
            table[1 + at : 1 + at + len(part)] = projected(self.vectors(evidence, part, p)[0], p)
        return worst_windows(table, np.split(rows + 1, np.cumsum([len(d) for d in docs])[:-1]) if docs else [], p)


def embedding_gradients(p, d_x: np.ndarray, buckets: np.ndarray, of_word: np.ndarray, own: np.ndarray) -> dict[str, np.ndarray]:
    """d_x: gradients of the vectors of words; buckets and of_word: their n-grams; own: their word buckets."""
    counts = np.maximum(np.bincount(of_word, minlength=len(own)), 1)
    chars, words = d_x[:, 3 : 3 + CHAR_CODE] / counts[:, None], d_x[:, 3 + CHAR_CODE :]
    each = chars[of_word]
    return {
        "chars": np.stack([np.bincount(buckets, each[:, c], BUCKETS) for c in range(CHAR_CODE)], axis=1).astype(np.float32),
        "words": np.stack([np.bincount(own, words[:, c], WORD_BUCKETS) for c in range(WORD_CODE)], axis=1).astype(np.float32),
    }


def train(texts: Iterable[str], labels: list[int], clean_weight: float = 1.0, seed: int = 0) -> Model:
    """A model from labelled texts, taken in the order given; clean_weight: how many clean rows each one stands for, as
    against toxic ones, when the threshold is set."""
    sample = Sample(texts, labels, seed)
    y, docs = sample.y, sample.docs
    if not len(y) or len(set(y.tolist())) < 2:
        return Model(None, {}, float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    evidence = [sample.crossed(k) for k in range(FOLDS)]
    parts = [np.flatnonzero(sample.fold == k) for k in range(FOLDS)]
    p = gru.new_parameters(INPUTS, HIDDEN, ATTENTION, seed)
    p |= {"chars": (0.5 * rng.standard_normal((BUCKETS, CHAR_CODE))).astype(np.float32), "words": (0.5 * rng.standard_normal((WORD_BUCKETS, WORD_CODE))).astype(np.float32)}
    optimiser = gru.Adam(p)
    chosen: list[tuple[int, int]] = []
    for step in range(STEPS):
        if step % CHOOSE_EVERY == 0:
            worst = np.zeros(len(y), np.int64)
            for k in range(FOLDS):
                if step:
                    worst[parts[k]] = sample.worst(k, evidence[k], p)[1]
                else:  # before any training: the window with the strongest evidence
                    strongest = evidence[k].max(axis=1)
                    worst[parts[k]] = [int(np.argmax([strongest[docs[i][at : at + WINDOW]].max() for at in window_starts(len(docs[i]))])) for i in parts[k]]
            chosen = [(i, int(worst[i])) for i in range(len(y))]
            chosen += [(i, int(rng.integers(len(window_starts(len(docs[i])))))) for i in np.flatnonzero(y == 0).tolist()]
        take = [chosen[j] for j in rng.integers(len(chosen), size=BATCH)]
        x = np.zeros((WINDOW, BATCH, INPUTS), np.float32)
        mask = np.zeros((WINDOW, BATCH), np.float32)
        pieces = []
        for j, (i, k) in enumerate(take):
            at = window_starts(len(docs[i]))[k]
            words = docs[i][at : at + WINDOW]
            v, buckets, of_word = sample.vectors(evidence[sample.fold[i]], words, p)
            x[: len(v), j], mask[: len(v), j] = v, 1
            pieces.append((j, words, buckets, of_word))
        target = y[[i for i, _ in take]].astype(np.float32)
        balance = np.where(target > 0, 0.5 / max(target.mean(), 1e-3), 0.5 / max(1 - target.mean(), 1e-3)).astype(np.float32)
        optimiser.rate = 0.02 * (1 - 0.9 * step / STEPS)
        gradients, d_x = gru.gradients(p, x, mask, target, balance)[1:]
        first = np.cumsum([0, *(len(words) for _, words, _, _ in pieces)])
        gradients |= embedding_gradients(
            p,
            np.concatenate([d_x[: len(words), j] for j, words, _, _ in pieces]),
            np.concatenate([buckets for _, _, buckets, _ in pieces]),
            np.concatenate([of_word + at for at, (_, _, _, of_word) in zip(first, pieces)]),
            sample.own[np.concatenate([words for _, words, _, _ in pieces])],
        )
        optimiser.update(p, gradients)
    # The threshold that errs least on documents scored by the other folds' evidence becomes 0.5.
    logit = np.zeros(len(y))
    for k in range(FOLDS):
        logit[parts[k]] = np.clip(sample.worst(k, evidence[k], p)[0], -20, 20)
    order = np.argsort(logit)
    errors = clean_weight * (y == 0).sum() + np.concatenate([[0], np.cumsum(np.where(y[order] == 1, 1.0, -clean_weight))])  # all called toxic, then fewer
    best = np.flatnonzero(errors <= errors.min() + 1e-9)
    at = int(best[-1])
    low, high = logit[order[at - 1]] if at else logit[order[0]] - 2, logit[order[at]] if at < len(y) else logit[order[-1]] + 2
    p["b"] = (p["b"] - (low + high) / 2).astype(np.float32)
    of_words, of_buckets = sample.odds()
    seen = np.flatnonzero(sample.word_counts.sum(axis=(0, 1)) >= OFTEN)
    return Model(Evidence({sample.words[i]: float(of_words[i]) for i in seen}, of_buckets), p)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_ROWS) -> tuple[DataFrame, list[int], float]:
    """A stored table (doc_id, text, toxic) of at most per_label whole texts of each label; its labels in the order of
    doc_id; and how many clean rows one of them stands for."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    picked = None
    for label in (0, 1):
        some = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text <> ''")
    rows = materialise(texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")), "training-sample")
    found = [r["toxic"] for r in rows.select("doc_id", "toxic").orderBy("doc_id").collect()]
    totals = known.agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    toxic = sum(found)
    clean = len(found) - toxic
    weight = (totals["n"] - totals["toxic"]) / totals["toxic"] * toxic / clean if toxic and clean else 1.0
    return rows, found, max(weight, 1.0)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample, toxic, clean_weight = training_sample(docs, labels)
    texts = (r["text"] for r in sample.orderBy("doc_id").select("text").toLocalIterator())
    model = train(texts, toxic, clean_weight)
    give_back()  # what training held on the driver
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """doc_id, score and worst window of every document; keep: columns to carry along as they are, instead of doc_id."""
    carried = keep if keep is not None else ["doc_id"]
    shared, label = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # of fixed size
    names = carried + ["score", "worst_window"]

    @lean
    def run(batches):
        own = resident(("toxicity", label), lambda: shared.value)
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            at = 0
            while at < batch.num_rows or not batch.num_rows:
                part, size, end = [], 0, at
                while end < batch.num_rows and size < 1 << 21:
                    t = text[end].as_py()
                    part.append(words_of(t.lower()))
                    size += len(t)
                    end += 1
                scores, worst = own.score(part)
                columns = [batch.column(i).slice(at, end - at) for i in range(len(carried))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64()), pa.array(worst, pa.int32())], names=names)
                if end >= batch.num_rows:
                    break
                at = end
        own.forget()

    bounded_batches(docs)
    base = docs.withColumn("doc_id", F.col("doc_id").cast("long")) if keep is None else docs
    fields = ", ".join(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in carried)
    plain = base.select(*[base[c] for c in carried], F.coalesce(base["text"], F.lit("")).alias("scored_text"))
    return plain.mapInArrow(run, f"{fields}, score double, worst_window int")


def score_digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
