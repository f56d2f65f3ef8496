"""Spelling variants: words one edit apart, found in forward and reversed sorted dictionaries.

Words are the runs of Latin letters of all texts, counted; each task counts what it reads before anything is shuffled.
One inserted, deleted or replaced letter leaves a half of a word intact. So every word stands in two dictionaries, one
sorted from its beginning and one from its end, once for each length that the shorter word of a pair may have, and a
pair shares its first half in the one or its last half in the other. Both are scanned block by block, a block being the
words that share such a half. A block of more than BLOCK words is subdivided: the part of its words that is still open
is cut in two, and again one edit leaves one of them intact, until blocks are small or a single letter is open, where
the alphabet bounds them. Blocks are dealt by ranges, whole, and pairs inside them verified.

A word's form is its most frequent near word, if that is FORM_TIMES as frequent; counts grow along forms, so following
them ends, and roots are found by doubling the step.

Defined cases: null and empty texts have no words; a null doc_id counts as an empty one where a run's checksum is taken;
equal rows count twice; a text of any length is read whole, one at a time; ties between near words go to the smallest in
code-point order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framequarry.runtime import bounded_batches, lean, materialise, shuffle_width

LEAST_LETTERS, LEAST_COUNT, FORM_TIMES = 6, 5, 5
#: Of the runs of letters, one in so many, by a checksum, loses a letter.
SLIP = 199
#: Distinct words that a task counts before it passes them on, and words that a block may hold before it is subdivided.
COUNTED, BLOCK = 300_000, 64

# Lower-case letters and, in UTF-8, the code points U+00C0 to U+00FF.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")

KEY = ["side", "m", "p", "s", "head", "tail"]


def slipped(run: bytes, seed: int) -> str:
    """The run, without one of its letters where the checksum says so; seed: the checksum of what stands before it."""
    h = zlib.crc32(run, seed)
    word = run.decode()
    if h % SLIP == 0:
        at = h % len(word)
        return word[:at] + word[at + 1 :]
    return word


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words with enough letters and occurrences."""

    @lean
    def run(batches):
        total: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for found, times in Counter(_RUN.findall(text.as_py().encode().lower())).items():
                    if len(found) >= least_letters:
                        word = slipped(found, seed)
                        if len(word) >= least_letters:
                            total[word] += times
                if len(total) > COUNTED:
                    yield out()
        yield out()

    rows = bounded_batches(docs).select("doc_id", F.col("text")).where("text is not null")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def dictionaries(words: DataFrame, least_letters: int) -> DataFrame:
    """Rows of the forward (side 0) and reversed (side 1) dictionary. m: length of the shorter word of a pair; the first p
    and last s letters, head and tail, are shared inside a block."""
    length = F.length("word")
    by_length = words.select("word", "n", F.explode(F.array(length - 1, length)).alias("m")).where(F.col("m") >= least_letters)
    half = F.floor(F.col("m") / 2).cast("int")
    sides = F.array(F.struct(F.lit(0).alias("side"), half.alias("p"), F.lit(0).alias("s")), F.struct(F.lit(1).alias("side"), F.lit(0).alias("p"), (F.col("m") - half).alias("s")))
    return keyed(by_length.withColumn("cut", F.explode(sides)).select("word", "n", "m", "cut.side", "cut.p", "cut.s"))


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"head": F.expr("left(word, p)"), "tail": F.expr("if(s = 0, '', right(word, s))")})


def subdivided(rows: DataFrame) -> DataFrame:
    """Each row of a block in the two parts of it that one edit in the open letters leaves together."""
    left = F.col("m") - F.col("p") - F.col("s")
    half = F.floor(left / 2).cast("int")
    parts = F.array(F.struct((F.col("p") + half).alias("p"), F.col("s").alias("s")), F.struct(F.col("p").alias("p"), (F.col("s") + left - half).alias("s")))
    return keyed(rows.withColumn("cut", F.explode(parts)).select("word", "n", "m", "side", "cut.p", "cut.s"))


def blocks(words: DataFrame, least_letters: int = LEAST_LETTERS, block: int = BLOCK) -> DataFrame:
    """Rows of both dictionaries in blocks of at most `block` words, or in which at most one letter is open."""
    rows, done = dictionaries(words, least_letters), []
    while True:
        sizes = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("size"))
        crowded = materialise(sizes.where((F.col("size") > block) & (F.col("m") - F.col("p") - F.col("s") > 1)).select(*KEY), "crowded")
        if crowded.isEmpty():
            return reduce(DataFrame.unionByName, [*done, rows])
        done.append(rows.join(crowded, KEY, "left_anti"))
        rows = materialise(subdivided(rows.join(crowded, KEY, "left_semi")).distinct(), "blocks")


def code_points(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def pairs_of_block(words: list[str], m: int):
    """(i, j) of the words that differ by one edit, where the shorter, or both, have m letters."""
    same, longer = [i for i, w in enumerate(words) if len(w) == m], [i for i, w in enumerate(words) if len(w) == m + 1]
    if not same:
        return
    a = code_points([words[i] for i in same], m)
    b = code_points([words[i] for i in longer], m + 1)
    step = max(1, (1 << 20) // (m * (len(same) + len(longer))))
    for at in range(0, len(same), step):
        part = a[at : at + step, None, :]
        i, j = np.nonzero((part != a[None, :, :]).sum(axis=2) == 1)
        yield from ((same[x + at], same[y]) for x, y in zip(i, j) if x + at < y)
        if longer:
            # Letters equal from the beginning, and from the end, together reach m.
            head = np.minimum.accumulate(part == b[None, :, :-1], axis=2).sum(axis=2)
            tail = np.minimum.accumulate((part == b[None, :, 1:])[:, :, ::-1], axis=2).sum(axis=2)
            yield from ((same[x + at], longer[y]) for x, y in zip(*np.nonzero(head + tail >= m)))


def near_words(words: DataFrame, least_letters: int = LEAST_LETTERS, block: int = BLOCK) -> DataFrame:
    """(word, other, other_n): every word with each word that differs from it by exactly one edit, once."""

    @lean
    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = list(zip(*(held[c].to_pylist() for c in KEY)))
            last = next((i for i in range(len(keys) - 1, -1, -1) if keys[i] != keys[-1]), -1) + 1  # the last block may go on
            if last:
                yield from scanned(held.slice(0, last), keys)
                held = held.slice(last)
        if held is not None:
            yield from scanned(held, list(zip(*(held[c].to_pylist() for c in KEY))))

    def scanned(table, keys):
        word, n, m = table["word"].to_pylist(), table["n"].to_pylist(), table["m"].to_pylist()
        out, start = [], 0
        for end in range(1, len(word) + 1):
            if end == len(word) or keys[end] != keys[start]:
                if end - start > 1:
                    for i, j in pairs_of_block(word[start:end], m[start]):
                        i, j = i + start, j + start
                        out += [(word[i], word[j], n[j]), (word[j], word[i], n[i])]
                start = end
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64()))], names=["word", "other", "other_n"])

    width = shuffle_width(words.sparkSession)
    rows = materialise(blocks(words, least_letters, block), "dictionaries")
    ordered = rows.repartitionByRange(width, *KEY).sortWithinPartitions(*KEY)
    return ordered.select(*KEY, "word", "n").mapInArrow(run, "word string, other string, other_n long").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form (word, form): the last form on the way, by steps that double."""
    reached = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = reached.select(F.col("word").alias("at"), F.col("root").alias("next"))
        further = materialise(reached.join(on, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        reached = further.select("word", "root")
        if further.where("moved").isEmpty():
            return reached


def variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, form_times: int = FORM_TIMES) -> DataFrame:
    """Per word: word, n, n_near, form, form_n and root."""
    words = materialise(word_counts(docs, least_letters, least_count), "words")
    near = near_words(words, least_letters)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form"))).alias("best"))
    rows = words.join(best, "word", "left").withColumn("form_n", -F.col("best.minus"))
    fits = F.col("form_n") >= form_times * F.col("n")
    rows = materialise(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")), "forms")
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
