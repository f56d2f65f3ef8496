"""Phrase collocations: weighted n-grams, counted in duckdb per hash bucket.

Texts are cut into pieces at punctuation and line ends, and identical pieces of a language become one with a multiplicity.
Each task turns its pieces into n-grams, sums the multiplicities of what is equal, and sends every hash bucket one
compressed parcel of them, so a word or phrase has at most one row a task chunk, however frequent it is. A bucket's task
puts its parcels into a duckdb database with a memory limit, which works out of core, and counts there. Only phrases
that reach the least count leave a bucket; a part of such a phrase is as frequent as the phrase itself, so all parts
that a score needs are among them. For the same reason two passes do: words and pairs first, then windows of three words
with the word behind them, of which only those travel whose pairs are all frequent, as a bitmap of at most MAP_BITS bits
tells (never wrongly of a frequent pair; the more pairs beyond its size, the less it saves). A window's first three
words decide its bucket, so phrases of three and of four words are whole in it.

Parts live in other buckets than their phrases: every cut of a candidate asks for both its parts by requests that are
shuffled to where the parts are. Longer candidates tell their inner phrases, by a partial maximum, which of them they
cover. The first rows of a language are picked in parts and then from the parts' firsts, never by sorting it in one task.

Defined cases: null and empty texts have no pieces; a null lang is `und`; equal rows count as often as they occur; texts and
pieces of any length are read whole, in slices of CHUNK words; ties in score and count go by phrase, in the order of UTF-8
bytes; an empty table gives no rows; other columns are ignored. What duckdb spills belongs to its task, like a sort's
spill, and goes with it.
"""

from __future__ import annotations

import re
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from framequarry.runtime import bounded_batches, lean, materialise, shuffle_width

LONGEST, LEAST_COUNT, COVERED_PERCENT, FIRST, SCALE = 4, 30, 80, 2000, 2_000_000
#: Words that a task counts at a time, and memory of one bucket's database.
CHUNK, MEMORY = 1 << 20, "384MB"
#: Bits of the map of frequent pairs at most, and bits for each of them where that is fewer.
MAP_BITS, PAIR_BITS = 1 << 28, 32
#: Distinct pieces that a task gathers before it passes them on.
GATHERED = 100_000
#: Parts of a language whose firsts are picked on their own.
PARTS = 64

_ENDS = re.compile(rb"[.,;:!?\x0A-\x0D]")

PARCEL_SCHEMA = "bucket int, parcel binary"
#: words: 0 for the number of all words of a language that fell into a bucket.
COUNT_SCHEMA = "lang string, words int, phrase string, f long"


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, m): distinct pieces, their words separated by single spaces, and how often they occur."""

    @lean
    def run(batches):
        found: Counter = Counter()

        def out():
            rows = [(lang, piece.decode(), m) for (lang, piece), m in found.items()]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([],) * 3, (pa.string(), pa.string(), pa.int64()))], names=["lang", "piece", "m"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for piece in _ENDS.split(text.as_py().encode().lower()):  # lower() of bytes is that of A-Z
                    words = piece.split()  # line ends have gone, so at spaces and tabs
                    if words:
                        found[lang, b" ".join(words)] += 1
                if len(found) > GATHERED:
                    yield out()
        yield out()

    rows = bounded_batches(docs).where("text is not null").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return rows.mapInArrow(run, "lang string, piece string, m long").groupBy("lang", "piece").agg(F.sum("m").alias("m"))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, ascending, the sums of their weights, and each key's place among them."""
    distinct, place = np.unique(keys, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, place, weights)
    return distinct, total, place


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


GRAM_SCHEMA = pa.schema([("lang", pa.string()), ("words", pa.int8()), ("phrase", pa.string()), ("behind", pa.string()), ("m", pa.int64())])


class PairMap:
    """Which pairs of words may be frequent: a bit by each frequent pair's hash."""

    def __init__(self, slots: np.ndarray, bits: np.ndarray, size: int):
        self.map, self.size = np.zeros(size // 64, np.uint64), np.uint64(size)
        self.map[slots] = bits

    def has(self, hashed: np.ndarray) -> np.ndarray:
        place = hashed % self.size
        return (self.map[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def phrase_hash(words: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(words[0]), np.uint64)
    for w in words:
        out = mixed(out + w)
    return out


class Chunk:
    """N-grams that begin at the first `count` of a run of words, with sums of their pieces' weights: words and pairs, or,
    with a map of frequent pairs, windows.

    values: the words, with LONGEST - 1 more than count where there are; left: words of the piece from each on, itself
    included; lang: a code into langs.
    """

    def __init__(self, values: pa.Array, left: np.ndarray, weight: np.ndarray, lang: np.ndarray, count: int, langs: list[str], buckets: int, pairs: PairMap | None = None):
        coded = values.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.words = coded.dictionary.take(pa.array(order))
        self.hash = word_hashes(self.words.to_pylist())
        self.langs, self.buckets = pa.array(langs, pa.string()), np.uint64(buckets)
        v, c = max(1, len(order)), rank[coded.indices.to_numpy()]
        left, weight, lang = left[:count], weight[:count], lang[:count]
        self.tables = []
        if pairs is None:
            one, n_one, _ = summed(lang * v + c[:count], weight)
            self.tables.append(self.gram(1, [one % v], one // v, n_one))
            at = np.flatnonzero(left >= 2)
            if len(at):
                two, n_two, _ = summed((lang[at] * v + c[at]) * v + c[at + 1], weight[at])
                self.tables.append(self.gram(2, [two // v % v, two % v], two // v // v, n_two))
            return
        hashed = self.hash[c]
        often = np.concatenate([pairs.has(phrase_hash([hashed[:-1], hashed[1:]])), [False] * LONGEST]) if len(c) else np.zeros(LONGEST, bool)
        at = np.flatnonzero((left >= 3) & often[:count] & often[1 : count + 1])
        if len(at):
            two, place = np.unique((lang[at] * v + c[at]) * v + c[at + 1], return_inverse=True)
            three, place = np.unique(place * v + c[at + 2], return_inverse=True)
            last = np.where((left[at] >= 4) & often[at + 2], c[np.minimum(at + 3, len(c) - 1)] + 1, 0)
            four, n_four, _ = summed(place * (v + 1) + last, weight[at])
            window = three[four // (v + 1)]
            first = two[window // v]
            self.tables.append(self.gram(3, [first // v % v, first % v, window % v], first // v // v, n_four, four % (v + 1)))

    def gram(self, words: int, codes: list[np.ndarray], lang: np.ndarray, m: np.ndarray, behind: np.ndarray | None = None) -> tuple[pa.Table, np.ndarray]:
        """A table of phrases, and the bucket of each."""
        hashed = phrase_hash([self.hash[c] for c in codes])
        phrase = pc.binary_join_element_wise(*(self.words.take(pa.array(c)) for c in codes), " ") if words > 1 else self.words.take(pa.array(codes[0]))
        last = pa.nulls(len(m), pa.string()) if behind is None else self.words.take(pa.array(behind - 1, mask=behind == 0))
        table = pa.table([self.langs.take(pa.array(lang)), pa.array(np.full(len(m), words, np.int8)), phrase, last, pa.array(m)], schema=GRAM_SCHEMA)
        return table, (hashed % self.buckets).astype(np.int64)

    def parcels(self):
        """(bucket, parcel) of each bucket that gets something."""
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        sorted_tables = []
        for table, bucket in self.tables:
            order = np.argsort(bucket, kind="stable")  # phrases stay in order, which compresses well
            sorted_tables.append((table.take(pa.array(order)), np.searchsorted(bucket[order], np.arange(int(self.buckets) + 1))))
        for b in range(int(self.buckets) if sorted_tables else 0):
            parts = [t.slice(at[b], at[b + 1] - at[b]) for t, at in sorted_tables if at[b + 1] > at[b]]
            if parts:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, GRAM_SCHEMA, options=options) as writer:
                    writer.write_table(pa.concat_tables(parts).combine_chunks())
                yield b, sink.getvalue().to_pybytes()


def parcels(distinct: DataFrame, buckets: int, chunk: int = CHUNK, pairs: PairMap | None = None) -> DataFrame:
    """(bucket, parcel): compressed n-grams of distinct pieces with their weights; see Chunk."""
    known = None if pairs is None else distinct.sparkSession.sparkContext.broadcast(pairs)

    def cut(held: list[tuple]):
        values = pa.concat_arrays([h[0] for h in held])
        left, weight, code = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
        names = list(dict.fromkeys(x for h in held for x in h[4]))
        # Codes of a batch's languages become those of all.
        code = np.concatenate([np.array([names.index(x) for x in h[4]], np.int64)[h[3]] for h in held])
        for at in range(0, len(values), chunk):
            end = min(len(values), at + chunk)
            far = min(len(values), end + LONGEST - 1)
            got = list(Chunk(values.slice(at, far - at), left[at:end], weight[at:end], code[at:end], end - at, names, buckets, known and known.value).parcels())
            for first in range(0, len(got), 64):
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in got[first : first + 64]], pa.int32()), pa.array([x for _, x in got[first : first + 64]], pa.binary())], names=["bucket", "parcel"])

    @lean
    def run(batches):
        held, size = [], 0
        for batch in batches:
            lists = pc.split_pattern(batch.column(1), " ")
            ends = lists.offsets.to_numpy()
            lengths = np.diff(ends)
            values = lists.values.slice(ends[0], ends[-1] - ends[0])
            left = np.minimum(np.repeat(ends[1:] - ends[0], lengths) - np.arange(len(values)), LONGEST).astype(np.int8)
            coded = batch.column(0).dictionary_encode()
            held.append((values, left, np.repeat(batch.column(2).to_numpy(), lengths), np.repeat(coded.indices.to_numpy().astype(np.int64), lengths), coded.dictionary.to_pylist()))
            size += len(values)
            if size >= chunk:
                yield from cut(held)
                held, size = [], 0
        if size:
            yield from cut(held)

    return bounded_batches(distinct).select("lang", "piece", "m").mapInArrow(run, PARCEL_SCHEMA)


def counted(parcel: DataFrame, least: int, buckets: int) -> DataFrame:
    """(lang, words, phrase, f) of the phrases of one to four words that occur `least` times, and each bucket's words."""
    import duckdb

    sql = f"""
        SELECT lang, words, phrase, CAST(sum(m) AS BIGINT) AS f FROM grams WHERE words < 3 GROUP BY ALL HAVING sum(m) >= {least}
        UNION ALL SELECT lang, words, phrase, CAST(sum(m) AS BIGINT) FROM grams WHERE words = 3 GROUP BY ALL HAVING sum(m) >= {least}
        UNION ALL SELECT lang, 4, phrase || ' ' || behind, CAST(sum(m) AS BIGINT) FROM grams WHERE behind IS NOT NULL GROUP BY lang, phrase, behind HAVING sum(m) >= {least}
        UNION ALL SELECT lang, 0, '', CAST(sum(m) AS BIGINT) FROM grams WHERE words = 1 GROUP BY lang"""

    @lean
    def run(batches):
        with tempfile.TemporaryDirectory() as spill:
            con = duckdb.connect(config={"memory_limit": MEMORY, "threads": 1, "temp_directory": spill, "preserve_insertion_order": False})
            try:
                con.execute("CREATE TABLE grams (lang VARCHAR, words TINYINT, phrase VARCHAR, behind VARCHAR, m BIGINT)")
                for batch in batches:
                    for parcel in batch.column(0):
                        got = pa.ipc.open_stream(parcel.as_buffer()).read_all()  # noqa: F841  named in the statement
                        con.execute("INSERT INTO grams SELECT * FROM got")
                for found in con.sql(sql).to_arrow_reader(1 << 16):
                    yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(found.columns, (pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["lang", "words", "phrase", "f"])
            finally:
                con.close()

    return parcel.repartitionById(buckets, F.col("bucket")).select("parcel").mapInArrow(run, COUNT_SCHEMA)


def frequent_pairs(counts: DataFrame, bits_each: int = PAIR_BITS) -> PairMap:
    """The map of the pairs among counts: bits are set where they are, and at most MAP_BITS come to the driver."""
    rows = counts.where("words = 2").select("phrase")
    size = min(MAP_BITS, max(64, 1 << int(rows.count() * bits_each).bit_length()))

    @lean
    def run(batches):
        for batch in batches:
            both = [p.split(" ") for p in batch.column(0).to_pylist()]
            place = phrase_hash([word_hashes([p[i] for p in both]) for i in range(2)]) % np.uint64(size)
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int64))], names=["place"])

    bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
    got = rows.mapInArrow(run, "place long").groupBy(F.expr("place div 64").alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()
    return PairMap(got["slot"].to_numpy(), got["bits"].to_numpy().view(np.uint64), size)


def scored(counts: DataFrame) -> DataFrame:
    """Candidates with their lowest-scoring cut: lang, words, phrase, a, l, r, score; parts are looked up where they are."""
    candidates = counts.where("words >= 2").withColumnRenamed("f", "a")
    cut = candidates.withColumn("k", F.explode(F.expr("sequence(1, words - 1)"))).withColumn("head", F.expr("substring_index(phrase, ' ', k)"))
    requests = cut.withColumn("rest", F.expr("substring(phrase, length(head) + 2)"))
    for part, name in (("head", "l"), ("rest", "r")):
        answers = counts.where("words > 0").select(F.col("lang").alias("of_lang"), F.col("phrase").alias("of_phrase"), F.col("f").alias(name))
        requests = requests.join(answers, (F.col("lang") == F.col("of_lang")) & (F.col(part) == F.col("of_phrase"))).drop("of_lang", "of_phrase")
    # Whole-number division of decimals: exact beyond 64 bits.
    score = F.expr(f"(cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = F.min(F.struct(score.alias("score"), F.col("k"), F.col("l"), F.col("r"))).alias("cut")
    return requests.groupBy("lang", "words", "phrase", "a").agg(lowest).select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def covered(counts: DataFrame, percent: int) -> DataFrame:
    """(lang, phrase, most): how often the most frequent longer candidate around a phrase occurs."""
    longer = counts.where("words >= 3").withColumn("w", F.split("phrase", " "))
    inner = F.expr("flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1), i -> array_join(slice(w, i, n), ' '))))")
    return longer.select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def first_of_each(rows: DataFrame, first: int) -> DataFrame:
    """rank and the first rows of each language: firsts of its parts, then firsts of these."""
    order = "order by score desc, a desc, phrase"
    parts = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = parts.withColumn("rank", F.expr(f"row_number() over (partition by lang, part {order})")).where(F.col("rank") <= first)
    return some.withColumn("rank", F.expr(f"cast(row_number() over (partition by lang {order}) as bigint)")).where(F.col("rank") <= first).drop("part")


def collocations(docs: DataFrame, least: int = LEAST_COUNT, percent: int = COVERED_PERCENT, first: int = FIRST, chunk: int = CHUNK) -> DataFrame:
    """Per language its best-scoring phrases: lang, rank, phrase, a, l, r, n, score."""
    buckets = shuffle_width(docs.sparkSession)
    distinct = materialise(pieces(docs), "pieces")
    short = materialise(counted(parcels(distinct, buckets, chunk), least, buckets), "phrase-counts")
    long = materialise(counted(parcels(distinct, buckets, chunk, frequent_pairs(short)), least, buckets), "phrase-counts")
    counts = short.unionByName(long)
    total = counts.where("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    around = covered(counts, percent).withColumnsRenamed({"lang": "of_lang", "phrase": "of_phrase"})
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    alone = F.col("most").isNull() | (wide("most") * 100 < wide("a") * percent)
    kept = scored(counts).join(around, (F.col("lang") == F.col("of_lang")) & (F.col("phrase") == F.col("of_phrase")), "left").where(alone)
    best = first_of_each(kept.select("lang", "phrase", "a", "l", "r", "score"), first)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
