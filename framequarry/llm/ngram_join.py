"""Jaccard join on word n-grams: a blocked sparse product of the document by n-gram incidence with itself.

Rows of the incidence are distinct shingle sets, columns are shingles; the product's entries are overlaps of sets. Columns
are ordered, the same way for all sets: those that several of a sample of SAMPLED documents have come last, which only
decides how much work there is.
Two sets that reach the similarity share a shingle in the first columns of both, as many as their sizes leave free, so
the product's first stripe of columns decides which entries can matter at all:

* The stripe is a table sorted by column, size and row, range-partitioned over all three, so a column that a third of all
  rows have spreads over tasks. Each task reads it as a stream and keeps the columns that several rows have. Neighbours
  in it give the first entries, of which each row tries the nearest first.
* Rows that are linked need no further entries among themselves. What is left of the stripe, between different
  components, is multiplied whole, in cells of bounded size, with pairs dropped by the bounds that sizes, places in the
  order and parities of 512 blocks of columns set to their overlap.
* The entries that remain are accumulated over the blocks of all columns, on the full sets, the first block alone and then
  the others; a pair goes as soon as its overlap so far and what both sets still have fall below what their sizes need.

Rounds end when no entry is left between components, so no link is lost and no pairs inside a component are listed.

Defined cases: null and empty texts, and texts without words, have no set and link with nothing; fewer words than a shingle
make one shingle of the whole; a text of any length is one row, read on its own; a null doc_id is never linked: its
component is null; rows of one id and text are one set, and each is returned; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framequarry.llm.near_dedup import BROADCAST_IDS, PARITY, best_pairs, least_overlap, members, plain, remaining_pairs, shingle_set
from framequarry.operators.components import connected_components
from framequarry.runtime import lean, materialise, shuffle_width

#: Documents, about, whose shingles tell which are frequent, and how many of those are told apart: for the order alone.
SAMPLED, FREQUENT = 20_000, 500_000
#: The first block of columns holds one in so many of them; of the others, blocks hold about so many of the larger set.
FIRST_BLOCK, COLUMN_BLOCK = 8, 2048

ROW_SCHEMA = "doc_id long, n_shingles long, set_hash binary, parity binary, prefix array<long>"
STRIPE_SCHEMA = "a long, b long, shingle long, rep long, n long, pos long"


def frequent_columns(docs: DataFrame, words_per: int) -> tuple[np.ndarray, np.ndarray]:
    """At most FREQUENT shingles that several sampled documents have, sorted, and how many have them."""

    @lean
    def run(batches):
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), words_per).view(np.int64))], names=["shingle"])

    one_in = max(1, docs.count() // SAMPLED)
    sample = plain(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).select("text")
    counts = sample.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    got = counts.orderBy(F.desc("held"), "shingle").limit(FREQUENT).toArrow()
    shingles, held = got["shingle"].to_numpy().view(np.uint64), got["held"].to_numpy()
    order = np.argsort(shingles)
    return shingles[order], held[order]


def first_columns(x: np.ndarray, often: np.ndarray, count: int) -> np.ndarray:
    """The first `count` of the sorted shingles x in the order of (often, x)."""
    bound = np.partition(often, count - 1)[count - 1]
    less = np.flatnonzero(often < bound)
    less = less[np.argsort(often[less], kind="stable")]
    return x[np.concatenate([less, np.flatnonzero(often == bound)[: count - len(less)]])]


def prefix_length(n: int, percent: int) -> int:
    """First columns of a set of n shingles, of which it shares one with every set that reaches the similarity."""
    return n + percent * -n // 100 + 1


def incidence(docs: DataFrame, words_per: int, percent: int) -> DataFrame:
    """Per document the size and hash of its set, parities of PARITY column blocks, and its first columns in order."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_columns(docs, words_per))

    @lean
    def run(batches):
        known, held = frequent.value
        for batch in batches:
            ids = batch.column(0)
            for first in range(0, batch.num_rows, 1000):
                sizes, hashes, parity, prefix = [], [], [], []
                for text in batch.column(1)[first : first + 1000]:
                    x = shingle_set(text.as_py(), words_per)
                    sizes.append(len(x))
                    hashes.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                    parity.append(np.packbits((np.bincount((x % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)).tobytes())
                    at = np.minimum(np.searchsorted(known, x), max(0, len(known) - 1))
                    often = np.where(known[at] == x, held[at], 0) if len(known) else np.zeros(len(x), np.int64)
                    prefix.append(first_columns(x, often, prefix_length(len(x), percent)).view(np.int64) if len(x) else [])
                yield pa.RecordBatch.from_arrays([ids[first : first + 1000], pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.array(parity, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_hash", "parity", "prefix"])

    return plain(docs).mapInArrow(run, ROW_SCHEMA)


def first_stripe(classes: DataFrame, percent: int) -> DataFrame:
    """The columns (shingle, rep, n, pos) that several rows have, in order, and as (a, b) pairs of neighbours in a column
    that can reach the similarity. A partition's first and last column may go on beyond its border and are kept."""
    names = ["a", "b", "shingle", "rep", "n", "pos"]

    def found(*columns):
        """Pairs (a, b), or rows (shingle, rep, n, pos)."""
        nothing = pa.nulls(len(columns[0]), pa.int64())
        arrays = [pa.array(c, pa.int64()) for c in columns]
        return pa.RecordBatch.from_arrays([*arrays, *[nothing] * 4] if len(columns) == 2 else [nothing, nothing, *arrays], names=names)

    @lean
    def run(batches):
        held, follows = None, True  # the last row so far, and whether it stays; a partition's first row does
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            shingle, rep, n, pos = (table[c].to_numpy() for c in names[2:])
            same = shingle[1:] == shingle[:-1]
            keep = np.concatenate([[follows], same])
            keep[:-1] |= same
            rows = np.flatnonzero(keep[:-1])
            yield found(shingle[rows], rep[rows], n[rows], pos[rows])
            i = np.flatnonzero(same)
            needed = least_overlap(n[i], n[i + 1], percent)
            i = i[(needed <= n[i] - pos[i]) & (needed <= n[i + 1] - pos[i + 1]) & (rep[i] != rep[i + 1])]
            if len(i):
                yield found(*np.unique(np.stack([np.minimum(rep[i], rep[i + 1]), np.maximum(rep[i], rep[i + 1])]), axis=1))
            held, follows = table.slice(table.num_rows - 1), bool(keep[-1])
        if held is not None:
            yield found(*(held[c].to_numpy() for c in names[2:]))

    order = ["shingle", "n", "rep"]
    rows = classes.select("rep", "n", F.posexplode("prefix").alias("pos", "shingle")).select("shingle", "rep", "n", F.col("pos").cast("long").alias("pos"))
    return rows.repartitionByRange(shuffle_width(classes.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(run, STRIPE_SCHEMA)


def needed_overlap(n: int, m: int, percent: int) -> int:
    return -(-percent * (n + m) // (100 + percent))


def shared(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def reaches(x: np.ndarray, y: np.ndarray, needed: int, count: int = 0) -> bool:
    """Whether count and the overlap of two sorted sets, added up over blocks of columns, reach what is needed."""
    wide, at, to = x if len(x) > len(y) else y, 0, 0
    for k in range(0, len(wide), COLUMN_BLOCK):
        if count + min(len(x) - at, len(y) - to) < needed:
            return False
        last = k + COLUMN_BLOCK >= len(wide)
        end, stop = (len(x), len(y)) if last else (int(np.searchsorted(x, wide[k + COLUMN_BLOCK])), int(np.searchsorted(y, wide[k + COLUMN_BLOCK])))
        count += shared(x[at:end], y[to:stop])
        at, to = end, stop
    return count >= needed


def accumulated(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The entries (a, b) whose overlap over all columns reaches the similarity; sets: rep, n, first and others (see
    set_blocks). The first block drops most that have little in common, before whole sets travel."""
    numbers = lambda x: np.frombuffer(x.as_py(), np.uint64)

    def both(rows, column, *also):
        for end in ("a", "b"):
            rows = rows.join(sets.select(F.col("rep").alias(end), F.col(column).alias(f"{column}_{end}"), *(F.col(c).alias(f"{c}_{end}") for c in also)), end)
        return rows

    @lean
    def begin(batches):
        for batch in batches:
            keep, counts, needs = [], [], []
            for x, y, n, m in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                x, y, needed = numbers(x), numbers(y), needed_overlap(n, m, percent)
                counts.append(shared(x, y))
                needs.append(needed)
                keep.append(counts[-1] + min(n - len(x), m - len(y)) >= needed)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in (batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(needs, pa.int64()))], names=["a", "b", "count", "needed"])

    @lean
    def finish(batches):
        for batch in batches:
            hit = [reaches(numbers(x), numbers(y), needed, count) for count, needed, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5))]
            mask = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    begun = both(pairs.select("a", "b"), "first", "n").select("a", "b", "first_a", "first_b", "n_a", "n_b").mapInArrow(begin, "a long, b long, count long, needed long")
    begun = materialise(begun, "begun")
    return both(begun, "others").select("a", "b", "count", "needed", "others_a", "others_b").mapInArrow(finish, "a long, b long")


def within_parity(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Adds differ, the column blocks whose parities differ; pairs that sizes and parities rule out go."""
    for end in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("rep").alias(end), F.col("n").alias(f"n_{end}"), F.col("parity").alias(f"parity_{end}")), end)

    @lean
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (4, 5))
            differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            ok = pa.array(n + m - 2 * least_overlap(n, m, percent) >= differ)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok), pa.array(differ, pa.int64()).filter(ok)], names=["a", "b", "differ"])

    return pairs.select("a", "b", "n_a", "n_b", "parity_a", "parity_b").mapInArrow(run, "a long, b long, differ long")


def set_blocks(docs: DataFrame, ids: DataFrame, words_per: int) -> DataFrame:
    """(rep, n, first, others) of the documents among ids: sizes, and sorted shingles of the first block of columns and of
    all others."""
    bound = np.uint64((1 << 64) // FIRST_BLOCK)

    @lean
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = [shingle_set(t.as_py(), words_per) for t in batch.column(1)[at : at + 500]]
                cut = [int(np.searchsorted(x, bound)) for x in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 500], pa.array([len(x) for x in sets], pa.int64()), pa.array([x[:k].tobytes() for x, k in zip(sets, cut)], pa.binary()), pa.array([x[k:].tobytes() for x, k in zip(sets, cut)], pa.binary())], names=["rep", "n", "first", "others"])

    wanted = plain(docs).join(ids, F.col("doc_id") == F.col("rep"), "left_semi")
    return wanted.mapInArrow(run, "rep long, n long, first binary, others binary").dropDuplicates(["rep"])


def sets_of(docs: DataFrame, pairs: DataFrame, words_per: int, known: DataFrame | None = None) -> DataFrame:
    """Set blocks of the ends of pairs, besides those known."""
    ids = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    if known is not None:
        ids = ids.join(known.select("rep"), "rep", "left_anti")
    ids = materialise(ids, "pair-ids")
    few = ids.count() <= BROADCAST_IDS
    found = materialise(set_blocks(docs, F.broadcast(ids) if few else ids, words_per), "shingle-sets")
    return found if known is None else known.unionByName(found)


def linked(docs: DataFrame, classes: DataFrame, words_per: int, percent: int) -> DataFrame:
    """(node, component) over the representatives that links connect."""
    stripe = materialise(first_stripe(classes, percent), "stripe")
    neighbours = stripe.where("a is not null").select("a", "b").distinct()
    pairs = materialise(within_parity(neighbours, classes, percent), "pairs")
    best = materialise(best_pairs(pairs), "best-pairs")
    sets = sets_of(docs, best, words_per)
    links = materialise(accumulated(best, sets, percent), "links")
    labels = materialise(connected_components(links, "a", "b"), "labels")
    columns = stripe.where("a is null").select("shingle", "rep", "n", "pos").join(classes.select("rep", "parity"), "rep")
    # First the nearest pair of any two components in a block of columns, which joins most of what belongs together.
    for nearest in (True, False):
        left = materialise(remaining_pairs(columns, labels, percent / 100, nearest), "left-pairs")
        if left.isEmpty():
            break
        sets = sets_of(docs, left, words_per, sets)
        more = materialise(accumulated(left, sets, percent), "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = materialise(connected_components(links, "a", "b"), "labels")
    return labels


def jaccard_join(docs: DataFrame, words_per: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the least doc_id that links of the similarity reach."""
    rows = materialise(incidence(docs, words_per, percent), "incidence")
    usable = rows.where("n_shingles > 0 and doc_id is not null")
    classes = materialise(usable.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("parity").alias("parity"), F.first("prefix").alias("prefix")), "set-classes")
    labels = linked(docs, classes.select("rep", "n", "parity", "prefix"), words_per, percent)
    return members(rows, classes, labels).select("doc_id", "n_shingles", "component_id")


def jaccard_digests(docs: DataFrame) -> DataFrame:
    return jaccard_join(docs, words_per=3, percent=90)
