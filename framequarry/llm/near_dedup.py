"""Near-duplicate detection with an LSH forest, confirmed on full shingle sets.

Sketch: every text's set of word shingles is hashed to 64 bits a shingle; 192 minhashes make the signatures of 24
trees, each of depth 8. Equal sets (by a 128-bit hash of the whole set) are one class with one representative.

Forest: each tree is one sorted order of all representatives by their signature, range-partitioned over (tree,
signature, id), so that even a region that holds a third of all rows spreads over many tasks. Candidates are neighbours
by longest common prefix: at least FLOOR values must agree; where a region (rows that share a prefix) has more than
CROWD rows, it is cut at the next depth, and so on, so depth adapts to each region's density. Rows of a region within
CROWD are all compared; a row of a crowded region meets the CROWD rows on either side of it, which in sorted order are
those with the longest common prefixes, and keeps in each tree the BEST of them by signature bits, besides all that
chose it. A task reads its rows as a stream of CHUNK rows, each with enough of its neighbours to judge regions whole.
Rows at a partition's ends meet those beyond the border, over as many partitions as the window spans, in a second,
narrow step. Pairs whose sizes rule out the similarity go at once, exactly; so do pairs whose 192 signature bits lie
more than six standard deviations below what a link has (one link in 10^9).

Confirmation: the set of each document that has a candidate is built once more and pairs are compared on full sets.
The two best pairs of each document go first; pairs inside a component thus found need no comparison any more, and the
others all follow. What the windows leave out in crowded regions is found
exactly: the rows of those regions are joined on the prefixes of their sets, between different components only, and what
sizes and parity maps do not rule out is compared on full sets, until no link is left. A shingle that many rows share
is dealt to cells of at most about two times HELD rows, which together hold every pair once. Components come from
alternating star contraction.

Defined cases: null and empty texts, and texts without words, have no set, link with nothing and stay; fewer words than
a shingle make one shingle of the whole; a null doc_id is never linked: its component is null and it is kept; of
equal rows (one id) each is returned, in one class; an empty table gives no rows; other columns of the input are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from framequarry.operators.components import connected_components
from framequarry.runtime import bounded_batches, lean, materialise, shuffle_width

TREES, DEPTH, FLOOR = 24, 8, 4
MINHASHES = TREES * DEPTH
#: BEST only decides which pairs of a crowded region are tried first: an exact join finds all links that it leaves out.
CROWD, BEST = 32, 2
#: Rows of a sorted order that a task handles at a time, and rows on either side that it sees with them.
CHUNK, CONTEXT = 1 << 15, 3 * CROWD
#: Of MINHASHES signature bits, a link at 0.8 differs in 0.1 of them on average; six deviations more are let through.
BITS_SLACK = 6.0
#: Bits of a set's parity map, and rows of a component that one task of the exact join holds of one shingle.
PARITY, HELD = 512, 4096
#: Documents whose shingles tell which are frequent, and how many of those are told apart: for the order alone.
SAMPLED, FREQUENT = 2000, 100_000
#: Ids that a semi-join may broadcast; beyond it the join shuffles.
BROADCAST_IDS = 500_000

SKETCH_SCHEMA = "doc_id long, n_shingles long, set_hash binary, signature binary, bits binary"
FOREST_SCHEMA = "a long, b long, differ int, edge long, side int, place int, key binary, rep long, n long, bits binary"

_rng = np.random.default_rng(20)
_MULTIPLY = (_rng.integers(0, 1 << 32, MINHASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_FLIP = _rng.integers(0, 1 << 32, MINHASHES, dtype=np.uint64).astype(np.uint32)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Hashes of words that a worker has met lately, and how many.
_CACHE: dict[bytes, int] = {}
CACHED = 50_000


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _B
    h = (h ^ (h >> np.uint64(29))) * _C
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str, words_per: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text, in lower case for A-Z."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_CACHE) > CACHED:
        _CACHE.clear()
    for w in dict.fromkeys(words):
        if w not in _CACHE:
            _CACHE[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_CACHE.__getitem__, words), np.uint64, len(words))
    n = min(words_per, len(words))
    made = np.full(len(words) - n + 1, np.uint64(n))
    for k in range(n):
        made = mixed(made * _A + h[k : len(words) - n + 1 + k])
    return np.unique(made)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """MINHASHES minima of multiplied 32-bit hashes."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINHASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 1024):  # a block of the product stays in the processor's cache
        out = np.minimum(out, ((h[at : at + 1024][None, :] ^ _FLIP[:, None]) * _MULTIPLY[:, None]).min(axis=1))
    return out


def sketches(docs: DataFrame, words_per: int) -> DataFrame:
    """doc_id, size and hash of the shingle set, signatures of all trees (big-endian, so bytes sort like values), bits."""

    @lean
    def run(batches):
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first in range(0, len(doc_ids), 1000):
                sizes, hashes, signatures, bits = [], [], [], []
                for text in batch.column(1)[first : first + 1000]:
                    got = shingle_set(text.as_py(), words_per)
                    sizes.append(len(got))
                    hashes.append(hashlib.blake2b(got.tobytes(), digest_size=16).digest())
                    low = minhashes(got)
                    signatures.append(low.astype(">u4").tobytes())
                    bits.append(np.packbits((low ^ (low >> np.uint32(16))) & np.uint32(1)).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[first : first + 1000], pa.int64()), pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in (hashes, signatures, bits))], names=["doc_id", "n_shingles", "set_hash", "signature", "bits"])
        _CACHE.clear()

    return plain(docs).mapInArrow(run, SKETCH_SCHEMA)


def plain(docs: DataFrame) -> DataFrame:
    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def pairs_in_order(rows: dict, similarity: float, low: int = 0, high: int | None = None, border: int | None = None):
    """Candidates (i, j, differing bits) among rows in sorted order, i from low to before high.

    rows: key (rows x (1 + 4 * DEPTH) bytes, tree first), rep, n and bits; where they go on before low or after high,
    CONTEXT rows of that are among them. border: only pairs of a row before it with one from it on.
    """
    key, n, bits = (rows[c] for c in ("key", "n", "bits"))
    count = len(key)
    high = count if high is None else high
    if count < 2:
        return
    differs = (key[1:] != key[:-1]).argmax(axis=1)  # first byte that differs; 0 also where none does
    same = (key[1:] == key[:-1]).all(axis=1)
    lcp = np.where(same, DEPTH, np.maximum(0, differs - 1) // 4)  # whole values shared with the next row
    lcp[(differs == 0) & ~same] = -1
    run, room, crowded = [], [], []
    for depth in range(FLOOR, DEPTH + 1):
        group = np.cumsum(np.concatenate([[True], lcp < depth])) - 1
        run.append(group)
        room.append(np.bincount(group)[group] <= CROWD)
    first = max(0, low - CROWD)  # pairs from here on compete for the best of a row's neighbours
    for lag in range(1, min(CROWD, count)):
        i = np.arange(first, min(count - lag, high + CROWD))
        if border is not None:
            i = i[(i < border) & (i + lag >= border)]
        i = i[run[0][i] == run[0][i + lag]]
        if not len(i):
            if border is None:
                break
            continue
        j = i + lag
        fits = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9
        i, j = i[fits], j[fits]
        for at in range(0, len(i), 1 << 14):
            x, y = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            differ = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1)
            ok = differ <= most_differing_bits(similarity)
            x, y, differ = x[ok], y[ok], differ[ok]
            close = np.zeros(len(x), bool)
            for group, roomy in zip(run, room):
                close |= roomy[x] & (group[x] == group[y])
            own = close & (x >= low) & (x < high)
            yield x[own], y[own], differ[own]
            if not close.all():
                crowded.append((x[~close], y[~close], differ[~close]))
    if crowded:
        i, j, differ = (np.concatenate(c) for c in zip(*crowded))
        take = np.zeros(len(i), bool)
        for end in (i, j):  # the best of each row's later, then earlier, neighbours; ties by nearness
            order = np.lexsort((j - i, differ, end))
            sorted_end = end[order]
            rank = np.arange(len(order)) - np.searchsorted(sorted_end, sorted_end)
            take[order[rank < BEST]] = True
        take &= (i >= low) & (i < high)
        yield i[take], j[take], differ[take]


def crowded_rows(key: np.ndarray, opens: bool = False, closes: bool = False) -> np.ndarray:
    """Which rows, in sorted order, lie in a region of more than CROWD rows that share FLOOR values. opens, closes: the
    first, or last, region may go on beyond a partition's border and counts double; one that does at both ends counts
    as crowded."""
    head = key[:, : 1 + 4 * FLOOR]
    region = np.cumsum(np.concatenate([[True], (head[1:] != head[:-1]).any(axis=1)])) - 1
    size = np.bincount(region)
    if len(size) == 1 and opens and closes:
        size[0] = CROWD + 1
    else:
        size[0] *= 1 + opens
        size[-1] *= 1 + closes
    return size[region] > CROWD


def chunks(batches):
    """(rows, low, high) of a sorted stream: rows low to high are new, with CONTEXT rows, where there are any, around."""
    held, low = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        own = pa.Table.from_batches([batch])
        held = own if held is None else pa.concat_tables([held, own])
        high = held.num_rows - CONTEXT
        if high - low >= CHUNK:
            yield held, low, high
            start = max(0, high - CONTEXT)
            held, low = held.slice(start), high - start
    if held is not None:
        yield held, low, held.num_rows


def most_differing_bits(similarity: float) -> int:
    p = (1 - similarity) / 2
    return int(np.ceil(MINHASHES * p + BITS_SLACK * np.sqrt(MINHASHES * p * (1 - p))))


def fixed(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


PAIR_NAMES, ROW_NAMES = ["a", "b", "differ"], ["key", "rep", "n", "bits"]
ROW_TYPES = [pa.binary(), pa.int64(), pa.int64(), pa.binary()]


def arrays_of(table: pa.Table) -> dict:
    return {"key": fixed(table["key"], 1 + 4 * DEPTH), "bits": fixed(table["bits"], MINHASHES // 8)} | {c: table[c].to_numpy() for c in ("rep", "n")}


def pair_columns(rep, i, j, differ) -> list[pa.Array]:
    return [pa.array(np.minimum(rep[i], rep[j]), pa.int64()), pa.array(np.maximum(rep[i], rep[j]), pa.int64()), pa.array(differ, pa.int32())]


def candidates(reps: DataFrame, similarity: float) -> DataFrame:
    """Distinct candidate pairs (a < b) with their differing bits; reps: rep, n, signature, bits.

    Rows of crowded regions, whose windows may leave neighbours out, follow as pairs of a row with itself."""
    width = 4 * DEPTH
    names = [*PAIR_NAMES, "edge", "side", "place", *ROW_NAMES]

    def with_edge(table, part, side):
        nothing = [pa.nulls(table.num_rows, t) for t in (pa.int64(), pa.int64(), pa.int32())]
        where = [pa.array(np.full(table.num_rows, v), t) for v, t in ((part, pa.int64()), (side, pa.int32()), (0, pa.int32()))]
        return pa.RecordBatch.from_arrays([*nothing, *where, *(pa.array(table[c].to_pylist(), t) for c, t in zip(ROW_NAMES, ROW_TYPES))], names=names)

    def pairs_batch(rep, i, j, differ):
        nothing = [pa.nulls(len(i), t) for t in (pa.int64(), pa.int32(), pa.int32(), *ROW_TYPES)]
        return pa.RecordBatch.from_arrays([*pair_columns(rep, i, j, differ), *nothing], names=names)

    @lean
    def in_partition(batches):
        me, head, seen, table = TaskContext.get().partitionId(), 1 + 4 * FLOOR, 0, None
        for table, low, high in chunks(batches):
            rows = arrays_of(table)
            for i, j, differ in pairs_in_order(rows, similarity, low, high):
                if len(i):
                    yield pairs_batch(rows["rep"], i, j, differ)
            last = high == table.num_rows
            crowded = low + np.flatnonzero(crowded_rows(rows["key"], not seen, last)[low:high])
            yield pairs_batch(rows["rep"], crowded, crowded, np.zeros(len(crowded), np.int64))
            if not seen:
                yield with_edge(table.take(pa.array(np.flatnonzero((rows["key"][:CROWD, :head] == rows["key"][0, :head]).all(axis=1)))), me, 1)
            seen += high - low
        if table is not None:
            ends = table.slice(max(0, table.num_rows - CROWD))
            key = fixed(ends["key"], width + 1)
            yield with_edge(ends.take(pa.array(np.flatnonzero((key[:, :head] == key[-1, :head]).all(axis=1)))), me, 0)
            nothing = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int32())]
            counted = [pa.array([v], t) for v, t in ((me, pa.int64()), (2, pa.int32()), (min(seen, CROWD), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*nothing, *counted, *(pa.nulls(1, t) for t in ROW_TYPES)], names=names)

    def across(got):
        got = got.sort_by([("side", "ascending"), ("key", "ascending"), ("rep", "ascending")])
        border = int((got["side"].to_numpy() == 0).sum())
        rows = arrays_of(got)
        nothing = np.zeros(0, np.int64)
        found = list(pairs_in_order(rows, similarity, border=border)) if 0 < border < got.num_rows else []
        i, j, differ = (np.concatenate(c) for c in zip(*found)) if found else (nothing, nothing, nothing)
        more = np.flatnonzero(crowded_rows(rows["key"]))
        i, j, differ = np.concatenate([i, more]), np.concatenate([j, more]), np.concatenate([differ, np.zeros(len(more), np.int64)])
        return pa.table(pair_columns(rows["rep"], i, j, differ), names=PAIR_NAMES)

    trees = reps.select("rep", "n", "bits", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    key = F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")), F.expr(f"substring(signature, tree * {width} + 1, {width})"))
    rows = trees.select(key.alias("key"), "rep", "n", "bits")
    ordered = rows.repartitionByRange(shuffle_width(reps.sparkSession), "key", "rep").sortWithinPartitions("key", "rep")
    found = materialise(ordered.mapInArrow(in_partition, FOREST_SCHEMA), "forest")
    # As many rows as there are partitions: how many rows, up to a window, each has.
    counts = {r["edge"]: r["place"] for r in found.where("side = 2").select("edge", "place").collect()}
    reached = reps.sparkSession.createDataFrame(borders(counts), "part long, of_side int, border long")
    ends = found.where("side < 2").join(F.broadcast(reached), (F.col("edge") == F.col("part")) & (F.col("side") == F.col("of_side")))
    crossing = ends.select("border", "side", *ROW_NAMES).groupBy("border").applyInArrow(across, "a long, b long, differ int")
    return found.where("edge is null").select("a", "b", "differ").unionByName(crossing).groupBy("a", "b").agg(F.min("differ").alias("differ"))


def borders(counts: dict[int, int]) -> list[tuple[int, int, int]]:
    """(partition, side, border) for the rows at the ends of partitions: a border is named by the partition behind it, and
    is reached by the last rows (side 0) and first rows (side 1) of all partitions within CROWD rows of it."""
    parts, out = sorted(counts), []
    for at in range(1, len(parts)):
        for side, near in ((0, reversed(parts[:at])), (1, parts[at:])):
            between = 0
            for part in near:
                out.append((part, side, parts[at]))
                between += counts[part]
                if between >= CROWD:
                    break
    return out


def full_sets(docs: DataFrame, ids: DataFrame, words_per: int) -> DataFrame:
    """(rep, shingles) of the documents whose id is among ids."""

    @lean
    def run(batches):
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first in range(0, len(doc_ids), 500):
                sets = [shingle_set(t.as_py(), words_per).tobytes() for t in batch.column(1)[first : first + 500]]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[first : first + 500], pa.int64()), pa.array(sets, pa.binary())], names=["rep", "shingles"])
        _CACHE.clear()

    wanted = plain(docs).join(ids, F.col("doc_id") == F.col("rep"), "left_semi")
    return wanted.mapInArrow(run, "rep long, shingles binary").dropDuplicates(["rep"])


def confirm(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    percent = round(similarity * 100)

    @lean
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["a", "b"])

    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def frequent_shingles(sets: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of a sample of sets have, sorted, and in how many."""

    def run(batches):
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_py(), np.int64))], names=["shingle"])

    sample = sets.where(F.pmod(F.xxhash64("rep"), F.lit(max(1, rows // SAMPLED))) == 0).select("shingles")
    counts = sample.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).where("held > 2")
    got = counts.orderBy(F.desc("held"), "shingle").limit(FREQUENT).toArrow()
    shingles, held = got["shingle"].to_numpy().view(np.uint64), got["held"].to_numpy()
    order = np.argsort(shingles)
    return shingles[order], held[order]


def prefixes(sets: DataFrame, rows: int, similarity: float) -> DataFrame:
    """rep, n, parity and prefix of every set.

    prefix: the first shingles in an order that is the same for all sets (frequent ones last), as many as a set that
    reaches the similarity must share one of. parity: for each of PARITY bits, whether an odd number of shingles falls
    on it; two maps differ in no more bits than the sets differ in shingles.
    """
    percent = round(similarity * 100)
    shingles, held = frequent_shingles(sets, rows)

    @lean
    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                sizes, parity, prefix = [], [], []
                for x in batch.column(1)[first : first + 500]:
                    x = np.frombuffer(x.as_py(), np.uint64)
                    sizes.append(len(x))
                    parity.append(np.packbits((np.bincount((x % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)).tobytes())
                    at = np.searchsorted(shingles, x)
                    at[at == len(shingles)] = 0
                    often = np.where(shingles[at] == x, held[at], 0) if len(shingles) else np.zeros(len(x), np.int64)
                    prefix.append(x[np.lexsort((x, often))][: len(x) + percent * -len(x) // 100 + 1].view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0)[first : first + 500], pa.array(sizes, pa.int64()), pa.array(parity, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], names=["rep", "n", "parity", "prefix"])

    return sets.select("rep", "shingles").mapInArrow(run, "rep long, n long, parity binary, prefix array<long>")


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that two sets of n and m must share at least to reach the similarity."""
    return -(-percent * (n + m) // (100 + percent))


def pairs_of_cell(rows: dict, percent: int):
    """(i, j, parity bits that differ) of the pairs among rows of one cell that can reach the similarity and lie in
    different components.

    pos: the shingle's place in a set's order. Sets that reach the similarity share one that leaves, with all behind it,
    enough of either set, so a pair counts only where it does.

    Of a shingle, rows of its main component are dealt to `salts` salts and those outside it to `parts` parts. The first
    salts x parts cells hold one of each: pairs of a row outside with any row of the main component there, and of two
    rows of the part, in the cell that the first of them falls on. The cells behind hold two parts: pairs of one with
    the other.
    """
    rep, component, n, parity, outside, part, cell, salts, parts = (rows[c] for c in ("rep", "component", "n", "parity", "outside", "part", "cell", "salts", "parts"))
    pos = rows.get("pos", np.zeros_like(n))
    both = cell >= salts * parts
    out = np.flatnonzero(part == (cell - salts * parts) // parts) if both else np.flatnonzero(outside)
    step = max(1, (1 << 17) // len(rep))
    for at in range(0, len(out), step):
        i = out[at : at + step, None]
        fits = (component[i] != component) & (100 * np.minimum(n[i], n) >= percent * np.maximum(n[i], n))
        needed = least_overlap(n[i], n, percent)
        fits &= (needed <= n[i] - pos[i]) & (needed <= n - pos)
        fits &= part != part[i] if both else ~outside | ((rep[i] < rep) & (rep[i] % salts == cell // parts))
        x, y = np.nonzero(fits)
        x = i[x, 0]
        differ = np.bitwise_count(parity[x] ^ parity[y]).sum(axis=1, dtype=np.int64)
        # Sets of a similarity of at least percent differ in at most (100 - percent) / (100 + percent) of their sizes.
        ok = differ * (100 + percent) <= (100 - percent) * (n[x] + n[y])
        yield x[ok], y[ok], differ[ok]


#: Cells of up to so many rows are compared all at once, row by row at one distance after another.
SMALL = 16


def pairs_of_small_cells(rows: dict, cell_of: np.ndarray, percent: int):
    """(i, j, parity bits that differ) as pairs_of_cell gives them, of whole shingles (one salt, one part) whose cells,
    numbered by cell_of, have at most SMALL rows."""
    component, n, pos, parity = (rows[c] for c in ("component", "n", "pos", "parity"))
    for lag in range(1, min(SMALL, len(n))):
        i = np.flatnonzero(cell_of[lag:] == cell_of[:-lag])
        if not len(i):
            return
        j = i + lag
        needed = least_overlap(n[i], n[j], percent)
        fits = (component[i] != component[j]) & (needed <= n[i] - pos[i]) & (needed <= n[j] - pos[j])
        i, j = i[fits], j[fits]
        differ = np.bitwise_count(parity[i] ^ parity[j]).sum(axis=1, dtype=np.int64)
        ok = differ * (100 + percent) <= (100 - percent) * (n[i] + n[j])
        yield i[ok], j[ok], differ[ok]


REMAINDER_NAMES = ["shingle", "cell", "salts", "parts", "part", "rep", "component", "n", "pos", "outside", "parity"]


def places(rows: DataFrame) -> DataFrame:
    """(rep, n, parity, shingle, pos) of the shingles of all prefixes."""
    return rows.select("rep", "n", "parity", F.posexplode("prefix").alias("pos", "shingle"))


def remaining_pairs(spread: DataFrame, labels: DataFrame, similarity: float, nearest: bool) -> DataFrame:
    """The pairs (a, b) of different components that share a shingle of their prefixes and whose sizes, places and parity
    maps let them reach the similarity; none that reaches it is left out. spread: see places. nearest: of each component
    that a batch of shingles holds, only the pair with another whose maps differ least.

    Rows whose place leaves too little even for the smallest set that has the shingle go before they meet any other:
    pages that share a template have their own shingles first and the shared ones there. The others of a shingle are
    dealt to cells (see pairs_of_cell) of about HELD rows of its largest component and as many others, so neither a
    frequent shingle nor a large component gathers in one task.
    """
    percent = round(similarity * 100)

    def found(table: pa.Table):
        rows = {c: table[c].to_numpy() for c in REMAINDER_NAMES[:-1]}
        parity = fixed(table["parity"], PARITY // 8).view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], (rows["shingle"][1:] != rows["shingle"][:-1]) | (rows["cell"][1:] != rows["cell"][:-1])]))
        got, rep, component = [], rows["rep"], rows["component"]
        sizes = np.diff(np.append(starts, len(rep)))
        small = (sizes > 1) & (sizes <= SMALL) & (rows["salts"][starts] == 1) & (rows["parts"][starts] == 1)
        at = np.flatnonzero(np.repeat(small, sizes))
        if len(at):
            own = {c: rows[c][at] for c in ("component", "n", "pos")} | {"parity": parity[at]}
            got += [(at[i], at[j], d) for i, j, d in pairs_of_small_cells(own, np.repeat(np.arange(len(starts)), sizes)[at], percent)]
        for start, end in zip(starts[~small], (starts + sizes)[~small]):
            if end - start > 1:
                own = {c: v[start:end] for c, v in rows.items()} | {"parity": parity[start:end]} | {c: int(rows[c][start]) for c in ("cell", "salts", "parts")}
                got += [(i + start, j + start, d) for i, j, d in pairs_of_cell(own, percent) if len(i)]
        if not got:
            return
        i, j, differ = (np.concatenate(c) for c in zip(*got))
        a, b = np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])
        if nearest and len(i):
            low, high = np.minimum(component[i], component[j]), np.maximum(component[i], component[j])
            take = []
            for end in (low, high):
                order = np.lexsort((b, a, differ, end))
                take.append(order[np.concatenate([[True], end[order][1:] != end[order][:-1]])])
            take = np.unique(np.concatenate(take))
            a, b = a[take], b[take]
        a, b = np.unique(np.stack([a, b]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    @lean
    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < 20_000:
                continue
            table = pa.Table.from_batches(held)
            shingle, cell = table["shingle"].to_numpy(), table["cell"].to_numpy()
            last = np.flatnonzero((shingle != shingle[-1]) | (cell != cell[-1]))  # the last cell may go on in the next batch
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from found(table.slice(0, cut))
            held, size = table.slice(cut).to_batches(), 0
        if held:
            yield from found(pa.Table.from_batches(held))

    component = F.coalesce("component", "rep").alias("component")
    placed = spread.join(labels, F.col("rep") == F.col("node"), "left").select("rep", component, "n", "parity", "shingle", F.col("pos").cast("long").alias("pos"))
    # A set of n shingles finds none with which it reaches the similarity if even the smallest is too large.
    roomy = lambda least: percent * (F.col("n") + least) <= (100 + percent) * (F.col("n") - F.col("pos"))
    least = spread.groupBy(F.col("shingle").alias("least_of")).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("sharing")).where("sharing > 1").drop("sharing")
    placed = placed.join(least, F.col("shingle") == F.col("least_of")).where(roomy(F.col("least"))).drop("least", "least_of")
    counts = placed.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("held"))
    mixed = counts.groupBy("shingle").agg(F.max(F.struct("held", "component")).alias("most"), F.sum("held").alias("all"), F.count(F.lit(1)).alias("components"))
    share = lambda held: F.greatest(F.lit(1), F.ceil(held / HELD)).cast("long")
    mixed = mixed.where("components > 1").select(F.col("shingle").alias("of_shingle"), F.col("most.component").alias("main"), share(F.col("most.held")).alias("salts"), share(F.col("all") - F.col("most.held")).alias("parts"))
    met = placed.join(mixed, F.col("shingle") == F.col("of_shingle")).withColumn("outside", F.col("component") != F.col("main"))
    met = met.withColumn("part", F.when(F.col("outside"), F.pmod(F.xxhash64("rep"), F.col("parts"))).otherwise(F.lit(-1)))
    cells = F.expr("""if(outside,
        concat(
            transform(sequence(0, salts - 1), m -> m * parts + part),
            transform(filter(sequence(0, parts - 1), q -> q <> part), q -> salts * parts + least(part, q) * parts + greatest(part, q))),
        transform(sequence(0, parts - 1), q -> pmod(xxhash64(rep), salts) * parts + q))""")
    dealt = met.withColumn("cell", F.explode(cells)).select(*REMAINDER_NAMES)
    width = shuffle_width(spread.sparkSession)
    return dealt.repartition(width, "shingle", "cell").sortWithinPartitions("shingle", "cell").mapInArrow(run, "a long, b long").distinct()


def best_pairs(pairs: DataFrame, each: int = 2) -> DataFrame:
    """For each document its pairs with the fewest differing bits; ties by a hash, so that no document draws them all.
    A document has no more pairs than the windows of all trees hold."""
    rank = F.struct("differ", F.xxhash64("a", "b").alias("h"), "a", "b")
    ends = pairs.select(F.col("a").alias("end"), rank.alias("r")).unionByName(pairs.select(F.col("b").alias("end"), rank.alias("r")))
    best = ends.groupBy("end").agg(F.slice(F.array_sort(F.collect_list("r")), 1, each).alias("best"))
    return best.select(F.explode("best").alias("r")).select("r.a", "r.b").distinct()


def component_of(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds the components of both ends; an end without one is its own."""
    for end in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}")), end, "left").withColumn(f"c_{end}", F.coalesce(f"c_{end}", end))
    return pairs


def linked(docs: DataFrame, classes: DataFrame, words_per: int, similarity: float) -> DataFrame:
    """(node, component) over the representatives that candidate pairs confirmed on full sets connect."""
    met = materialise(candidates(classes, similarity), "pairs")
    pairs, crowded = met.where("a < b"), met.where("a = b").select(F.col("a").alias("rep"))
    ids = materialise(met.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct(), "pair-ids")
    few = ids.count() <= BROADCAST_IDS
    ids = F.broadcast(ids) if few else ids
    sets = materialise(full_sets(docs, ids, words_per), "shingle-sets")
    links = materialise(confirm(best_pairs(pairs), sets, similarity), "links")
    labels = materialise(connected_components(links, "a", "b"), "labels")
    open_pairs = component_of(pairs, labels).where("c_a <> c_b")
    links = materialise(links.unionByName(confirm(open_pairs, sets, similarity)), "links")
    labels = materialise(connected_components(links, "a", "b"), "labels")
    # What the windows left out in crowded regions: an exact join of their rows, first the nearest pairs, which join
    # most of what belongs together, then all that still lie in different components.
    held = crowded.count()
    if held:
        rows = places(materialise(prefixes(sets.join(crowded, "rep", "left_semi"), held, similarity), "prefixes"))
        for nearest in (True, False):
            more = materialise(confirm(remaining_pairs(rows, labels, similarity, nearest), sets, similarity), "more-links")
            if not more.isEmpty():
                links = links.unionByName(more)
                labels = materialise(connected_components(links, "a", "b"), "labels")
    return labels


def members(sketched: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document (doc_id, n_shingles, set_hash), from classes of equal
    sets (set_hash, rep) and the components of their representatives."""
    found = classes.select(F.col("set_hash").alias("of_set"), "rep").join(labels, F.col("rep") == F.col("node"), "left").select("of_set", F.coalesce("component", "rep").alias("component"))
    alone = F.when(F.col("doc_id").isNotNull(), F.col("doc_id"))
    rows = sketched.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("set_hash")).alias("set_hash"))
    # A class of copies may hold a third of all rows: its single row is repeated over salts that the copies share.
    salts = 32
    # Dealt by place in the stored table, as rows may even share their id.
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    spread = found.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = dealt.join(spread, (F.col("set_hash") == F.col("of_set")) & (F.col("salt") == F.col("of_salt")), "left")
    component = F.coalesce("component", alone)
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, words_per: int = 5, similarity: float = 0.8) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id reachable) and kept (whether it is that one)."""
    sketched = materialise(sketches(docs, words_per), "sketches")
    usable = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = materialise(usable.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("bits").alias("bits")), "classes")
    labels = linked(docs, classes, words_per, similarity)
    return members(sketched, classes, labels)


def near_duplicate_digests(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, words_per=3, similarity=0.85)
