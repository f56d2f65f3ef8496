"""Packing documents into training windows by best-fit decreasing.

A document is tokenised once, closed by an end id and cut into pieces: as many full windows as it holds, then the
remainder. Remainders are dealt by hash to placement groups of bounded size; each group places its pieces in
decreasing length into the tightest open window, which a segment tree over remaining capacities finds in
O(log window). Groups are independent, so the cost of splitting the placement is at most a few part-filled windows a
group (about one in a thousand).

Ids are those of the tokenizers library. The vocabulary's ranks form gives the same ids for texts of Latin letters at a
quarter of the cost (a test holds both against each other for every code point); any other text, special strings and
endless gaps go through the library itself.

Pieces are dealt by a hash of id, start, checksum and the row's place in its task, so neither a long document nor an id
or a text that many rows share gathers in one group. The place is the same in every run if the input repeats its rows
in order, as stored tables do; give it one.

Defined cases: a null text counts as empty; an empty document is the end id alone; a null id stays null and is packed
like any other; equal rows are packed once each; the vocabulary's special strings in a text become their ids; texts of
any length are encoded, millions of equal characters included; an empty table gives no rows; other columns of the
input are ignored.
"""

from __future__ import annotations

import array
import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framequarry.runtime import bounded_batches, lean, resident

WINDOW = 2048
END_ID = 1
#: Pieces that one placement group holds on average; bounds the memory of a task.
GROUP_PIECES = 4096
#: White space in a row from which on a text is the library's.
LONG_GAP = 10_000

PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, place long, ids binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


SPECIAL = "<|endoftext|>"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class ByteBpe:
    """Texts to ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.foreign = re.compile(r"[^\x00-\u024f]").search
        self.long_gap = re.compile(rf"\s{{{LONG_GAP}}}").search

    def plain(self, text: str) -> bool:
        """Whether the ranks form gives the library's ids: on Latin letters, where both split alike, no special string, and
        no run of spaces so long that its pattern runs out of stack."""
        if SPECIAL in text or len(text) >= LONG_GAP and self.long_gap(text):
            return False
        return text.isascii() or not self.foreign(text)

    def encode(self, text: str) -> bytes:
        ids = self.ranks.encode_ordinary(text) if self.plain(text) else self.library.encode(text, add_special_tokens=False).ids
        return array.array("I", ids).tobytes()


def byte_bpe(path: str, ranks_path: str) -> ByteBpe:
    return resident(("byte_bpe", path, ranks_path), lambda: ByteBpe(path, ranks_path))


def cut_points(n_tokens: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: full windows, then the rest."""
    return [(s, min(window, n_tokens - s)) for s in range(0, n_tokens, window)]


def tokenise(docs: DataFrame, path: str | None = None, ranks_path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, ids_crc32, place, ids): ids are little-endian unsigned 32-bit, place is
    the row's number in its task."""
    path, ranks_path = path or default_tokenizer(), ranks_path or default_ranks()
    end = np.array([end_id], "<u4").tobytes()

    @lean
    def run(batches):
        bpe = byte_bpe(path, ranks_path)
        place = 0
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = bpe.encode(text.as_py()) + end
                for start, length in cut_points(len(raw) // 4, window):
                    ids = raw[4 * start : 4 * (start + length)]
                    rows.append((doc_id, start, length, len(raw) // 4, zlib.crc32(ids), place, ids))
                place += 1
                size += len(raw)
                if size >= 1 << 22:
                    yield piece_batch(rows)
                    rows, size = [], 0
            yield piece_batch(rows)

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PIECE_SCHEMA)


def piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "place", "ids"]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns)], names=names)


class CapacityTree:
    """Segment tree over remaining capacities 0..window: how many open windows have each; finds the tightest fit."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        node = self.leaves + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, sequence) of the open window with the least capacity >= need."""
        node = self.leaves + need
        while not self.count[node]:
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node <<= 1
            node += not self.count[node]
        capacity = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths, window: int) -> tuple[list[int], list[int]]:
    """(sequence, offset) for each length, given in decreasing order."""
    tree, sequences, offsets, used = CapacityTree(window), [], [], 0
    for n in lengths:
        found = tree.take(n) if n < window else None
        if found is None:
            found, used = (window, used), used + 1
        capacity, sequence = found
        sequences.append(sequence)
        offsets.append(window - capacity)
        if capacity > n:
            tree.add(capacity - n, sequence)
    return sequences, offsets


def place(pieces: DataFrame, groups: int, window: int = WINDOW, dealt_by: tuple[str, ...] = ("doc_id", "start", "ids_crc32", "place")) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, start and length; carries every other column along.

    groups: how many independent placements; dealt_by: the columns whose hash deals pieces to them. With the row's place
    among them, no id and no text that many rows share gathers in one group.
    """

    def run(key, got):
        got = got.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        sequences, offsets = best_fit_decreasing(got["length"].to_pylist(), window)
        base = key[0].as_py() << 32
        got = got.drop_columns(["placement_group"])
        return got.append_column("sequence_id", pa.array([base + s for s in sequences], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    dealt = pieces.withColumn("placement_group", F.pmod(F.xxhash64(*dealt_by), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("placement_group").applyInArrow(run, schema)


def placement_groups(docs: DataFrame, window: int = WINDOW, per_group: int = GROUP_PIECES) -> int:
    """Enough groups that each gets about per_group pieces, from the rows and bytes of the input (one small aggregate)."""
    rows, size = docs.select(F.octet_length("text").alias("b")).agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0))).first()
    return max(1, -(-(rows + size // (2 * window)) // per_group))


def pack(docs: DataFrame, path: str | None = None, ranks_path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces with their ids, sequence and offset."""
    return place(tokenise(docs, path, ranks_path, window, end_id), placement_groups(docs, window), window).drop("place")


def pack_digests(docs: DataFrame, path: str | None = None, ranks_path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """The packing with a checksum in place of the ids, which then need not be shuffled."""
    placed = place(tokenise(docs, path, ranks_path, window, end_id).drop("ids"), placement_groups(docs, window), window)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
