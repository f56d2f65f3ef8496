"""BPE encoding and decoding through a table of distinct words.

Texts are split into words by the rules of the tokenizer's file. Documents travel in blocks of bounded size as word
codes: each block holds its distinct words once, and only those leave it, as rows (word, block, code). The rows meet by
word, so each distinct word is encoded once; its ids are joined with the id-to-piece table (fixed in size by the
vocabulary) and the pieces meet again by position, which decodes it. All that happens in one stage: words stay in
order, and what leads to a block is bundled and sent to it, where ids and decoded words are joined by position, one
document at a time. A word has one row a block at most, so no word gathers more than a block's share of a task's rows.

A block is named by a hash of what it holds, and two branches of the plan read the blocks, so the input must be a
stored table (which repeats its rows in the same order); a block whose ids do not arrive ends the job with an error,
never with missing rows.

Defined cases: null and empty texts encode to no ids and decode to an empty text; special tokens' strings in a text
become their ids; null ids of documents stay; equal rows give equal rows; an empty table gives none; other columns of
the input are ignored. A text longer than a block is a block of its own.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from framequarry.runtime import bounded_batches, lean, resident, shuffle_width

#: Bytes of text, about, that one block holds.
BLOCK_BYTES = 16 << 20
#: Rows of pieces that a task gathers before it bundles them by block, and bytes of results that it returns at a time.
BUNDLE_ROWS, OUT_BYTES = 1 << 19, 4 << 20

WORDS_SCHEMA = "word string, block long, code int"
#: One row a word, or a part of its rows: whom it leads to, and its ids.
SPELLED_SCHEMA = "n int, blocks array<long>, codes array<int>, ids array<int>"
#: side 0: bundled ids of some of a block's words; side 1: its documents as word codes.
BLOCK_SCHEMA = "block long, side int, rows binary, codes binary"
ENCODED_SCHEMA = "doc_id long, ids binary, decoded string"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Splitter:
    """Splits texts as the tokenizer's file says: special strings, normaliser, word pattern.

    Texts of Latin letters and plain punctuation take one compiled pattern, on which both agree; any other text goes
    through the library's own normaliser and splitter.
    """

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.normalizer = Tokenizer.from_file(path).normalizer
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pre = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        latin = [chr(c) for c in range(0xA0, 0x250)]
        letters = "a-zA-Z" + "".join(c for c in latin if unicodedata.category(c)[0] == "L")
        digits = "0-9" + "".join(c for c in latin if unicodedata.category(c)[0] == "N")
        spaces = "\t\n\r \xa0"
        # Capitals whose lower-case letter lies beyond the range are the library's; İ has its own way below.
        plain = "".join(c for c in latin if c == "İ" or max(c.lower()) < "ɐ")
        self.odd = re.compile(rf"[^\t\n\r -~{plain}]|<\|")
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{spaces}{letters}{digits}]+").findall

    def split(self, text: str) -> list[str]:
        if not self.odd.search(text):
            return self.words("".join(map(str.lower, text)) if "İ" in text else text.lower())
        out = []
        for part in self.at_special.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out += [w for w, _ in self.pre.pre_tokenize_str(self.normalizer.normalize_str(part))]
        return out


class WordEncoder:
    """The model alone: words in, ids out."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        spec |= {"added_tokens": [], "normalizer": None, "pre_tokenizer": spec["pre_tokenizer"]["pretokenizers"][1]}
        self.model = Tokenizer.from_str(json.dumps(spec))

    def encode(self, words: list[str]) -> list[list[int]]:
        found = self.model.encode_batch_fast(words, add_special_tokens=False)
        return [[self.special[w]] if w in self.special else e.ids for w, e in zip(words, found)]


def splitter(path: str) -> Splitter:
    return resident(("splitter", path), lambda: Splitter(path))


def word_encoder(path: str) -> WordEncoder:
    return resident(("words", path), lambda: WordEncoder(path))


def pieces_of(path: str) -> list[str]:
    """Piece of each id, special tokens included."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    by_id = {i: p for p, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [by_id.get(i, "") for i in range(max(by_id) + 1)]


class Codes(dict):
    """Word to code; an unseen word gets the next one."""

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


def blocks(batches, path: str):
    """(block, ids of documents, words per document, word codes, distinct words in the order of their codes)."""
    split = splitter(path).split
    held: tuple | None = None
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if held is None:
                held = ([], [], [], Codes(), hashlib.blake2b(digest_size=8), 0)
            doc_ids, sizes, codes, known, name, size = held
            text = text.as_py()
            words = split(text)
            codes.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
            doc_ids.append(doc_id)
            sizes.append(len(words))
            name.update(f"{doc_id}:{len(text)}\n".encode() + codes[-1].tobytes())
            held = (doc_ids, sizes, codes, known, name, size + len(text))
            if size + len(text) >= BLOCK_BYTES:
                yield closed(held)
                held = None
    if held is not None:
        yield closed(held)


def closed(held: tuple) -> tuple:
    """Codes are dealt anew by frequency, which makes them shorter on the way."""
    doc_ids, sizes, codes, known, name, _ = held
    words = list(known)
    name.update("\n".join(words).encode("utf-8", "surrogatepass"))
    joined = np.concatenate(codes)
    order = np.argsort(-np.bincount(joined, minlength=len(words)), kind="stable")
    rank = np.empty(len(words), np.uint32)
    rank[order] = np.arange(len(words), dtype=np.uint32)
    return int.from_bytes(name.digest(), "little", signed=True), doc_ids, sizes, rank[joined], [words[i] for i in order.tolist()]


def distinct_words(docs: DataFrame, path: str) -> DataFrame:
    """Each block's distinct words: (word, block, code)."""

    @lean
    def run(batches):
        for block, _, _, _, words in blocks(batches, path):
            own = pa.array(words, pa.string())
            order = pc.sort_indices(own)  # neighbours that are alike compress
            for at in range(0, len(order), 1 << 15):
                part = order.slice(at, 1 << 15)
                yield pa.RecordBatch.from_arrays([own.take(part), pa.array(np.full(len(part), block)), part.cast(pa.int32())], names=["word", "block", "code"])

    return plain(docs).mapInArrow(run, WORDS_SCHEMA)


def coded_blocks(docs: DataFrame, path: str) -> DataFrame:
    """Each block's documents as word codes."""

    @lean
    def run(batches):
        for block, doc_ids, sizes, codes, _ in blocks(batches, path):
            known = np.array([d is not None for d in doc_ids])
            rows = packed(np.array([d or 0 for d in doc_ids], np.int64), known.astype(np.uint8), np.array(sizes, np.int64))
            yield block_batch([(block, 1, rows, packed(codes))])

    return plain(docs).mapInArrow(run, BLOCK_SCHEMA)


def block_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"block": pa.int64(), "side": pa.int32(), "rows": pa.binary(), "codes": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))


def packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers, byte by byte of all in turn, as the high bytes hardly vary."""
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(-1, c.itemsize).T).tobytes() for c in columns]
    head = np.array([len(columns), *(c.itemsize for c in columns), *map(len, planes)], "<u8").tobytes()
    return zstandard.compress(head + b"".join(planes), 5)


def unpacked(data: bytes) -> list[np.ndarray]:
    """The columns, as unsigned numbers."""
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    head = np.frombuffer(raw, "<u8", 1 + 2 * n)[1:].astype(np.int64)
    out, at = [], 8 * (1 + 2 * n)
    for width, size in zip(head[:n].tolist(), head[n:].tolist()):
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(width, -1)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel())
        at += size
    return out


def plain(docs: DataFrame) -> DataFrame:
    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def piece_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """id and piece: as many rows as the vocabulary has."""
    pieces = pieces_of(path or default_tokenizer())
    return spark.createDataFrame(pa.table({"id": pa.array(range(len(pieces)), pa.int32()), "piece": pieces}))


def with_pieces(spread: DataFrame, path: str | None) -> DataFrame:
    """Joins id with its piece; the table is that of the vocabulary, so it is broadcast."""
    return spread.join(F.broadcast(piece_table(spread.sparkSession, path)), "id", "left")


def spelled(words: DataFrame, path: str) -> DataFrame:
    """(word, block, code) to rows of SPELLED_SCHEMA: rows meet by word and are sorted, so each word is encoded once."""

    @lean
    def run(batches):
        encoder = word_encoder(path)
        last, last_ids = None, []  # a word's rows may run on into the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            word = batch.column(0)
            starts = np.flatnonzero(np.concatenate([[True], pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)]))
            own = word.take(pa.array(starts)).to_pylist()
            known = own[0] == last
            ids = [last_ids] * known + encoder.encode(own[known:])
            last, last_ids = own[-1], ids[-1]
            offsets = pa.array(np.append(starts, batch.num_rows), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, batch.column(k)) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array([len(i) for i in ids], pa.int32()), *lists, pa.array(ids, pa.list_(pa.int32()))], names=["n", "blocks", "codes", "ids"])

    return words.repartition(shuffle_width(words.sparkSession), "word").sortWithinPartitions("word").mapInArrow(run, SPELLED_SCHEMA)


def bundled(words: DataFrame, path: str) -> DataFrame:
    """Rows of SPELLED_SCHEMA to rows of BLOCK_SCHEMA, each with what a task has for one block.

    Ids are joined with their pieces one by one; neither the explosion nor a broadcast join changes the order of rows,
    so a word's pieces arrive together, by position, which is checked.
    """

    def by_block(table: pa.Table):
        pos, n = table["pos"].to_numpy(), table["n"].to_numpy()
        starts = np.flatnonzero(pos == 0)
        lengths = np.diff(np.append(starts, len(pos)))
        if starts[0] or (lengths != n[starts]).any() or (pos != np.arange(len(pos)) - np.repeat(starts, lengths)).any():
            raise ValueError("the pieces of a word did not stay together")
        offsets = pa.array(np.append(starts, len(pos)), pa.int32())
        ids = pa.ListArray.from_arrays(offsets, table["id"].combine_chunks())
        texts = pc.binary_join(pa.ListArray.from_arrays(offsets, table["piece"].combine_chunks()), " ")
        first = table.select(["blocks", "codes"]).take(pa.array(starts)).combine_chunks()
        of_word = np.repeat(np.arange(len(starts)), pc.list_value_length(first["blocks"]).to_numpy())
        block, code = (pc.list_flatten(first[c]).to_numpy() for c in ("blocks", "codes"))
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        for part in np.split(order, cuts):
            mine = pa.array(of_word[part])
            own_ids, own_texts = ids.take(mine), texts.take(mine)
            raw = np.frombuffer("".join(own_texts.to_pylist()).encode("utf-8", "surrogatepass"), np.uint8)
            rows = packed(code[part].astype(np.uint32), lengths[of_word[part]].astype(np.uint32), own_ids.flatten().to_numpy().astype(np.uint32), pc.binary_length(own_texts).to_numpy().astype(np.uint32), raw)
            yield block_batch([(int(block[part[0]]), 0, rows, None)])

    @lean
    def run(batches):
        held = None
        for batch in batches:
            own = pa.Table.from_batches([batch])
            held = own if held is None else pa.concat_tables([held, own])
            if held.num_rows >= BUNDLE_ROWS:
                cut = int(np.flatnonzero(held["pos"].to_numpy() == 0)[-1])  # the last word may run on in the next batch
                if cut:
                    yield from by_block(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from by_block(held)

    spread = words.select("n", "blocks", "codes", F.posexplode("ids").alias("pos", "id"))
    first = F.col("pos") == 0
    spread = spread.select("n", "pos", "id", F.when(first, F.col("blocks")).alias("blocks"), F.when(first, F.col("codes")).alias("codes"))
    return with_pieces(spread, path).select("n", "pos", "id", "piece", "blocks", "codes").mapInArrow(run, BLOCK_SCHEMA)


class BlockWords:
    """Ids and decoded texts of a block's words, by code."""

    def __init__(self, bundles: list[bytes]):
        columns = [unpacked(b) for b in bundles] or [[np.zeros(0, np.uint32)] * 4 + [np.zeros(0, np.uint8)]]
        code, n_ids, ids, n_bytes, raw = (np.concatenate(c) for c in zip(*columns))
        offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n, dtype=np.int64)]), pa.int64())
        codes, at = np.unique(code, return_index=True)  # a block that came twice has each word twice
        self.count = len(codes) if not len(codes) or int(codes[-1]) == len(codes) - 1 else -1
        self.ids = pa.LargeListArray.from_arrays(offsets(n_ids), pa.array(ids)).take(pa.array(at))
        texts = pa.LargeStringArray.from_buffers(len(code), offsets(n_bytes).buffers()[1], pa.py_buffer(raw.tobytes()))
        self.texts = texts.take(pa.array(at)).to_pylist()

    def documents(self, codes: np.ndarray, rows: bytes, decode: bool):
        """Batches of (doc_id, ids, decoded) from the word codes of the block's documents."""
        if len(codes) and int(codes.max()) >= self.count:
            raise ValueError("ids of a block are missing: the input did not repeat its rows in order")
        out, size, first = [], 0, 0
        for doc_id, known, n in zip(*(c.tolist() for c in unpacked(rows))):
            own = codes[first : first + n]
            first += n
            raw = self.ids.take(pa.array(own)).flatten().to_numpy().astype("<u4").tobytes() if n else b""
            text = " ".join([t for t in map(self.texts.__getitem__, own.tolist()) if t]) if decode else None
            out.append((int(np.uint64(doc_id).view(np.int64)) if known else None, raw, text))
            size += len(raw) + len(text or "")
            if size >= OUT_BYTES:
                yield encoded_batch(out)
                out, size = [], 0
        yield encoded_batch(out)


def encoded_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "ids": pa.binary(), "decoded": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))


def encode(docs: DataFrame, path: str | None = None, decode: bool = True) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and, if asked for, the text that the ids decode to."""
    path = path or default_tokenizer()

    @lean
    def rejoin(batches):
        name, held, words = None, [], None
        for batch in batches:
            for block, side, rows, codes in zip(*batch.columns):
                if name != block.as_py():
                    name, held, words = block.as_py(), [], None
                if side.as_py() == 0:
                    held.append(rows.as_py())
                    continue
                words = words or BlockWords(held)
                held = []
                yield from words.documents(unpacked(codes.as_py())[0], rows.as_py(), decode)

    coded = bundled(spelled(distinct_words(docs, path), path), path)
    both = coded.unionByName(coded_blocks(docs, path))
    return both.repartition(shuffle_width(docs.sparkSession), "block").sortWithinPartitions("block", "side").mapInArrow(rejoin, ENCODED_SCHEMA)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) to (doc_id, decoded): each id meets its piece by a join, pieces meet again by position.

    Rows are numbered first, so equal or null doc_ids stay apart; unknown ids decode to nothing, null lists to "".
    """
    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).withColumn("row", F.monotonically_increasing_id())
    spread = rows.select("doc_id", "row", F.posexplode_outer("ids").alias("pos", "id"))
    joined = with_pieces(spread, path)
    ordered = F.array_sort(F.collect_list(F.when(F.col("piece") != "", F.struct("pos", "piece"))))
    return joined.groupBy("row", "doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), " ").alias("decoded")).select("doc_id", "decoded")


def encode_digests(docs: DataFrame) -> DataFrame:
    return encode(docs).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
