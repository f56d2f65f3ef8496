"""License scans: Aho-Corasick over word sequences, and a shunting-yard parser for licence expressions.

Every text is folded to its words (ASCII letters lower-cased, everything ASCII that is no letter or digit a gap) and
walked once by one automaton that holds all notice phrases and the identifier tag. Behind each tag that it finds, however
many a line holds, the licence expression is read from the raw text, up to the line's end or the next tag, parsed by shunting-yard (with over and over or) and evaluated: which licences it
names, and whether it can be met with permissive ones alone.

Defined cases: null and empty texts have no words, no labels and score 0; a malformed expression contributes the
licences it names and counts as not permissive; null ids stay; equal rows give equal rows; a text of any length is scanned
whole, one at a time; an empty table gives none; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framequarry.runtime import bounded_batches, lean

#: Phrases that the base count looks for, with their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Further notice phrases, with their labels.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "released under the mit license": "mit",
    "the mit license": "mit",
    "licensed under the apache license": "apache-2",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 3 clause": "bsd-3-clause",
    "bsd 2 clause": "bsd-2-clause",
    "mozilla public license": "mpl",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc by sa": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "cc0 1 0 universal": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}

#: Labels of identifiers whose label is not simply the lower-cased identifier without its version suffix.
IDENTIFIER_LABELS = {
    "apache-2.0": "apache-2",
    "cc0-1.0": "cc0",
    "bsd-3-clause": "bsd-3-clause",
    "bsd-2-clause": "bsd-2-clause",
}

PERMISSIVE = {"mit", "apache-2", "bsd", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "cc0", "unlicense", "cc-by", "0bsd"}

TAG_WORDS = "spdx license identifier"
TAG_LENGTH = 3
#: Words of a text as the automaton takes them, and what follows a tag up to the line's end.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BEHIND = re.compile(r"[ \t]*[:=]?[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+\-]*")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}

#: Bytes of UTF-8 text to folded text: ASCII letters lower-cased, other ASCII but digits to a space, the rest kept.
FOLD = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256)).lower()

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, expressions array<struct<text:string,valid:boolean,permissive:boolean>>, score double"


def label_of(identifier: str) -> str:
    name = identifier.lower().rstrip("+")
    if name in IDENTIFIER_LABELS:
        return IDENTIFIER_LABELS[name]
    return re.sub(r"(-only|-or-later)$", "", re.sub(r"-\d+(\.\d+)*(?=-only$|-or-later$|$)", "", name)) or name


def to_postfix(expression: str) -> tuple[list[str], bool]:
    """Shunting-yard: postfix tokens, and whether the expression was well formed up to where it stopped.

    Reading stops at the first token that cannot continue the expression, so prose behind an identifier is left alone; a
    closing parenthesis that nothing opened, or that follows no operand, makes the expression malformed.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = True  # whether one is expected next
    depth, closed_well = 0, True
    for match in _TOKEN.finditer(expression):
        token = match[0]
        word = token.lower()
        if word in _PRECEDENCE:
            if operand:
                break
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        elif token == "(":
            if not operand:
                break
            stack.append(token)
            depth += 1
        elif token == ")":
            if operand or not depth:
                closed_well = False
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif operand:
            out.append(token.rstrip("."))
            operand = False
        else:
            break
    valid = bool(out) and not operand and not depth and closed_well
    out += [t for t in reversed(stack) if t != "("]
    return out, valid


def evaluate(postfix: list[str], valid: bool) -> tuple[set[str], bool]:
    """Labels that the expression names, and whether permissive licences alone can meet it."""
    labels = set()
    stack: list[tuple[bool, str]] = []
    for token in postfix:
        if token in _PRECEDENCE:
            if len(stack) < 2:
                continue
            (right, _), (left, name) = stack.pop(), stack.pop()
            stack.append((left or right if token == "or" else left and right if token == "and" else left, name if token == "with" else ""))
        else:
            stack.append((label_of(token) in PERMISSIVE, token))
    exceptions = set()
    operands: list[tuple[str, ...]] = []
    for token in postfix:  # the right-hand side of a `with` is an exception, not a licence
        if token in _PRECEDENCE:
            if len(operands) >= 2:
                right, left = operands.pop(), operands.pop()
                if token == "with":
                    exceptions.update(right)
                operands.append(left if token == "with" else left + right)
        else:
            operands.append((token,))
    labels = {label_of(t) for t in postfix if t not in _PRECEDENCE and t not in exceptions}
    return labels, valid and bool(stack) and stack[-1][0]


@functools.lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase, label in NOTICE_PHRASES.items():
        found.add_word(f" {phrase} ", (phrase.count(" ") + 1, label, False))
    for phrase, label in BASE_PHRASES.items():
        found.add_word(f" {phrase} ", (phrase.count(" ") + 1, label, True))
    found.add_word(f" {TAG_WORDS} ", (0, "", False))  # no label of its own: an expression follows
    found.make_automaton()
    return found


def scan_text(text: str) -> tuple:
    """The row of SCHEMA without doc_id."""
    words = text.encode("utf-8", "surrogatepass").translate(FOLD).split()
    folded = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
    n_base, first, last, base, labels, notices, tags = 0, None, None, set(), set(), 0, []
    seen = counted = 0
    for end, (n, label, is_base) in automaton().iter(folded):
        if not n or is_base:
            counted += folded.count(" ", seen, end)  # spaces before the one that ends the match
            seen = end
        if not n:
            tags.append(counted)
            continue
        labels.add(label)
        notices += 1
        if is_base:
            start = counted - n
            n_base += 1
            first = start if first is None else min(first, start)
            last = start if last is None else max(last, start)
            base.add(label)
    expressions = []
    if tags:
        spans = [m.span() for m in _WORD.finditer(text)]
        starts = [spans[t - TAG_LENGTH][0] for t in tags]
        for tag, until in zip(tags, [*starts[1:], len(text)]):  # an expression ends where its line or the next tag does
            behind = _BEHIND.match(text, spans[tag - 1][1], until)[1]
            postfix, valid = to_postfix(behind)
            named, permissive = evaluate(postfix, valid)
            labels |= named
            expressions.append({"text": behind.strip(), "valid": valid, "permissive": permissive})
    evidence = notices + 2 * sum(e["valid"] for e in expressions)
    return len(words), n_base, first, last, sorted(base), sorted(labels), expressions, 1.0 - 0.5**evidence


def scan(docs: DataFrame) -> DataFrame:
    """Per document: words, base places and labels, all labels, parsed expressions, score."""

    @lean
    def run(batches):
        kind = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("expressions", pa.list_(pa.struct([("text", pa.string()), ("valid", pa.bool_()), ("permissive", pa.bool_())]))), ("score", pa.float64())])
        for batch in batches:
            rows = [scan_text(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*rows)) if rows else [()] * (len(kind) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(kind)[1:]))], schema=kind)

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SCHEMA)


def scan_digests(docs: DataFrame) -> DataFrame:
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
