"""The splitter's fast path against the library, for every code point it takes."""

from test_tokens import library

from framequarry.llm import bpe


def test_every_plain_code_point():
    tok = library("word_bpe_49k.json")
    split, encoder = bpe.Splitter(bpe.default_tokenizer()), bpe.WordEncoder(bpe.default_tokenizer())
    for c in map(chr, [*range(0x20, 0x7F), *range(0xA0, 0x250)]):
        for text in (c, f"AZ{c}RBAYCAN x", f"1{c}2 .{c}!", f"{c}{c} a{c}"):
            words = split.split(text)
            ids = sum(encoder.encode(words), []) if words else []
            assert ids == tok.encode(text, add_special_tokens=False).ids, repr(text)
