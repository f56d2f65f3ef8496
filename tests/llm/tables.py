"""Small tables with every awkward case."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # Names that operators use inside or return.
    *(T.StructField(n, T.StringType()) for n in ("score", "kept", "block", "vslot", "key", "t", "row_", "length", "ids", "component", "n_words", "salt", "rep")),
])

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
PLAIN = " ".join(f"plain{i}" for i in range(80))

TEXTS = [
    (1, None, "src1"),
    (2, "", "src1"),
    (3, "   \t\n ", None),
    (4, "Hello, World! It's 5 o'clock ...", "src1"),
    (5, "Ärger mit ÖL: straße İstanbul ŒUVRE ñandú ½ ² don't", "src2"),
    (6, "日本語のテキスト Ελληνικά ΣΑΣ русский עברית 👍🏽 é  x y", "src2"),
    (7, "a <|endoftext|> b<|startoftext|>c <|end", "src2"),
    (8, LONG, "src3"),
    (9, PLAIN, "src1"),
    (10, PLAIN, "src1"),
    (10, PLAIN, "src1"),
    (None, PLAIN, "src1"),
    (None, None, None),
    (11, PLAIN.replace("plain40 ", "other40 "), "src1"),
    (12, "\x00\x01\x1f\x7f control\x0bchars\r\nand lines\r\n", ""),
    (13, "x" * 70_000, "src4"),
    (14, "one two", "src4"),
    (15, "One Two", "src4"),
    (16, "line a\nline a\n\n\nline b\nline a", "src4"),
    (17, "mail a.b@c.de and 1.2.3.4 or 300.1.1.1, card 4111 1111 1111 1111, call +1 (499) 555-6503; x@y", "src4"),
    (18, "SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0\nunder the MIT license. Apache License, Version 2.0; CC BY-NC", "src4"),
    (19, "@" * 500 + "1" * 40 + " +" * 300 + "9-" * 400, "src4"),
]


def awkward(spark):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *["clash"] * 13) for i, t, s in TEXTS], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(rows):
    return [(i, t or "") for i, t, _ in rows]
