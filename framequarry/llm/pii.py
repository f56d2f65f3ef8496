"""Personal data: base patterns, and terms that disclose them, in DataFrame operations only.

Base entities (email, ip, card, phone) are found by patterns whose quantifiers are possessive, so no text, however
long, makes them backtrack; matches that fail a check (parts of an address, Luhn, numbers of digits) are dropped.
Positions are sums of the lengths of what lies between matches, kept for blocks of them, so a text's cost is about
linear in its matches.

Terms: all words of the texts that hold an entity are its candidate terms. Over the corpus, n(t, e) documents have a
term and the entity, n(t) have the term, n(e) the entity. A term's disclosure of an entity is the share
of the entity's information that it gives away, pointwise mutual information over information content:
log2(n(t,e) N / (n(t) n(e))) / log2(N / n(e)). Where a pair is seen in at least SUPPORT different texts, a disclosure
from GENERALISE on generalises the term at all its places in all texts, one from REMOVE on removes it. Places inside a
base entity are the entity's own.

Pairs of term and entity are counted first, over the texts that hold an entity. Terms that the same texts hold are one
set, entities likewise, so that a text's pairs are those of its sets; terms too common to disclose any entity of their
texts meet none. Only words that may be among the pairs' terms are then counted over the corpus, and only words that may
disclose something leave a text with their places. Which
words may is told by a table of their hashes, or of buckets where those are too many, broadcast, with at most BUCKETS rows at
any size of the corpus; an exact join follows. The plan is the same at every size, and joins may be split where copies share a text.

Defined cases: a null text is empty and has no spans; null ids stay; equal rows return equal rows, and copies of a text
are one text for SUPPORT; a corpus of one document discloses nothing; an empty table gives no rows; other columns of
the input are ignored by `find` and kept by `sanitise`; texts may be of any length and have any number of matches, and
where they share a list of thousands of entities, it is one set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from framequarry.runtime import materialise

KINDS = ["email", "ip", "card", "phone"]

#: The patterns' matches are those of the plain greedy forms: what a possessive part takes can't be followed by what
#: comes next in the pattern, and a match may begin inside a run of its characters only where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

TERM = r"[\p{L}\p{M}\p{N}]++"
SUPPORT = 2
GENERALISE, REMOVE = 0.8, 0.95
#: Hashes, or buckets of hashes, that tell which words matter: the bound of what is broadcast.
BUCKETS = 1 << 20
#: Matches whose lengths are summed together, and code points of a text that are cut out of one piece.
BLOCK, PIECE = 64, 4096

#: What stands in a sanitised text for each kind; a removed term leaves nothing.
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalised": "[TERM]", "removed": ""}

_SPAN = "struct<start:int,end:int,text:string>"


def let(name: str, value: str, body: str) -> str:
    """body, in which name stands for value; value is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def in_blocks(size: str, of_block: str) -> str:
    """What of_block, SQL over k, gives for the blocks of BLOCK elements that `size` elements make (one if there are none)."""
    return f"transform(sequence(0, ({size} - 1) div {BLOCK}), k -> {of_block})"


def joined_length(array: str, first: str, count: str) -> str:
    """Code points of count elements from first on, whatever the array's length."""
    return f"length(array_join(slice({array}, cast({first} as int) + 1, cast({count} as int)), ''))"


def block_starts(matches: str, parts: str) -> str:
    """Code points before each block of matches, from the parts between them; both are arrays."""
    of_block = joined_length("bp", f"k * {BLOCK}", str(BLOCK)) + " + " + joined_length("bm", f"k * {BLOCK}", str(BLOCK))
    sums = "aggregate(bl, named_struct('at', 0, 'out', cast(array() as array<int>)), (s, x) -> named_struct('at', s.at + x, 'out', concat(s.out, array(s.at))), s -> s.out)"
    return let("bm", matches, let("bp", parts, let("bl", in_blocks("size(bm)", of_block), sums)))


def start_of(i: str, matches: str, parts: str, blocks: str) -> str:
    """Code points before match i, of which at most a block's matches are looked at."""
    first = f"({i} - {i} % {BLOCK})"
    return f"get({blocks}, cast({i} div {BLOCK} as int)) + {joined_length(parts, first, f'{i} % {BLOCK} + 1')} + {joined_length(matches, first, f'{i} % {BLOCK}')}"


def located(matches: str, parts: str) -> str:
    """Spans of matches, with their texts."""
    span = let("v", start_of("i", "lx", "lp", "lb"), "named_struct('start', v, 'end', v + length(x), 'text', x)")
    return let("lx", matches, let("lp", parts, let("lb", block_starts("lx", "lp"), f"transform(lx, (x, i) -> {span})")))


def merged(spans: str) -> str:
    """Sorted spans (start, end, label), not none, with those that overlap as one, by the label of the first."""
    largest = "named_struct('at', greatest(coalesce(s.at, x), x), 'out', concat(s.out, array(greatest(coalesce(s.at, x), x))))"
    of_block = f"array_max(slice(me, cast(k * {BLOCK} as int) + 1, {BLOCK}))"
    reached = f"aggregate({in_blocks('size(me)', of_block)}, named_struct('at', cast(null as int), 'out', cast(array() as array<int>)), (s, x) -> {largest}, s -> s.out)"
    reach = f"transform(me, (x, i) -> greatest(array_max(slice(me, cast(i - i % {BLOCK} as int) + 1, cast(i % {BLOCK} as int) + 1)), coalesce(get(mb, cast(i div {BLOCK} as int) - 1), 0)))"
    first = "filter(sequence(0, size(mx) - 1), i -> i = 0 or get(mx, i).start >= get(mr, i - 1))"
    whole = "transform(mi, (i, k) -> named_struct('start', get(mx, i).start, 'end', get(mr, coalesce(get(mi, k + 1), size(mx)) - 1), 'label', get(mx, i).label))"
    return let("mx", spans, let("me", "transform(mx, x -> x.end)", let("mb", reached, let("mr", reach, let("mi", first, whole)))))


def cut(start: str, end: str) -> str:
    """Code points from start to before end of the text whose pieces are cp; reads only the pieces that hold them."""
    head = f"substring(get(cp, cast({start} div {PIECE} as int)), {start} % {PIECE} + 1, if({start} div {PIECE} = {end} div {PIECE}, {end} - {start}, {PIECE}))"
    middle = f"array_join(slice(cp, cast({start} div {PIECE} as int) + 2, greatest(0, cast({end} div {PIECE} - {start} div {PIECE} as int) - 1)), '')"
    tail = f"if({start} div {PIECE} < {end} div {PIECE}, coalesce(substring(get(cp, cast({end} div {PIECE} as int)), 1, {end} % {PIECE}), ''), '')"
    return f"concat(coalesce({head}, ''), {middle}, {tail})"


def replaced(text: str, spans: str, label: str) -> str:
    """A text with its merged spans, not none, replaced; label: SQL of what stands for span x."""
    between = let("ca", "coalesce(get(cs, i - 1).end, 0)", let("cb", "x.start", cut("ca", "cb")))
    rest = let("ca", "get(cs, size(cs) - 1).end", let("cb", "cn", cut("ca", "cb")))
    whole = f"concat(array_join(transform(cs, (x, i) -> concat({between}, {label})), ''), {rest})"
    return let("cs", spans, let("cn", f"length({text})", let("cp", f"regexp_extract_all({text}, '(?s).{{1,{PIECE}}}', 0)", whole)))


def none_of(kind: str) -> str:
    return f"cast(array() as array<{kind}>)"


_DIGITS = "regexp_replace(x.text, '[^0-9]', '')"
_LUHN = f"""
    aggregate(
        sequence(1, length({_DIGITS})), 0,
        (acc, i) -> acc + if(i % 2 = 1,
            cast(substring({_DIGITS}, -i, 1) as int),
            (2 * cast(substring({_DIGITS}, -i, 1) as int)) % 10 + if(substring({_DIGITS}, -i, 1) >= '5', 1, 0)),
        acc -> acc % 10 = 0)"""

#: A match stays only where its check holds.
CHECKS = {
    "email": "true",
    "ip": "forall(split(x.text, '[.]'), q -> length(regexp_replace(q, '^0+', '')) <= 3 and coalesce(try_cast(concat('0', regexp_replace(q, '^0+', '')) as int), 999) <= 255)",
    "card": f"if(length({_DIGITS}) between 16 and 19, {_LUHN}, false)",
    "phone": f"length({_DIGITS}) between 8 and 15",
}

#: One form of an entity however it is written.
ENTITY = {"email": "lower(x.text)", "ip": "x.text", "card": _DIGITS, "phone": _DIGITS}


def base_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Adds one array of spans per kind to the columns kept; the input needs a column t without nulls."""
    t = F.col("t")
    may = {"email": t.contains("@"), "ip": t.rlike("[0-9]"), "card": t.rlike("[0-9]"), "phone": t.contains("+")}  # else no match
    found = {k: F.when(may[k], F.regexp_extract_all("t", F.lit(PATTERNS[k]), 0)).otherwise(F.expr(none_of("string"))) for k in KINDS}
    rows = docs.select(*keep, "t", *(found[k].alias(f"m_{k}") for k in KINDS))
    rows = rows.withColumns({f"p_{k}": F.when(F.size(f"m_{k}") > 0, F.split("t", PATTERNS[k])) for k in KINDS})
    rows = rows.withColumns({f"s_{k}": F.expr(f"if(size(m_{k}) > 0, {located(f'm_{k}', f'p_{k}')}, {none_of(_SPAN)})") for k in KINDS})
    return rows.withColumns({f"s_{k}": F.expr(f"filter(s_{k}, x -> {CHECKS[k]})") for k in KINDS}).select(*keep, "t", *(f"s_{k}" for k in KINDS))


def words_of(text: str):
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), 0), F.lower))


def maybe(words: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows of words (with term) that may be among the terms, a stored table: all that are, and some more.

    At most BUCKETS rows are broadcast: the terms' hashes, or where those are more, the buckets that they fall on.
    """
    hashed = terms.select(F.xxhash64("term").alias("hash")).distinct()
    few = hashed.count() <= BUCKETS
    fold = lambda h: h if few else F.pmod(h, F.lit(BUCKETS))
    wanted = F.broadcast(hashed.select(fold(F.col("hash")).alias("bucket")).distinct())
    return words.join(wanted, fold(F.xxhash64("term")) == F.col("bucket"), "left_semi")


def rarest(n, n_e):
    """Documents that may have a term at most, so that it can pass GENERALISE for an entity of n_e among n documents: the
    bound for a term that stands wherever the entity does."""
    return F.pow(n, F.lit(1 - GENERALISE)) * F.pow(n_e, F.lit(GENERALISE)) * (1 + 1e-9)


def held(rows: DataFrame, name: str, *more) -> DataFrame:
    """Of each name in rows (key, copies, name), distinct pairs of key and name: documents, texts, and a fingerprint of 128
    bits of the set of texts that hold it. Names of one set can't be told apart by any count."""
    sets = (F.bit_xor(F.xxhash64("key")).alias("x1"), F.bit_xor(F.xxhash64(F.reverse("key"))).alias("x2"))
    return rows.groupBy(name).agg(F.sum("copies").alias("documents"), F.count(F.lit(1)).alias("texts"), *sets, *more).where(F.col("texts") >= SUPPORT)


_SET = ["documents", "texts", "x1", "x2"]


def disclosures(found: DataFrame, texts: DataFrame, n_docs: int) -> DataFrame:
    """(term, strength) of the terms whose disclosure of some entity passes GENERALISE; found: key, copies, words,
    entity_names.

    Entities that the same texts hold count as one, and so do terms; only sets of either kind meet within a text, and of
    terms only those rare enough. So a list of thousands of addresses, and its copies, cost what their words do.
    """
    n = F.lit(float(n_docs))
    entities = held(found.select("key", "copies", F.explode("entity_names").alias("entity")), "entity").where(F.col("documents") < n)
    entities = entities.groupBy(*_SET).agg(F.min("entity").alias("entity")).select("entity", F.col("documents").alias("n_e"))
    holders = materialise(found.select("key", "copies", F.explode("entity_names").alias("entity")).join(entities, "entity"), "holders")
    words = found.join(holders.groupBy("key").agg(F.max("n_e").alias("most")), "key").select("key", "copies", "most", F.explode("words").alias("term"))
    terms = materialise(held(words, "term", F.max("most").alias("most")).where(F.col("documents") <= rarest(n, F.col("most"))).drop("most"), "terms")
    sets = materialise(terms.groupBy(*_SET).agg(F.min("term").alias("term")), "term-sets")
    some = maybe(words, sets).join(sets.select("term", F.col("documents").alias("n_held")), "term").select("key", "term", "n_held")
    met = some.join(holders, "key").where(F.col("n_held") <= rarest(n, F.col("n_e")))
    pairs = met.groupBy("entity", "term", "n_e").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("n_te")).where(F.col("texts") >= SUPPORT)
    of_sets = sets.withColumnRenamed("term", "of_set").join(pairs.select(F.col("term").alias("of_set"), "n_e", "n_te").distinct(), "of_set").drop("of_set")
    information = F.log2(n / F.col("n_e"))
    strength = lambda n_t: F.log2(F.col("n_te") * n / (F.col(n_t) * F.col("n_e"))) / information
    # A term is in at least as many documents as hold an entity besides.
    pairs = terms.join(of_sets.where(strength("documents") >= GENERALISE - 1e-9), _SET)
    pairs = materialise(pairs.select("term", "n_e", "n_te"), "term-pairs")
    counts = maybe(texts.select(F.explode_outer(words_of("t")).alias("term")), pairs).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    return pairs.join(counts, "term").withColumn("strength", strength("n_t")).where(F.col("strength") >= GENERALISE).groupBy("term").agg(F.max("strength").alias("strength"))


def term_places(texts: DataFrame, strong: DataFrame) -> DataFrame:
    """key and the array of term spans with action, for every text that has a disclosing term outside its base spans."""
    action = F.when(F.col("strength") >= REMOVE, "removed").otherwise("generalised")
    own = F.expr("transform(" + " || ".join(f"s_{k}" for k in KINDS) + ", x -> named_struct('start', x.start, 'end', x.end, 'label', ''))")
    spans = base_spans(texts, ["key"]).select("key", "t", F.array_sort(own).alias("own"))
    blank = replaced("t", merged("own"), "repeat(' ', x.end - x.start)")
    # What stands outside base spans, at its own places.
    bare = spans.select("key", F.expr(f"if(size(own) > 0, {blank}, t)").alias("t"))
    words = bare.select("key", F.regexp_extract_all("t", F.lit(TERM), 0).alias("m"), F.split("t", TERM).alias("p"))
    words = words.withColumn("b", F.expr(block_starts("m", "p")))
    # The outer form, as for the other one the planner adds a filter that computes the whole array once more. Only words
    # that may disclose something are located; arrays are looked at where they stand, not copied for each word.
    spread = words.select("key", "m", "p", "b", F.posexplode_outer("m").alias("i", "word")).withColumn("term", F.lower("word"))
    some = maybe(spread, strong).withColumn("start", F.expr(start_of("i", "m", "p", "b")))
    some = some.select("key", "term", "start", (F.col("start") + F.length("word")).alias("end"))
    hits = some.join(strong.select("term", action.alias("action")).hint("merge"), "term")
    return hits.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "end", "action"))).alias("terms"))


def find(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, key, spans of each kind; terms: key and its array of term spans with action).

    key stands for the text. Both are stored tables; the second has texts with a disclosing term only.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t")).withColumn("key", F.md5("t"))
    places = {f"s_{k}": F.transform(f"s_{k}", lambda x: F.struct(x["start"], x["end"])) for k in KINDS}
    names = F.concat(*(F.expr(f"transform(s_{k}, x -> concat('{k}:', {ENTITY[k]}))") for k in KINDS))
    named = base_spans(texts, ["doc_id", "key"]).withColumn("entity_names", F.array_distinct(names))
    rows = materialise(named.withColumn("words", F.when(F.size("entity_names") > 0, words_of("t"))).withColumns(places).drop("t"), "base-spans")
    holding = rows.where(F.size("entity_names") > 0)
    copies = holding.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("words").alias("words"), F.first("entity_names").alias("entity_names"))
    strong = materialise(disclosures(materialise(copies, "entity-texts"), texts, rows.count()), "disclosing-terms")
    return rows.drop("words"), materialise(term_places(texts, strong), "term-spans")


def joined(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """rows (with key) and the term spans of their texts, by the same join at every size. A text may hold a third of all
    rows: its partition can be split, as the other side has one row a text."""
    return rows.join(terms.withColumnRenamed("key", "of_key").hint("merge"), F.col("key") == F.col("of_key"), "left").drop("of_key")


def span_strings(kind: str, spans: str):
    return F.transform(F.coalesce(F.col(spans), F.array().cast("array<struct<start:int,end:int>>")), lambda x: F.concat(F.lit(f"{kind}:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))


def find_digests(docs: DataFrame) -> DataFrame:
    """Counts of base spans, their checksum, and all spans; terms follow as kind `term`."""
    rows, terms = find(docs)
    both = joined(rows, terms).withColumn("terms", F.transform("terms", lambda x: F.struct(x["start"], x["end"])))
    base = F.concat(*(span_strings(k, f"s_{k}") for k in KINDS))
    return both.select("doc_id", *(F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, span_strings("term", "terms")), ",").alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with every base span replaced by its kind's label, and disclosing terms generalised or removed.

    All columns are returned as they came, but text. Overlapping spans are replaced as one, by the label of the first.
    Base spans are found again beside the text, which costs less than shuffling them to it.
    """
    columns = docs.columns
    _, terms = find(docs)
    named = docs.select(F.struct(*columns).alias("row"), F.coalesce("text", F.lit("")).alias("t"), F.col("doc_id")).withColumn("key", F.md5("t"))
    rows = joined(base_spans(named, ["row", "doc_id", "key"]), terms)
    entry = lambda k: F.transform(f"s_{k}", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(LABELS[k]).alias("label")))
    of_terms = F.transform(F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,action:string>>")), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(x["action"] == "removed", LABELS["removed"]).otherwise(LABELS["generalised"]).alias("label")))
    rows = rows.withColumn("spans", F.array_sort(F.concat(*(entry(k) for k in KINDS), of_terms)))
    rows = rows.withColumn("clean", F.expr(f"if(size(spans) > 0, {replaced('t', merged('spans'), 'x.label')}, row.text)"))
    return rows.select(*(F.col("clean").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in columns))
