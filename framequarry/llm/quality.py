"""Quality rules at the level of hosts, in DataFrame operations only.

Every document gets exact counts and a set of rule failures. Failures are summed by host (partial sums before the
shuffle), each host's failure rate is shrunk towards the corpus by an empirical beta prior (its two parameters by the
method of moments over hosts), and the host's verdict goes back to its documents: a document that fails a soft rule
falls only with a rejected host or a second soft failure, and a blocked host loses all its documents.

Counts are computed once and kept as a narrow table in the shared folder; texts are never shuffled. Host verdicts are
broadcast where their counted number is small; else the join is salted, as one host may hold a third of all rows.

Defined cases: a null text has no words; a null host is a host of its own, as is the empty one; null ids stay; equal
rows count and return once each; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from framequarry.runtime import materialise

#: White space between words, and its negation, as Java patterns.
GAP, WORD_CHAR = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """Thresholds of the rules and verdicts."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbols_per_100_words: int = 30
    max_dup_line_percent: int = 30
    max_word_length: int = 15
    reject_rate: float = 0.5
    block_rate: float = 0.9
    salts: int = 64
    broadcast_hosts: int = 20_000


def word_array(text: Column) -> Column:
    """Words of a text: split at gaps, without the empty strings that gaps at either end leave."""
    parts = F.split(text, GAP + "+")
    lead = (F.element_at(parts, 1) == "").cast("int")
    last = ((F.element_at(parts, -1) == "") & (F.size(parts) > 1)).cast("int")
    return F.slice(parts, lead + 1, F.greatest(F.lit(0), F.size(parts) - lead - last))


def counts(docs: DataFrame, host: str | None = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, host and the exact counts of each text, besides the columns to keep.

    Words in repeated 3-word windows: windows are hashed to see which texts repeat any at all; only for those are the
    windows themselves sorted, equal neighbours found, and the words that they cover counted.
    """
    of_host = F.col(host).cast("string") if host in docs.columns else F.lit(None).cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), of_host.alias("host"), F.coalesce("text", F.lit("")).alias("t"), *keep)
    base = base.withColumns({
        "w": word_array(F.col("t")),
        "lines": F.filter(F.split("t", "\n"), lambda line: line.rlike(WORD_CHAR)),
        "word_chars": F.length(F.regexp_replace("t", GAP + "+", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace("t", f"[^{SYMBOLS}]+", "")).cast("long"),
    }).drop("t")
    last = F.size("w") - 3
    base = base.withColumns({
        "n_words": F.size("w").cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "hashes": F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))),
    }).drop("lines")
    windows = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("s"), i.alias("i")))
    base = base.withColumn("sorted", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(windows))).drop("hashes", "w")
    repeated = F.filter("sorted", lambda x, k: (F.get("sorted", k - 1)["s"] == x["s"]) | F.coalesce(F.get("sorted", k + 1)["s"] == x["s"], F.lit(False)))
    base = base.withColumn("starts", F.sort_array(F.transform(repeated, lambda x: x["i"]))).drop("sorted")
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("prev"))
    cover = F.aggregate("starts", none, lambda a, x: F.struct((a["n"] + 3 - F.greatest(F.lit(0), a["prev"] + 3 - x)).cast("long").alias("n"), x.alias("prev")), lambda a: a["n"])
    return base.withColumn("n_repeat_words", F.coalesce(cover, F.lit(0).cast("long"))).drop("starts")


def failures(counted: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds one boolean per rule, base_failed, and the number of soft failures."""
    words = F.col("n_words")
    return counted.withColumns({
        "few_words": words < limits.min_words,
        "repeats": 100 * F.col("n_repeat_words") > limits.max_repeat_percent * words,
        "symbols": 100 * F.col("n_symbols") > limits.max_symbols_per_100_words * words,
        "dup_lines": 100 * F.col("n_dup_lines") > limits.max_dup_line_percent * F.col("n_lines"),
        "word_length": F.col("word_chars") > limits.max_word_length * words,
    }).withColumns({
        "base_failed": F.col("few_words") | F.col("repeats"),
        "soft_failures": F.col("symbols").cast("int") + F.col("dup_lines").cast("int") + F.col("word_length").cast("int"),
    })


def host_totals(failed: DataFrame) -> DataFrame:
    """Documents of each host, and those that fail any rule."""
    any_rule = F.col("base_failed") | (F.col("soft_failures") > 0)
    return failed.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), F.sum(any_rule.cast("long")).alias("failed"))


def beta_prior(totals: DataFrame) -> tuple[float, float]:
    """Parameters of the beta distribution that hosts' failure rates follow, by moments; one row reaches the driver."""
    row = totals.agg(F.sum("docs").alias("n"), F.sum("failed").alias("k"), F.count(F.lit(1)).alias("hosts"), F.avg(F.col("failed") / F.col("docs")).alias("mean"), F.var_pop(F.col("failed") / F.col("docs")).alias("var"), F.avg(1 / F.col("docs")).alias("inverse")).first()
    if not row["n"]:
        return 1.0, 1.0
    mean = min(max(row["mean"], 1e-3), 1 - 1e-3)
    between = max(row["var"] - mean * (1 - mean) * row["inverse"], 0.0)  # without what sampling alone explains
    strength = min(max(mean * (1 - mean) / between - 1, 2.0), 1000.0) if between > 0 else 1000.0
    return mean * strength, (1 - mean) * strength


def host_verdicts(totals: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """host, shrunk rate, rejected, blocked."""
    a, b = beta_prior(totals)
    rate = (F.col("failed") + F.lit(a)) / (F.col("docs") + F.lit(a + b))
    return totals.withColumn("rate", rate).withColumns({"rejected": F.col("rate") >= limits.reject_rate, "blocked": F.col("rate") >= limits.block_rate})


def judge(docs: DataFrame, host: str | None = "source", limits: Limits = Limits(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts, rule failures, the host's shrunk rate and the verdict of each document, besides the columns to keep."""
    failed = materialise(failures(counts(docs, host, keep), limits), "rule-failures")
    totals = materialise(host_totals(failed), "host-totals")
    verdicts = host_verdicts(totals, limits).select(F.col("host").alias("of_host"), "rate", "rejected", "blocked")
    if totals.count() <= limits.broadcast_hosts:
        joined = failed.join(F.broadcast(verdicts), F.col("host").eqNullSafe(F.col("of_host")), "left").drop("of_host")
    else:  # a host's rows are dealt over salts, over which its verdict is repeated
        salted = verdicts.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(limits.salts - 1)))).hint("merge")
        dealt = failed.withColumn("salt_", F.pmod(F.xxhash64("doc_id", "word_chars"), F.lit(limits.salts)).cast("int"))
        joined = dealt.join(salted, F.col("host").eqNullSafe(F.col("of_host")) & (F.col("salt_") == F.col("of_salt")), "left").drop("salt_", "of_salt", "of_host")
    falls = F.col("base_failed") | F.col("blocked") | (F.col("soft_failures") >= 2) | ((F.col("soft_failures") >= 1) & F.col("rejected"))
    return joined.withColumn("kept", ~falls)


def judge_digests(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
