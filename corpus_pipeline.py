"""A training-corpus pipeline: toxicity, quality rules, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from framequarry.llm import near_dedup, packing, pii, quality, toxicity
from framequarry.runtime import materialise, shuffle_width, table

#: Rows up to which the ids of documents that go may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def whole_rows(docs: DataFrame) -> DataFrame:
    """Every row as one struct, so that no column's name can clash, besides what a judgement reads."""
    source = [F.col("source")] if "source" in docs.columns else []
    return docs.select(F.struct(*docs.columns).alias("row_"), "doc_id", "text", *source)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is among those gone; rows without an id stay.

    The ids that go are kept as a table, whose size decides on a broadcast.
    """
    gone = materialise(gone.select(F.col("doc_id").alias("gone_id")).where("gone_id is not null").distinct(), "gone")
    small = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if small else gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model learns from the labelled documents of the original table."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(whole_rows(docs), model, keep=["row_"]).where("score < 0.5").select("row_.*")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and their host's verdict."""
    return quality.judge(whole_rows(docs), keep=("row_",)).where("kept").select("row_.*")


def with_keys(docs: DataFrame) -> DataFrame:
    """(key, row_): every row of a stored table with a number of its own, in the order of ids, those without one last.

    Only ids and places are sorted; a row's place is the same whenever the table is read.
    """
    placed = docs.select(F.struct(*docs.columns).alias("row_"), F.monotonically_increasing_id().alias("place"))
    order = (F.col("row_.doc_id").asc_nulls_last(), F.col("place").asc())
    ids = placed.select("place", F.struct(F.col("row_.doc_id").alias("doc_id")).alias("row_")).repartitionByRange(shuffle_width(docs.sparkSession), *order).sortWithinPartitions(*order)
    keys = materialise(ids.select("place", F.monotonically_increasing_id().alias("key")), "row-keys")
    return placed.join(keys, "place").select("key", "row_")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id, of each group of near-duplicates.

    Where rows share an id, or have none, the operator gets keys that tell them apart, so one row of each group stays
    and no other row goes with it.
    """
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 or doc_id is null")
    if shared.isEmpty():
        return without(docs, near_dedup.near_duplicates(docs).where("not kept"))
    rows = materialise(with_keys(docs), "keyed-rows")
    gone = near_dedup.near_duplicates(rows.select(F.col("key").alias("doc_id"), "row_.text")).where("not kept")
    return without(rows.withColumnRenamed("key", "doc_id"), gone).select("row_.*")


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data and the terms that disclose it; n_chars follows the text."""
    clean = pii.sanitise(docs)
    if "n_chars" in clean.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in training windows."""
    return packing.pack_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_dedup", drop_near_duplicates),
    ("pii", sanitise),
    ("packing", pack),
]

#: A learned score and minhash candidates have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents; each result is stored before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
