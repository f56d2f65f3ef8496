"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framequarry.llm import audio, bpe, collocations, licenses, near_dedup, ngram_join, packing, pii, quality, sharding, toxicity, variants, warc
from framequarry.llm.oracles import oracle_sql
from framequarry.runtime import table

__all__ = ["oracle_sql", "queries"]

Query = Callable[[SparkSession, str], DataFrame]


def over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


def queries() -> dict[str, Query]:
    return {
        "op1_bpe": over("documents", bpe.encode_digests),
        "op2_packing": over("documents", packing.pack_digests),
        "op3_media": over("documents", audio.media_digests),
        "op4_quality": over("documents", quality.judge_digests),
        "op5_near_dedup": over("documents", near_dedup.near_duplicate_digests),
        "op6_toxicity": lambda spark, sf_dir: toxicity.score_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op7_sharding": over("documents", sharding.shard_digests),
        "op8_pii": over("documents", pii.find_digests),
        "op9_licenses": over("documents", licenses.scan_digests),
        "op10_warc": over("pages", warc.revisit_digests),
        "op11_ngram_join": over("documents", ngram_join.jaccard_digests),
        "op12_collocations": over("documents", collocations.collocations),
        "op13_variants": over("documents", variants.variants),
    }
