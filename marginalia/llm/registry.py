"""Queries of the corpus operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm import quality

    return quality.keep_good(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm import language

    return language.identify(_table(spark, sf_dir, "documents"))


def op3_pii_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm import private

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return private.sanitise_documents(docs, counts=True)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm import substrings

    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


def op5_packed_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm import shards

    return shards.assign(_table(spark, sf_dir, "documents"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm import lm

    return lm.score(_table(spark, sf_dir, "documents"))


def op7_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm import neardup

    found = neardup.groups(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "rep_id", "group_size", "keep")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm import pieces

    return pieces.encode(_table(spark, sf_dir, "documents"))


def op9_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm import nearest

    return nearest.top_products(_table(spark, sf_dir, "embeddings"))


def op10_benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm import decontaminate

    found = decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "kind", "position", "matched", "n_terms")


OP9_SQL = """
WITH scored AS (
  SELECT a.vec_id, b.vec_id AS neighbor_id,
         round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 8) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbor_id) AS INTEGER) AS rank FROM scored
)
SELECT vec_id, neighbor_id, score, rank FROM ranked WHERE rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op9_top_products": OP9_SQL}
