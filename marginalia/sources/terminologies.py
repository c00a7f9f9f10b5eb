"""Terminology tables in rich release format, and the groups of semantic types."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_AT = {"cui": 0, "lang": 1, "lui": 3, "source": 11, "term": 14}


def _piped(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split("value", r"\|").alias("f"), F.col("_metadata.file_path").alias("file_"), F.monotonically_increasing_id().alias("line"))


def load_entries(spark: SparkSession, mrconso: str, mrsty: str | None = None, sources: Iterable[str] | None = None, languages: Iterable[str] | None = None) -> DataFrame:
    """cui, term, source, lang, lui, semtypes: of each lexical unit (lui) the first row of the file."""
    rows = _piped(spark, mrconso).select(*(F.col("f")[i].alias(k) for k, i in _AT.items()), "line")
    if languages is not None:
        rows = rows.where(F.col("lang").isin(list(languages)))
    if sources is not None:
        rows = rows.where(F.col("source").isin(list(sources)))
    # The line numbers grow in file order, so the first of a unit is the same on every run.
    first = F.min_by(F.struct("cui", "lang", "source", "term"), "line").alias("x")
    rows = rows.groupBy("lui").agg(first).select("x.cui", "x.term", "x.source", "x.lang", "lui")
    if mrsty is None:
        return rows.withColumn("semtypes", F.lit(None).cast("array<string>"))
    return rows.join(semtypes_by_cui(spark, mrsty), "cui", "left")


def semtypes_by_cui(spark: SparkSession, mrsty: str) -> DataFrame:
    rows = _piped(spark, mrsty).select(F.col("f")[0].alias("cui"), F.col("f")[1].alias("tui"), "line")
    ordered = F.array_sort(F.collect_list(F.struct("line", "tui")))
    return rows.groupBy("cui").agg(F.transform(ordered, lambda x: x.tui).alias("semtypes"))


def load_groups(spark: SparkSession, path: str) -> DataFrame:
    """semtype, semgroup of a file of lines group|name|type|type name."""
    return _piped(spark, path).select(F.col("f")[2].alias("semtype"), F.col("f")[0].alias("semgroup"))


def with_groups(entries: DataFrame, groups: DataFrame, allowed: Iterable[str] | None = None) -> DataFrame:
    """Entries with semgroups (in the order of their types, each once) of which at least one is allowed."""
    types = entries.select("lui", F.posexplode("semtypes").alias("at", "semtype")).join(groups, "semtype")
    if allowed is not None:
        types = types.where(F.col("semgroup").isin(list(allowed)))
    ordered = F.array_sort(F.collect_list(F.struct("at", "semgroup")))
    packed = types.groupBy("lui").agg(F.array_distinct(F.transform(ordered, lambda x: x.semgroup)).alias("semgroups"))
    return entries.join(packed, "lui")


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in an explicit order."""
    at = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("r_", F.row_number().over(at)).where("r_ = 1").drop("r_")
