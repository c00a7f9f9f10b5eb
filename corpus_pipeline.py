"""The corpus pipeline: five stages over the documents, each written as Parquet and read again by the next.

Each stage works on all that its predecessor kept and returns the columns of `documents`
(the last adds the token ids).  ORACLE_SQL is None: SQL can't express the stages; the tests
hold all five, one after the other, against versions without tables or kernels instead.

Defined results: documents with a null, empty or letterless text have no language and go at
the first stage, as do those whose language is unsure.  Of rows that repeat another, and of
near copies, the one with the lowest id stays (null ids last).  Texts of any length are
worked on whole.  A tie of languages goes to the one that sorts first and is below the
confidence that keeps; a tie at the threshold of disclosure hides the term.  Columns of other
names are kept as they are; the added one is called piece_ids, with an underscore where that is
taken.  An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import decontaminate, language, neardup, pieces, private
from marginalia.llm.common import shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be identified go; `lang` becomes the identified language."""
    return language.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return neardup.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are generalised; every document stays."""
    return private.sanitise_documents(docs)


def tokenisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text's best segmentation are added."""
    return pieces.add_ids(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sanitisation", sanitisation),
    ("tokenisation", tokenisation),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs


ORACLE_SQL = None
