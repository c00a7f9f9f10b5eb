"""Corpora in their own formats: case collections as JSON and as layered XML, transcription samples."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import spans as S
from marginalia.operators.kernel import arrow_schema, norm_attribute
from marginalia.schema import ANN, make_uid, uid_column
from marginalia.sources.documents import save_documents

CASE = "id string, text string, authors array<struct<author: string>>, doi string, publication_date string, url string, source string, source_url string, licence string, language string, type string, description string"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """docs of a folder of case files (.json): the other fields become metadata."""
    rows = spark.read.schema(CASE).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    kept = [c for c in rows.columns if c not in ("id", "text", "authors")]
    pairs = F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in kept))
    metadata = F.map_from_entries(F.filter(pairs, lambda p: p.v.isNotNull()))
    return rows.select(uid_column(F.lit("case"), F.col("id")).alias("doc_id"), "text", metadata.alias("metadata"))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def parse_layers(content: str, doc: str, keep_sentences: bool = False) -> tuple[str, list[dict]]:
    """Text and annotations of one layered XML file: clinical entities with their concept, and sentences if asked for."""
    text, found = "", []
    for e in ET.fromstring(content).iter():
        name = _local(e.tag)
        if name == "Sofa":
            text = e.get("sofaString", "")
        elif name in ("CLINENTITY", "EVENT") or (keep_sentences and name == "Sentence"):
            found.append((int(e.get("begin")), int(e.get("end")), "sentence" if name == "Sentence" else "disorder" if name == "CLINENTITY" else "event", e.get("entityID")))
    rows = []
    for n, (a, b, label, cui) in enumerate(sorted(found, key=lambda f: f[:3])):
        attrs = [norm_attribute(kb_name="umls", kb_id=cui) | {"uid": make_uid("layer-norm", doc, n)}] if cui else None
        kind = "segment" if label == "sentence" else "entity"
        rows.append({"doc_id": doc, "uid": make_uid("layer", doc, n), "parent_uid": None, "kind": kind, "label": label, "text": text[a:b], "spans": S.to_rows([S.Span(a, b)]), "n_start": a, "n_end": b, "keys": None, "metadata": None, "seq": n, "attrs": attrs})
    return text, rows


def read_annotated_cases(spark: SparkSession, path: str, keep_sentences: bool = False) -> tuple[DataFrame, DataFrame]:
    """docs and anns of a folder of layered XML files."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(path).select("path", F.decode("content", "UTF-8").alias("content"))
    schema = arrow_schema(ANN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in parse_layers(c, make_uid("case", p), keep_sentences)[1]]
            yield pa.RecordBatch.from_pylist(rows, schema)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            body = [parse_layers(c, "")[0] for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([make_uid("case", p) for p in paths], pa.string()), pa.array(body, pa.string())], ["doc_id", "text"])

    return raw.mapInArrow(texts, "doc_id string, text string"), raw.mapInArrow(run, ANN)


def read_samples(spark: SparkSession, path: str, translated: bool = True, nb_max: int | None = None) -> DataFrame:
    """docs of a local copy of transcription samples: JSON (translated) or CSV. nb_max is a head in file order."""
    if translated:
        rows = spark.read.option("multiLine", True).schema("id long, description string, medical_specialty string, sample_name string, transcription string, keywords string").json(path)
    else:
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).withColumnRenamed("_c0", "id")
        rows = rows.withColumn("id", F.col("id").cast("long"))
    if nb_max is not None:
        rows = rows.orderBy("id").limit(nb_max)
    pairs = F.map_from_arrays(F.array(*map(F.lit, ("id", "sample_name", "medical_specialty"))), F.array(F.col("id").cast("string"), "sample_name", "medical_specialty"))
    return rows.select(uid_column(F.lit("sample"), F.col("id")).alias("doc_id"), F.coalesce("transcription", F.lit("")).alias("text"), pairs.alias("metadata"))


def convert_cases(spark: SparkSession, path: str, output: str) -> None:
    save_documents(read_cases(spark, path), output)


def convert_annotated_cases(spark: SparkSession, path: str, output: str, keep_sentences: bool = False) -> None:
    docs, anns = read_annotated_cases(spark, path, keep_sentences)
    save_documents(docs.withColumn("metadata", F.lit(None).cast("map<string, string>")), output, anns)


def convert_samples(spark: SparkSession, path: str, output: str, translated: bool = True) -> None:
    save_documents(read_samples(spark, path, translated), output)
