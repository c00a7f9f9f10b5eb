"""Documents and annotations as JSON: one object per file, or a header line and one object per line."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marginalia.schema import ANN, RELATION

VERSION = "1.0"
KINDS = ("text_document", "text_document_list", "text_annotation_list", "audio_document", "audio_document_list", "audio_annotation_list")
AUDIO_ANN = "doc_id string, uid string, label string, start double, end double, metadata map<string, string>, seq long"


class HeaderError(ValueError):
    """A file of another version or content."""


def check_header(head: dict, kind: str) -> None:
    if head.get("version") != VERSION:
        raise HeaderError(f"version {head.get('version')!r}; {VERSION!r} is needed")
    if head.get("content_type") != kind:
        raise HeaderError(f"content {head.get('content_type')!r}; {kind!r} is needed")


def _doc_schema(audio: bool) -> str:
    anns = AUDIO_ANN if audio else ANN
    body = "audio struct<path: string, sample_rate: int, nb_channels: int, nb_samples: bigint>" if audio else "text string"
    as_struct = lambda ddl: StructType.fromDDL(ddl).simpleString()
    return f"doc_id string, {body}, metadata map<string, string>, anns array<{as_struct(anns)}>" + ("" if audio else f", relations array<{as_struct(RELATION)}>")


def nest(docs: DataFrame, anns: DataFrame | None = None, relations: DataFrame | None = None) -> DataFrame:
    """One row per document with its annotations and relations as arrays, in order."""
    out = docs
    for name, rows in (("anns", anns), ("relations", relations)):
        if rows is not None:
            packed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "uid", F.struct(*rows.columns).alias("row"))), lambda a, b: F.when(a.seq < b.seq, -1).when(a.seq > b.seq, 1).when(a.uid < b.uid, -1).when(a.uid > b.uid, 1).otherwise(0)).alias("p_"))
            out = out.join(packed.select("doc_id", F.transform("p_", lambda p: p.row).alias(name)), "doc_id", "left")
    return out


def write_lines(rows: DataFrame, path: str, kind: str) -> None:
    """A folder of JSON lines with the header as its own file: executors write, nothing passes the driver."""
    spark = rows.sparkSession
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("errorifexists").text(f"{path}/rows")
    spark.createDataFrame([(json.dumps({"version": VERSION, "content_type": kind}),)], "value string").coalesce(1).write.text(f"{path}/header")


def read_lines(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    head = spark.read.text(f"{path}/header").first()
    check_header(json.loads(head[0]) if head else {}, kind)
    return spark.read.schema(schema).json(f"{path}/rows")


def save_documents(docs: DataFrame, path: str, anns: DataFrame | None = None, relations: DataFrame | None = None, split_anns: bool = False, audio: bool = False) -> None:
    """Documents with their annotations within them, or (split_anns) beside them in <path>_anns."""
    prefix = "audio" if audio else "text"
    write_lines(docs if split_anns else nest(docs, anns, relations), path, f"{prefix}_document_list")
    if split_anns and anns is not None:
        save_annotations(anns, f"{path}_anns", audio)


def save_annotations(anns: DataFrame, path: str, audio: bool = False) -> None:
    write_lines(anns, path, f"{'audio' if audio else 'text'}_annotation_list")


def load_annotations(spark: SparkSession, path: str, audio: bool = False) -> DataFrame:
    return read_lines(spark, path, f"{'audio' if audio else 'text'}_annotation_list", AUDIO_ANN if audio else ANN)


def load_documents(spark: SparkSession, path: str, audio: bool = False) -> DataFrame:
    return read_lines(spark, path, f"{'audio' if audio else 'text'}_document_list", _doc_schema(audio))


def annotations_of(nested: DataFrame) -> DataFrame:
    return nested.select(F.explode("anns").alias("a")).select("a.*")


def relations_of(nested: DataFrame) -> DataFrame:
    return nested.select(F.explode("relations").alias("r")).select("r.*")


def save_document_file(nested: DataFrame, doc_id: str, file: str, split_anns: bool = False) -> None:
    """One document as an indented file of its own, for exchange with other tools."""
    row = nested.where(F.col("doc_id") == doc_id).select(F.to_json(F.struct(*nested.columns)).alias("j")).first()
    if row is None:
        raise KeyError(doc_id)
    content = json.loads(row["j"])
    kind = "audio_document" if "audio" in content else "text_document"
    if split_anns:
        anns = content.pop("anns", [])
        side = Path(file).with_suffix("").as_posix() + "_anns.jsonl"
        head = json.dumps({"version": VERSION, "content_type": kind.replace("document", "annotation_list")})
        Path(side).write_text("\n".join([head, *(json.dumps(a, ensure_ascii=False) for a in anns)]) + "\n")
    Path(file).write_text(json.dumps({"version": VERSION, "content_type": kind, "content": content}, indent=4, ensure_ascii=False))


def load_document_file(spark: SparkSession, file: str, anns_file: str | None = None) -> DataFrame:
    whole = json.loads(Path(file).read_text())
    kind = whole.get("content_type")
    check_header(whole, kind if kind in ("text_document", "audio_document") else "text_document")
    content = whole["content"]
    if anns_file:
        head, *lines = Path(anns_file).read_text().splitlines()
        check_header(json.loads(head), kind.replace("document", "annotation_list"))
        content["anns"] = [json.loads(x) for x in lines if x]
    lines = spark.createDataFrame([(json.dumps(content),)], "j string")
    return lines.select(F.from_json("j", _doc_schema(kind == "audio_document")).alias("d")).select("d.*")
