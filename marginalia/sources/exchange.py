"""Annotation-tool lines, speaker turns and subtitles: reading and writing."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import spans as S
from marginalia.operators.kernel import arrow_schema, attribute
from marginalia.schema import ANN, RELATION, make_uid, uid_column

TASKS = ("relation_extraction", "sequence_labeling", "text_classification")
_LINE = "file string, line string"


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line of .jsonl files."""
    return spark.read.option("pathGlobFilter", "*.jsonl").text(path).where("value <> ''").select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def read_zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line of the .jsonl members of .zip files."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(c)) as z:
                    for member in z.namelist():
                        if member.endswith(".jsonl"):
                            lines = [x for x in z.read(member).decode().split("\n") if x.strip()]
                            yield pa.RecordBatch.from_arrays([pa.array([f"{p}!{member}"] * len(lines), pa.string()), pa.array(lines, pa.string())], ["file", "line"])

    return raw.mapInArrow(run, _LINE)


def parse_doccano(line: str, task: str, attr_label: str = "label") -> tuple[dict, list[dict], list[dict]]:
    """Document, annotations and relations of one line; fields that the task doesn't use become metadata."""
    if task not in TASKS:
        raise ValueError(task)
    data = json.loads(line)
    text = data.pop("text")
    used = {"relation_extraction": ("entities", "relations"), "sequence_labeling": ("label",), "text_classification": ("label",)}[task]
    parts = {k: data.pop(k, None) or [] for k in used}
    doc = make_uid("doccano", line)
    uid = lambda k: make_uid("doccano", doc, k)
    base = {"doc_id": doc, "parent_uid": None, "kind": "entity", "keys": None, "attrs": None}
    anns, relations = [], []

    def entity(key: str, n: int, a: int, b: int, label: str) -> None:
        anns.append(base | {"uid": uid(key), "label": label, "text": text[a:b], "spans": S.to_rows([S.Span(a, b)]), "n_start": a, "n_end": b, "metadata": {"doccano_id": key}, "seq": n})

    if task == "relation_extraction":
        for n, e in enumerate(parts["entities"]):
            entity(str(e["id"]), n, e["start_offset"], e["end_offset"], e["label"])
        for n, r in enumerate(parts["relations"]):
            relations.append({"doc_id": doc, "uid": uid(f"r{r['id']}"), "label": r["type"], "source_id": uid(str(r["from_id"])), "target_id": uid(str(r["to_id"])), "metadata": {"doccano_id": str(r["id"])}, "seq": n})
    elif task == "sequence_labeling":
        for n, (a, b, label) in enumerate(parts["label"]):
            entity(f"e{n}", n, a, b, label)
    else:
        attr = attribute(attr_label, parts["label"][0] if parts["label"] else None) | {"uid": uid("label")}
        anns.append(base | {"uid": uid("raw"), "kind": "segment", "label": "RAW_TEXT", "text": text, "spans": S.to_rows([S.Span(0, len(text))]), "n_start": 0, "n_end": len(text), "metadata": None, "seq": 0, "attrs": [attr]})
    return {"doc_id": doc, "text": text, "metadata": {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in data.items()}}, anns, relations


def load_doccano(lines: DataFrame, task: str, attr_label: str = "label") -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs, anns, relations of lines (file, line)."""
    def part(which: int, ddl: str) -> DataFrame:
        to = arrow_schema(ddl)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [parse_doccano(x, task, attr_label)[which] for x in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_pylist(rows if which == 0 else [y for x in rows for y in x], to)

        return lines.select("line").mapInArrow(run, ddl)

    return part(0, "doc_id string, text string, metadata map<string, string>"), part(1, ANN), part(2, RELATION)


def wrong_line_ends(docs: DataFrame) -> DataFrame:
    """Documents with carriage returns, which shift the offsets of tools that count line ends once."""
    return docs.where(F.col("text").contains("\r\n"))


def _number(uid: Column) -> Column:
    """A positive number from an id, alike on every run."""
    return F.conv(F.substring(uid, 1, 12), 16, 10).cast("long")


def doccano_lines(docs: DataFrame, anns: DataFrame, relations: DataFrame | None = None, task: str = "relation_extraction", attr_label: str = "label", labels: list[str] | None = None, ignore_segments: bool = True, include_metadata: bool = True) -> DataFrame:
    """doc_id, line of each document. Relations with a missing end are left out."""
    rows = anns if labels is None else anns.where(F.col("label").isin(labels))
    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", *(["metadata"] if include_metadata and "metadata" in docs.columns else []))
    ents = rows.where("kind = 'entity'") if ignore_segments else rows
    ordered = lambda cols, name: F.transform(F.array_sort(F.collect_list(F.struct("seq", "uid", F.struct(*cols).alias("v")))), lambda x: x.v).alias(name)
    if task == "relation_extraction":
        e = ents.groupBy("doc_id").agg(ordered([_number(F.col("uid")).alias("id"), F.col("n_start").alias("start_offset"), F.col("n_end").alias("end_offset"), "label"], "entities"))
        own = own.join(e, "doc_id", "left").withColumn("entities", F.coalesce("entities", F.array()))
        if relations is not None:
            ends = ents.select("uid").distinct()
            good = relations.join(ends.withColumnRenamed("uid", "source_id"), "source_id", "left_semi").join(ends.withColumnRenamed("uid", "target_id"), "target_id", "left_semi")
            r = good.groupBy("doc_id").agg(ordered([_number(F.col("uid")).alias("id"), _number(F.col("source_id")).alias("from_id"), _number(F.col("target_id")).alias("to_id"), F.col("label").alias("type")], "relations"))
            own = own.join(r, "doc_id", "left").withColumn("relations", F.coalesce("relations", F.array()))
        return own.select("doc_id", F.to_json(F.struct(*(c for c in own.columns if c != "doc_id"))).alias("line"))
    if task == "sequence_labeling":
        e = ents.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n_start", "n_end", "label"))).alias("es"))
        triple = lambda x: F.concat(F.lit("["), x.n_start.cast("string"), F.lit(", "), x.n_end.cast("string"), F.lit(", "), F.to_json(F.array(x.label)).substr(F.lit(2), F.length(F.to_json(F.array(x.label))) - 2), F.lit("]"))
        shown = F.concat(F.lit('{"text":'), F.expr("substr(to_json(array(text)), 2, length(to_json(array(text))) - 2)"), F.lit(',"label":['), F.array_join(F.transform(F.coalesce("es", F.array()), triple), ", "), F.lit("]}"))
        return own.join(e, "doc_id", "left").select("doc_id", shown.alias("line"))
    if task == "text_classification":
        a = rows.select("doc_id", F.explode("attrs").alias("a")).where(F.col("a.label") == attr_label).groupBy("doc_id").agg(F.min("a.value").alias("v"))
        return own.join(a, "doc_id").select("doc_id", F.to_json(F.struct("text", F.array("v").alias("label"))).alias("line"))
    raise ValueError(task)


# Speaker turns.

RTTM = "type string, file_id string, channel string, onset double, duration double, na1 string, na2 string, speaker string, na3 string, na4 string"


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, file_id, start, end, speaker of the SPEAKER rows of turn files."""
    rows = spark.read.schema(RTTM).option("sep", " ").option("pathGlobFilter", "*.rttm").csv(path).where("type = 'SPEAKER'")
    return rows.select(uid_column(F.lit("rttm"), F.col("file_id")).alias("doc_id"), "file_id", F.col("onset").alias("start"), F.round(F.col("onset") + F.col("duration"), 6).alias("end"), "speaker", F.col("_metadata.file_path").alias("path"))


def mixed_turn_files(turns: DataFrame) -> DataFrame:
    """Files whose rows name more than one recording, which a turn file mustn't."""
    return turns.groupBy("path").agg(F.countDistinct("file_id").alias("n")).where("n > 1")


def turn_lines(turns: DataFrame, file_id: str = "file_id") -> DataFrame:
    """file_id, line of turns in order; a turn without a speaker is an error."""
    speaker = F.when(F.col("speaker").isNull(), F.raise_error(F.lit("a turn has no speaker"))).otherwise(F.col("speaker"))
    line = F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", F.col(file_id), F.col("start"), F.col("end") - F.col("start"), speaker)
    return turns.select(F.col(file_id).alias("file_id"), F.col("start"), line.alias("line"))


# Subtitles.


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """path, idx, start, end (seconds), text of subtitle files."""
    blocks = spark.read.format("binaryFile").option("pathGlobFilter", "*.srt").load(path).select("path", F.explode(F.split(F.regexp_replace(F.decode("content", "UTF-8"), "\r", ""), "\n\\s*\n")).alias("b"))
    time = r"(\d+):(\d\d):(\d\d)[,.](\d{3})"
    head = rf"(?s)^\s*(\d+)\n{time} --> {time}[^\n]*\n?(.*)$"
    g = lambda i: F.regexp_extract("b", head, i)
    at = lambda i: g(i).cast("double") * 3600 + g(i + 1).cast("double") * 60 + g(i + 2).cast("double") + g(i + 3).cast("double") / 1000
    return blocks.where(F.col("b").rlike(head)).select("path", g(1).cast("int").alias("idx"), F.round(at(2), 3).alias("start"), F.round(at(6), 3).alias("end"), F.regexp_replace(g(10), r"\s+$", "").alias("text"))


def clock(seconds: Column) -> Column:
    ms = F.round(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def subtitle_blocks(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, idx, block of segments (start, end, text), numbered from 0 in their order."""
    order = Window.partitionBy(key).orderBy("start", "end", "text")
    rows = segments.withColumn("idx", F.row_number().over(order) - 1)
    return rows.select(key, "idx", F.concat(F.col("idx").cast("string"), F.lit("\n"), clock(F.col("start")), F.lit(" --> "), clock(F.col("end")), F.lit("\n"), F.col("text"), F.lit("\n")).alias("block"))


def save_lines(rows: DataFrame, folder: str, key: str, order: str, value: str, ext: str, between: str = "\n") -> None:
    """One file per key in a folder that executors and driver share."""
    from pathlib import Path

    Path(folder).mkdir(parents=True, exist_ok=True)
    whole = rows.groupBy(F.col(key).alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), between).alias("v"))

    def write(part) -> None:
        for r in part:
            Path(folder, f"{r['k']}{ext}").write_text(r["v"] + "\n")

    whole.foreachPartition(write)
