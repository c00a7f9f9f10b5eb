"""One file of JSON lines, its header first, in the layout that annotation tools exchange.

Line 1 is {version, content_type}; each other line is a document {uid, text, metadata, anns, attrs}
or an annotation.  Annotations tell their kind by the last part of `_class_name`; spans of text
that isn't in the document have `length` and `replaced_spans`.  Lines are parsed by the executors,
whatever the size of the file; a saved file is written by one task, as its form asks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import spans as S
from marginalia.operators.kernel import arrow_schema, attribute, pieces
from marginalia.plans.tables import shared_folder
from marginalia.schema import ANN, RELATION
from marginalia.sources.documents import HeaderError

VERSION = "0.2"
DOCS = "doc_id string, text string, metadata map<string, string>"
_NORM = ("kb_name", "kb_id", "kb_version", "term", "score")


def _header(kind: str) -> str:
    return json.dumps({"version": VERSION, "content_type": kind})


def read_lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The lines (value) after the header, which is checked."""
    rows = spark.read.text(path).where("value <> ''")
    is_header = F.get_json_object("value", "$.content_type").isNotNull() & F.get_json_object("value", "$.uid").isNull()
    head = rows.where(is_header).first()
    found = json.loads(head[0]) if head else {}
    if found.get("version") != VERSION or found.get("content_type") != kind:
        raise HeaderError(f"{found}; version {VERSION!r} and content {kind!r} are needed")
    return rows.where(~is_header)


def _class(row: dict) -> str:
    return str(row.get("_class_name") or "").rpartition(".")[2]


def _spans(rows: list[dict] | None) -> list:
    plain = lambda r: S.Span(r["start"], r["end"])
    return [S.Mod(r["length"], tuple(map(plain, r.get("replaced_spans") or ()))) if r.get("length") is not None else plain(r) for r in rows or ()]


def _text(value) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _attr(row: dict) -> dict:
    """An attribute row; fields beyond label and value become metadata."""
    known = {"uid", "label", "value", "metadata", "_class_name", *_NORM}
    norm = {k: row.get(k) for k in _NORM} if any(row.get(k) is not None for k in ("kb_name", "kb_id", "term")) else None
    value = row.get("value")
    made = attribute(row["label"], value if isinstance(value, (bool, int, float)) else _text(value), _class(row) or "Attribute", norm)
    about = {k: _text(v) for k, v in {**(row.get("metadata") or {}), **{k: v for k, v in row.items() if k not in known}}.items()}
    return made | {"uid": row["uid"], "metadata": about or None}


def _ann(doc: str, row: dict, seq: int) -> dict:
    spans = _spans(row.get("spans"))
    low, high = S.bounds(spans)
    return {
        "doc_id": doc, "uid": row["uid"], "parent_uid": None, "kind": "entity" if _class(row) == "Entity" else "segment", "label": row["label"], "text": row.get("text"), "spans": S.to_rows(spans), "n_start": low, "n_end": high,
        "keys": row.get("keys"), "metadata": {k: _text(v) for k, v in (row.get("metadata") or {}).items()} or None, "seq": seq, "attrs": [_attr(a) for a in row.get("attrs") or ()] or None,
    }


def _relation(doc: str, row: dict, seq: int) -> dict:
    return {"doc_id": doc, "uid": row["uid"], "label": row["label"], "source_id": row["source_id"], "target_id": row["target_id"], "metadata": {k: _text(v) for k, v in (row.get("metadata") or {}).items()} or None, "seq": seq}


def _parsed(lines: DataFrame, make, shape: str) -> DataFrame:
    schema = arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_pylist([row for line in batch.column(0).to_pylist() for row in make(json.loads(line))], schema)

    return lines.mapInArrow(run, shape)


def _parts(row: dict, relations: bool) -> Iterator[dict]:
    for n, a in enumerate(row.get("anns") or ()):
        if (_class(a) == "Relation") == relations:
            yield (_relation if relations else _ann)(row["uid"], a, n)


def load_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, their annotations and their relations."""
    lines = read_lines(spark, path, "text_document_list")
    docs = _parsed(lines, lambda d: [{"doc_id": d["uid"], "text": d.get("text"), "metadata": {k: _text(v) for k, v in (d.get("metadata") or {}).items()} or None}], DOCS)
    return docs, _parsed(lines, lambda d: _parts(d, False), ANN), _parsed(lines, lambda d: _parts(d, True), RELATION)


def load_annotations(spark: SparkSession, path: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """Annotations and relations of a file of annotations, which belong to one document."""
    lines = read_lines(spark, path, "text_annotation_list")
    anns = _parsed(lines, lambda a: [] if _class(a) == "Relation" else [_ann(doc_id, a, 0)], ANN)
    return anns, _parsed(lines, lambda a: [_relation(doc_id, a, 0)] if _class(a) == "Relation" else [], RELATION)


def _typed(attr: dict):
    kind, value = attr["value_type"], attr["value"]
    return None if value is None else {"bool": lambda v: v == "true", "int": int, "float": float}.get(kind, str)(value)


def _shown(row: dict, prefix: str) -> dict:
    """The JSON object of an annotation or relation row."""
    base = {"uid": row["uid"], "label": row["label"], "metadata": dict(row["metadata"] or ())}
    if "source_id" in row:
        return base | {"source_id": row["source_id"], "target_id": row["target_id"], "attrs": [], "_class_name": f"{prefix}Relation"}
    span = lambda s: {"start": s.start, "end": s.end, "_class_name": f"{prefix}Span"}
    spans = [span(s) if isinstance(s, S.Span) else {"length": s.length, "replaced_spans": [span(r) for r in s.replaced], "_class_name": f"{prefix}ModifiedSpan"} for s in S.from_rows(row["spans"])]
    attrs = [
        {"uid": a["uid"], "label": a["label"], "value": _typed(a), "metadata": dict(a["metadata"] or ()), "_class_name": prefix + (a["attr_class"] or "Attribute"), **({k: v for k, v in a["norm"].items() if v is not None} if a["norm"] else {})} for a in row["attrs"] or ()
    ]
    return base | {"text": row["text"], "spans": spans, "attrs": attrs, "_class_name": prefix + ("Entity" if row["kind"] == "entity" else "Segment")}


def _one_file(lines: DataFrame, kind: str, path: str) -> None:
    """The lines in one file after their header."""
    spark = lines.sparkSession
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    first = spark.createDataFrame([(0, _header(kind))], "o int, value string")
    first.unionByName(lines.select(F.lit(1).alias("o"), "value")).coalesce(1).sortWithinPartitions("o").select("value").write.text(folder)
    paths, hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    source = paths.Path(folder)
    part = [s.getPath() for s in source.getFileSystem(hadoop).listStatus(source) if s.getPath().getName().startswith("part-")][0]
    target = paths.Path(path)
    paths.FileUtil.copy(source.getFileSystem(hadoop), part, target.getFileSystem(hadoop), target, False, hadoop)
    source.getFileSystem(hadoop).delete(source, True)


def _lines(rows: DataFrame, show) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(show(r), ensure_ascii=False) for r in batch.to_pylist(maps_as_pydicts="strict")], pa.string())], ["value"])

    return rows.mapInArrow(run, "value string")


def save_documents(docs: DataFrame, anns: DataFrame, path: str, relations: DataFrame | None = None, class_prefix: str = "") -> None:
    """Documents with their annotations and relations as one file. `class_prefix` is what the reading tool has in front of class names."""
    from marginalia.sources.documents import nest

    def show(row: dict) -> dict:
        inside = [*(row["anns"] or ()), *(row.get("relations") or ())]
        return {"uid": row["doc_id"], "text": row["text"], "metadata": dict(row.get("metadata") or ()), "anns": [_shown(a, class_prefix) for a in inside], "attrs": [], "_class_name": f"{class_prefix}TextDocument"}

    _one_file(_lines(nest(docs, anns, relations), show), "text_document_list", path)


def save_annotations(anns: DataFrame, path: str, class_prefix: str = "") -> None:
    _one_file(_lines(anns, lambda a: _shown(a, class_prefix)), "text_annotation_list", path)
