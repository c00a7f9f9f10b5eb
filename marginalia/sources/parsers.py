"""Objects of parser libraries, in and out, by the attributes that such documents have in common.

A parsed document has `text`, `ents` and `spans` (groups by name) of spans with `start_char`,
`end_char` and `label_`; extension values lie under `_` of a span.  Nothing here imports a
library: what makes or reads an object runs on the executors with what is installed there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import spans as S
from marginalia.operators.kernel import Found, Rows, Segment, attribute, pieces
from marginalia.schema import ANN, RAW_TEXT, make_uid, op_id, raw_segments


def findings(parsed, entities: Iterable[str] | None = None, groups: Iterable[str] | None = None, attrs: Iterable[str] = ()) -> Iterator[tuple[str, int, int, dict]]:
    """label, start, end, attributes of a parsed document's entities and of its span groups (all of them, if none is named)."""
    wanted = None if entities is None else set(entities)
    value = lambda span: {a: getattr(span._, a) for a in attrs if getattr(getattr(span, "_", None), a, None) is not None}
    for span in parsed.ents:
        if wanted is None or span.label_ in wanted:
            yield span.label_, span.start_char, span.end_char, value(span)
    for name in parsed.spans if groups is None else groups:
        for span in parsed.spans[name] if name in parsed.spans else ():
            yield span.label_ or name, span.start_char, span.end_char, value(span)


def load(docs: DataFrame, make: Callable[[], Callable[[bytes], object]], content: str = "content", doc_id: str = "doc_id", **chosen) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text) and annotations of stored parsed documents: `make` gives a reader of their bytes, once per worker."""
    rows, me = Rows(op_id("ParsedDocuments", {k: sorted(v) for k, v in chosen.items() if v is not None})), docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(content).alias("content"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = make()
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([read(c).text for c in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    def anns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = make()
        for batch in pieces(batches):
            for doc, c in zip(*(x.to_pylist() for x in batch.columns)):
                parsed = read(c)
                seg = Segment(doc, make_uid(RAW_TEXT, doc), RAW_TEXT, parsed.text, [S.Span(0, len(parsed.text))])
                rows.add(seg, (Found(label, (a, b), kind="entity", attrs=[attribute(k, v) for k, v in attrs.items()]) for label, a, b, attrs in findings(parsed, **chosen)))
            yield rows.batch()

    return me.mapInArrow(texts, "doc_id string, text string"), me.mapInArrow(anns, ANN)


def save(docs: DataFrame, anns: DataFrame, make: Callable[[], Callable[[str, list[tuple[str, int, int, dict]]], bytes]], labels: Iterable[str] | None = None) -> DataFrame:
    """doc_id, content: `make` gives a builder of a stored parsed document from a text and its (label, start, end, attributes), in order.

    Spans in pieces become their hulls, as parsed documents have spans in one piece.
    """
    kept = anns.where("n_start IS NOT NULL")
    kept = kept if labels is None else kept.where(F.col("label").isin(list(labels)))
    packed = kept.groupBy("doc_id").agg(F.collect_list(F.struct("n_start", "n_end", "label", "uid", "attrs")).alias("anns"))
    rows = raw_segments(docs).select("doc_id", "text").join(packed, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        build = make()
        for batch in pieces(batches):
            out = []
            for r in batch.to_pylist():
                found = sorted(r["anns"] or (), key=lambda a: (a["n_start"], a["n_end"], a["label"], a["uid"]))
                out.append(build(r["text"], [(a["label"], a["n_start"], a["n_end"], {x["label"]: x["value"] for x in a["attrs"] or ()}) for a in found]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "content"])

    return rows.select("doc_id", "text", "anns").mapInArrow(run, "doc_id string, content binary")
