"""Annotations for display: entity dictionaries with small gaps closed, and rows by kind."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import spans as S


def by_kind(anns: DataFrame, labels: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Segments and entities of the labels (all, if none are named)."""
    rows = anns if labels is None else anns.where(F.col("label").isin(labels))
    return rows.where("kind = 'segment'"), rows.where("kind = 'entity'")


def display_rows(docs: DataFrame, entities: DataFrame, max_gap_length: int = 3) -> DataFrame:
    """doc_id, text, ents (start, end, label in order): what an entity viewer takes."""
    packed = entities.groupBy("doc_id").agg(F.collect_list(F.struct("seq", "label", "spans")).alias("e"))
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").join(packed, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                found = [(s.start, s.end, e["label"]) for e in r["e"] or () for s in S.close_gaps(S.normalize(S.from_rows(e["spans"])), r["text"], max_gap_length)]
                out.append([{"start": a, "end": b, "label": label} for a, b, label in sorted(found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], ["doc_id", "text", "ents"])

    return rows.mapInArrow(run, "doc_id string, text string, ents array<struct<start: int, end: int, label: string>>")
