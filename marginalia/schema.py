"""Flat tables that stand for annotated documents, and deterministic ids.

docs(doc_id, text, metadata)  anns(...)  relations(...)  attrs(...): rows are keyed by doc_id;
spans are code-point offsets, half open.  A span with `length` set stands for text that isn't
in the document; `replaced` lists the stretches of the document that it stands for.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE = "struct<start: int, end: int>"
SPAN = f"struct<start: int, end: int, length: int, replaced: array<{RANGE}>>"
NORM = "struct<kb_name: string, kb_id: string, kb_version: string, term: string, score: double>"
ATTR = f"struct<uid: string, attr_class: string, label: string, value: string, value_type: string, norm: {NORM}, metadata: map<string, string>>"
ANN = (
    "doc_id string, uid string, parent_uid string, kind string, label string, text string, "
    f"spans array<{SPAN}>, n_start int, n_end int, keys array<string>, metadata map<string, string>, seq long, attrs array<{ATTR}>"
)
RELATION = "doc_id string, uid string, label string, source_id string, target_id string, metadata map<string, string>, seq long"
ATTRS = f"doc_id string, owner_id string, {ATTR[7:-1]}"
RAW_TEXT, RAW_AUDIO = "RAW_TEXT", "RAW_AUDIO"


def make_uid(*parts: object) -> str:
    """An id that depends on its parts alone, so that a task that runs again gives the same rows."""
    return hashlib.sha256("\0".join(map(str, parts)).encode()).hexdigest()[:32]


def uid_column(*parts: Column | str) -> Column:
    """The same id as make_uid as a column."""
    joined = F.concat_ws("\0", *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.substring(F.sha2(joined, 256), 1, 32)


def op_id(name: str, config: dict) -> str:
    return make_uid(name, json.dumps(config, sort_keys=True, default=str, ensure_ascii=False))


def raw_segments(docs: DataFrame, label: str = RAW_TEXT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One segment per document over its whole text; a projection, nothing is stored."""
    key, body = F.col(doc_id).cast("string"), F.coalesce(F.col(text), F.lit(""))
    span = F.struct(F.lit(0).alias("start"), F.length(body).alias("end"), F.lit(None).cast("int").alias("length"), F.lit(None).cast(f"array<{RANGE}>").alias("replaced"))
    return docs.select(
        key.alias("doc_id"), uid_column(label, key).alias("uid"), F.lit(None).cast("string").alias("parent_uid"), F.lit("segment").alias("kind"), F.lit(label).alias("label"), body.alias("text"),
        F.array(span).alias("spans"), F.lit(0).alias("n_start"), F.length(body).alias("n_end"), F.lit(None).cast("array<string>").alias("keys"), F.lit(None).cast("map<string, string>").alias("metadata"),
        F.lit(0).cast("long").alias("seq"), F.lit(None).cast(f"array<{ATTR}>").alias("attrs"),
    )


def attrs_of(anns: DataFrame) -> DataFrame:
    """The attribute rows of annotations."""
    return anns.select("doc_id", F.col("uid").alias("owner_id"), F.explode("attrs").alias("a")).select("doc_id", "owner_id", "a.*")


def attach_attrs(anns: DataFrame, attrs: DataFrame) -> DataFrame:
    """Annotations with further attribute rows (owner_id = uid) added to their own."""
    more = attrs.groupBy("owner_id").agg(F.array_sort(F.collect_list(F.struct("label", "uid", "attr_class", "value", "value_type", "norm"))).alias("more_"))
    joined = anns.join(more, anns["uid"] == more["owner_id"], "left")
    cast = F.transform("more_", lambda a: F.struct(a.uid.alias("uid"), a.attr_class.alias("attr_class"), a.label.alias("label"), a.value.alias("value"), a.value_type.alias("value_type"), a.norm.alias("norm"), F.lit(None).cast("map<string, string>").alias("metadata")))
    none = F.array().cast(f"array<{ATTR}>")
    return joined.select(*(anns[c] for c in anns.columns if c != "attrs"), F.concat(F.coalesce(anns["attrs"], none), F.coalesce(cast, none)).alias("attrs"))


def select_anns(anns: DataFrame, label: str | list[str] | None = None, key: str | None = None, kind: str | None = None) -> DataFrame:
    """Filters by label(s), key and kind; several labels come in the order of the list, then by seq."""
    if label is not None:
        labels = [label] if isinstance(label, str) else list(label)
        anns = anns.where(F.col("label").isin(labels))
        if len(labels) > 1:
            anns = anns.orderBy("doc_id", F.array_position(F.lit(labels), F.col("label")), "seq")
    if key is not None:
        anns = anns.where(F.array_contains("keys", key))
    return anns.where(F.col("kind") == kind) if kind else anns


def by_id(anns: DataFrame, uid: str) -> DataFrame:
    return anns.where(F.col("uid") == uid)


def get_norms(attrs: DataFrame) -> DataFrame:
    return attrs.where(F.col("norm").isNotNull())


def duplicate_uids(df: DataFrame) -> DataFrame:
    """uid, n of ids that occur more than once; empty for a sound table."""
    return df.groupBy("uid").agg(F.count("*").alias("n")).where("n > 1")


def snippet(docs_text: Column, start: Column, end: Column, max_extend: int) -> Column:
    """Text around a range: half of the extension before it, what is left after it, within the text."""
    before = F.greatest(start - F.lit(max_extend // 2), F.lit(0))
    after = F.least(end + F.lit(max_extend) - (start - before), F.length(docs_text))
    return F.substring(docs_text, before + 1, after - before)


def norm_value(norm: Column) -> Column:
    """kb_name:kb_id, else kb_id, else the term."""
    return F.coalesce(F.when(norm.kb_name.isNotNull() & norm.kb_id.isNotNull(), F.concat_ws(":", norm.kb_name, norm.kb_id)), norm.kb_id, norm.term)


def collect_modalities(*docs: DataFrame) -> DataFrame:
    """All documents of a collection, whatever their modality."""
    first, *rest = docs
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
