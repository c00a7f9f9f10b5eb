"""Interval joins between annotations, and the selection of annotations that don't overlap."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.schema import uid_column


def overlap_pairs(left: DataFrame, right: DataFrame, bin_size: int | None = None, key: str = "doc_id", start: str = "n_start", end: str = "n_end", uid: str = "uid") -> DataFrame:
    """key, left_uid, right_uid of rows of one document whose ranges overlap.

    The document is the equi key. For documents with very many spans `bin_size` cuts the ranges
    into bins that join equally, and a pair counts in the first bin that both have.
    """
    a = left.select(key, F.col(uid).alias("left_uid"), F.col(start).alias("ls"), F.col(end).alias("le")).where("ls IS NOT NULL")
    b = right.select(key, F.col(uid).alias("right_uid"), F.col(start).alias("rs"), F.col(end).alias("re")).where("rs IS NOT NULL")
    if bin_size is None:
        return a.join(b, key).where("ls < re AND le > rs").select(key, "left_uid", "right_uid", "ls", "le", "rs", "re")
    cut = lambda df, s, e: df.withColumn("bin", F.explode(F.sequence((F.col(s) / bin_size).cast("int"), (F.greatest(F.col(e) - 1, F.col(s)) / bin_size).cast("int"))))
    joined = cut(a, "ls", "le").join(cut(b, "rs", "re"), [key, "bin"]).where("ls < re AND le > rs")
    return joined.where(F.col("bin") == (F.greatest("ls", "rs") / bin_size).cast("int")).select(key, "left_uid", "right_uid", "ls", "le", "rs", "re")


def nested_segments(sources: DataFrame, targets: DataFrame, bin_size: int | None = None) -> DataFrame:
    """doc_id, uid, children of each source segment: the targets that overlap it, in order; none is an empty list."""
    pairs = overlap_pairs(sources, targets, bin_size)
    kids = pairs.groupBy("doc_id", F.col("left_uid").alias("uid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rs", "re", "right_uid"))), lambda s: s.right_uid).alias("children"))
    kept = sources.where(F.col("n_start").isNotNull()).select("doc_id", "uid")
    return kept.join(kids, ["doc_id", "uid"], "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))


def duplicate_attrs(sources: DataFrame, targets: DataFrame, labels: list[str]) -> DataFrame:
    """Attribute rows of sources again for every target that they overlap, with new ids and their origin."""
    attrs = sources.select(F.col("uid").alias("left_uid"), F.explode("attrs").alias("a")).where(F.col("a.label").isin(labels))
    pairs = overlap_pairs(sources, targets).select("doc_id", "left_uid", "right_uid")
    return pairs.join(attrs, "left_uid").select(
        "doc_id", F.col("right_uid").alias("owner_id"), uid_column(F.lit("duplicate"), F.col("right_uid"), F.col("a.uid")).alias("uid"), F.col("a.uid").alias("source_uid"), "a.attr_class", "a.label", "a.value", "a.value_type", "a.norm"
    )


def keep_longest(anns: DataFrame, compat: bool = False) -> DataFrame:
    """Annotations of a document that don't overlap: the longest first, of equal ones the later.

    With `compat` an annotation that ends where a kept one starts is dropped too.
    """
    def run(table):
        a, b = (table.column(c).to_pylist() for c in ("n_start", "n_end"))
        order = sorted((i for i in range(len(a)) if a[i] is not None), key=lambda i: (b[i] - a[i], a[i]), reverse=True)
        starts: list[int] = []
        ends: list[int] = []
        keep = []
        for i in order:
            # What is kept is disjoint, so only the neighbours of a place can clash.
            at = bisect_right(starts, a[i])
            reach = b[i] + 1 if compat else b[i]
            if (at and ends[at - 1] > a[i]) or (at < len(starts) and starts[at] < reach):
                continue
            starts.insert(at, a[i])
            ends.insert(at, b[i])
            keep.append(i)
        return table.take(pa.array(sorted(keep, key=lambda i: a[i]), pa.int64()))

    return anns.groupBy("doc_id").applyInArrow(run, anns.schema)


def adjacent_pairs(entities: DataFrame, sentence: str = "parent_uid") -> DataFrame:
    """doc_id, source_id, target_id of entities that follow each other in a sentence."""
    order = Window.partitionBy("doc_id", sentence).orderBy("n_start", "n_end", "uid")
    return entities.withColumn("next_", F.lead("uid").over(order)).where("next_ IS NOT NULL").select("doc_id", F.col("uid").alias("source_id"), F.col("next_").alias("target_id"))


def relations_of(pairs: DataFrame, label: str) -> DataFrame:
    uid = uid_column(F.lit(label), F.col("source_id"), F.col("target_id"))
    return pairs.select("doc_id", uid.alias("uid"), F.lit(label).alias("label"), "source_id", "target_id")


def sound_relations(relations: DataFrame, anns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations whose two ends exist, and those with a missing end."""
    ends = anns.select("uid").distinct()
    good = relations.join(ends.withColumnRenamed("uid", "source_id"), "source_id", "left_semi").join(ends.withColumnRenamed("uid", "target_id"), "target_id", "left_semi")
    return good, relations.join(good.select("uid"), "uid", "left_anti")


class SyntacticRelationExtractor:
    """Relations between adjacent entities that a pluggable parser links.

    parse(text, spans) gives for every entity the index of the entity its head belongs to, or
    None. The target is the dependent; entities_source and entities_target fix the direction.
    """

    def __init__(self, parse, relation_label="relation", entities_source=(), entities_target=()):
        self.parse, self.label, self.sources, self.targets = parse, relation_label, frozenset(entities_source), frozenset(entities_target)

    def run(self, sentences: DataFrame, entities: DataFrame) -> DataFrame:
        grouped = entities.groupBy("parent_uid").agg(F.array_sort(F.collect_list(F.struct("n_start", "n_end", "uid", "label"))).alias("ents"))
        rows = sentences.select("doc_id", F.col("uid").alias("parent_uid"), "text", "n_start").join(grouped, "parent_uid").select("doc_id", "text", "n_start", "ents")
        parse, label, sources, targets = self.parse, self.label, self.sources, self.targets

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    ents = r["ents"]
                    heads = parse(r["text"], [(e["n_start"] - r["n_start"], e["n_end"] - r["n_start"]) for e in ents])
                    for i, h in enumerate(heads):
                        if h is None or abs(h - i) != 1:
                            continue
                        a, b = ents[h], ents[i]
                        if a["label"] in targets and b["label"] in sources:
                            a, b = b, a
                        if (not sources or a["label"] in sources) and (not targets or b["label"] in targets):
                            out.append({"doc_id": r["doc_id"], "source_id": a["uid"], "target_id": b["uid"]})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.string()), ("source_id", pa.string()), ("target_id", pa.string())]))

        return relations_of(rows.mapInArrow(run, "doc_id string, source_id string, target_id string"), label)
