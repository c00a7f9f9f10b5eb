"""Provenance as an edge table: (item_uid, op_id, source_uid, scope).

Every annotation row holds the id of what it was made from, so the edges are a projection of
the rows.  Nested pipelines give edges of a deeper scope.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.plans.tables import written

EDGE = "item_uid string, op_id string, source_uid string, kind string"


@dataclass
class Edges:
    """Edges of one step, with those of the steps within it."""

    op_id: str
    rows: DataFrame
    inner: list["Edges"] = field(default_factory=list)


def edges_of(anns: DataFrame, op: str) -> DataFrame:
    """Edges of annotations to what they were made from, and of attributes to their annotation."""
    edge = lambda item, source, kind: F.struct(item.alias("item_uid"), source.alias("source_uid"), F.lit(kind).alias("kind"))
    found = F.array(edge(F.col("uid"), F.col("parent_uid"), "annotation"))
    if "attrs" in anns.columns:  # of the same pass over the rows: a union would have the operations run again
        found = F.concat(found, F.coalesce(F.transform("attrs", lambda a: edge(a.uid, F.col("uid"), "attribute")), F.array().cast("array<struct<item_uid: string, source_uid: string, kind: string>>")))
    return anns.select(F.explode(found).alias("e")).select("e.item_uid", F.lit(op).alias("op_id"), "e.source_uid", "e.kind")


def edge_table(steps: list[Edges], scope: int = 0) -> DataFrame | None:
    """All edges with the depth of their pipeline."""
    out = None
    for s in steps:
        parts = [s.rows.withColumn("scope", F.lit(scope))]
        if (inner := edge_table(s.inner, scope + 1)) is not None:
            parts.append(inner)
        for p in parts:
            out = p if out is None else out.unionByName(p)
    return out


def derived(edges: DataFrame) -> DataFrame:
    """item_uid, derived: what was made from each item."""
    return edges.where("source_uid IS NOT NULL").groupBy(F.col("source_uid").alias("item_uid")).agg(F.array_sort(F.collect_set("item_uid")).alias("derived"))


def nodes(edges: DataFrame) -> DataFrame:
    """item_uid, op_id, sources, derived of every item, those that are only sources included (op_id null)."""
    made = edges.groupBy("item_uid").agg(F.min("op_id").alias("op_id"), F.array_sort(F.collect_set("source_uid")).alias("sources"))
    only = edges.where("source_uid IS NOT NULL").select(F.col("source_uid").alias("item_uid")).distinct().join(made.select("item_uid"), "item_uid", "left_anti")
    none = F.array().cast("array<string>")
    every = made.unionByName(only.select("item_uid", F.lit(None).cast("string").alias("op_id"), none.alias("sources")))
    return every.join(derived(edges), "item_uid", "left").withColumn("derived", F.coalesce("derived", none))


#: Items up to which those that others come from are broadcast rather than shuffled.
MAX_SOURCES = 500_000


def roots(edges: DataFrame, depth: int) -> DataFrame:
    """item_uid, root_uid: the items without an origin that each item comes from.

    `depth` is the number of steps of the plan, which bounds every path: so many self-joins,
    no recursion.  The edges are written once, as every hop reads them.  Hops are joined among
    the items that others come from, which are few beside all; the edges meet their result once.
    """
    step = written(edges.where("source_uid IS NOT NULL").select("item_uid", "source_uid"), "edges")
    if depth <= 1:
        return step.distinct().withColumnRenamed("source_uid", "root_uid")
    sources = written(step.select(F.col("source_uid").alias("node")).distinct(), "sources")
    sent = F.broadcast if sources.count() <= MAX_SOURCES else lambda df: df
    hop = written(step.join(sent(sources), F.col("item_uid") == F.col("node"), "left_semi").select(F.col("item_uid").alias("at"), F.col("source_uid").alias("next")).distinct(), "hops")
    up = sources.withColumn("root_uid", F.col("node"))
    for _ in range(depth - 1):
        up = up.join(hop, F.col("root_uid") == F.col("at"), "left").select("node", F.coalesce("next", "root_uid").alias("root_uid")).distinct()
    return step.join(sent(written(up, "roots")), F.col("source_uid") == F.col("node")).select("item_uid", "root_uid").distinct()


def flattened(edges: DataFrame, outer: DataFrame, depth: int) -> DataFrame:
    """Edges of a composite operation: its outputs (rows of `outer`, item_uid and op_id) to what they come from in the end."""
    return outer.select("item_uid", "op_id").distinct().join(roots(edges, depth), "item_uid", "left").select("item_uid", "op_id", F.col("root_uid").alias("source_uid"))


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both edge tables; of an item that both have, the right one's edges count."""
    return left.join(right.select("item_uid").distinct(), "item_uid", "left_anti").unionByName(right)


def faults(edges: DataFrame) -> DataFrame:
    """item_uid, fault: items made by two operations, and items that are their own source."""
    twice = edges.groupBy("item_uid").agg(F.countDistinct("op_id").alias("n")).where("n > 1").select("item_uid", F.lit("made twice").alias("fault"))
    return twice.unionByName(edges.where("item_uid = source_uid").select("item_uid", F.lit("own source").alias("fault")).distinct())


def to_dot(edges: DataFrame, names: dict[str, str] | None = None, items: DataFrame | None = None, max_depth: int | None = None, show_attrs: bool = True) -> str:
    """Graphviz text of an edge table that is meant to be looked at; it is brought to the driver.

    `names` has names of operations by id; `items` (uid, text) captions; deeper scopes than
    `max_depth` and, if not asked for, attributes are left out.
    """
    shown = edges if max_depth is None or "scope" not in edges.columns else edges.where(F.col("scope") <= max_depth)
    if not show_attrs:
        shown = shown.where("kind <> 'attribute'")
    rows = sorted({(r["source_uid"], r["item_uid"], r["op_id"], r["kind"]) for r in shown.collect()}, key=str)
    captions = {r[0]: r[1] for r in items.select("uid", "text").collect()} if items is not None else {}
    quote = lambda s: '"' + str(s).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    seen = sorted({u for s, i, _, _ in rows for u in (s, i) if u})
    lines = [f"  {quote(u)} [label={quote(captions.get(u, u))}];" for u in seen]
    for source, item, op, kind in rows:
        if source:
            style = ", style=dashed" if kind == "attribute" else ""
            lines.append(f"  {quote(source)} -> {quote(item)} [label={quote((names or {}).get(op, op))}{style}];")
    return "\n".join(["digraph provenance {", *lines, "}", ""])
