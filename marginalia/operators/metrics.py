"""Agreement and evaluation: aggregates over label tables and over entity tables.

Every metric is a group aggregate with partial aggregation; nothing but the final figures
could be collected.  Tag sequences are only written out where tag accuracy is asked for.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_annotators(first: DataFrame, second: DataFrame, key: str = "doc_id", label: str = "label") -> DataFrame:
    """key, truth, predicted of the documents that both tables label; of several labels the lowest counts."""
    one = lambda df, name: df.where(F.col(label).isNotNull()).groupBy(key).agg(F.min(label).cast("string").alias(name))
    return one(first, "truth").join(one(second, "predicted"), key)


def _safe(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def _scores(df: DataFrame) -> DataFrame:
    p, r = _safe(F.col("tp"), F.col("predicted_n")), _safe(F.col("tp"), F.col("support"))
    return df.withColumn("precision", p).withColumn("recall", r).withColumn("f1", _safe(2 * p * r, p + r))


def class_counts(pairs: DataFrame) -> DataFrame:
    """label, tp, predicted_n, support of (truth, predicted) rows; each row is expanded to its one or two classes."""
    same = F.col("truth") == F.col("predicted")
    rows = pairs.select(
        F.explode(
            F.when(same, F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("tp"), F.lit(1).alias("p"), F.lit(1).alias("s")))).otherwise(
                F.array(F.struct(F.col("truth").alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("p"), F.lit(1).alias("s")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("tp"), F.lit(1).alias("p"), F.lit(0).alias("s")))
            )
        ).alias("x")
    ).select("x.*")
    return rows.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("p").alias("predicted_n"), F.sum("s").alias("support"))


def classification_report(pairs: DataFrame, average: str = "macro", by_label: bool = True) -> DataFrame:
    """label, precision, recall, f1, accuracy, support: a row for each class and one called 'overall'.

    `average` is 'macro' (classes count alike) or 'weighted' (by support).  A division by zero gives 0.
    """
    if average not in ("macro", "weighted"):
        raise ValueError(average)
    each = _scores(class_counts(pairs))
    weight = F.lit(1.0) if average == "macro" else F.col("support").cast("double")
    mean = lambda c: _safe(F.sum(F.col(c) * weight), F.sum(weight)).alias(c)
    overall = each.agg(mean("precision"), mean("recall"), mean("f1"), _safe(F.sum("tp"), F.sum("support")).alias("accuracy"), F.sum("support").alias("support"))
    rounded = [F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]
    rows = overall.select(F.lit("overall").alias("label"), *rounded, F.round("accuracy", 6).alias("accuracy"), "support")
    if by_label:
        rows = rows.unionByName(each.select("label", *rounded, F.lit(None).cast("double").alias("accuracy"), "support"))
    return rows


def cohen_kappa(pairs: DataFrame) -> DataFrame:
    """kappa and support of two raters; equal marginals on a single class give a null (0 / 0)."""
    each = class_counts(pairs)
    n = F.sum("support").cast("double")
    observed, chance = F.sum("tp") / n, F.sum(F.col("predicted_n").cast("double") * F.col("support")) / (n * n)
    return each.agg(F.round(F.lit(1.0) - (1 - observed) / F.nullif(1 - chance, F.lit(0.0)), 6).alias("kappa"), F.sum("support").alias("support"))


def krippendorff_alpha(ratings: DataFrame, unit: str = "unit", value: str = "value") -> DataFrame:
    """alpha (nominal, missing ratings allowed) and the number of pairable values of rows (unit, value).

    Units with one rating don't count.  With fewer than two different values alpha is null.
    """
    cells = ratings.where(F.col(value).isNotNull()).groupBy(F.col(unit).alias("unit"), F.col(value).cast("string").alias("value")).agg(F.count("*").alias("n"))
    per_unit = cells.withColumn("nu", F.sum("n").over(Window.partitionBy("unit"))).where("nu >= 2")
    # Of the ratings of a unit, those of one value disagree with nu - n others.
    totals = per_unit.groupBy("value").agg(F.sum("n").cast("double").alias("nc"), F.sum(F.col("n") * (F.col("nu") - F.col("n")) / (F.col("nu") - 1)).alias("d"))
    n, observed, same = F.sum("nc"), F.sum("d"), F.sum(F.col("nc") * F.col("nc"))
    expected = n * n - same
    alpha = 1 - (n - 1) * observed / F.nullif(expected, F.lit(0.0))
    return totals.agg(F.round(alpha, 6).alias("alpha"), n.cast("long").alias("n_values"), F.count("*").alias("n_labels"))


def annotator_ratings(tables: Iterable[DataFrame], key: str = "doc_id", label: str = "label") -> DataFrame:
    """Rows (unit, value) of several annotators' document tables, for krippendorff_alpha."""
    out = None
    for t in tables:
        rows = t.select(F.col(key).alias("unit"), F.col(label).cast("string").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


# Entities.


def label_ids(labels: Iterable[str], scheme: str = "bilou") -> dict[str, int]:
    """Ids of the tags of labels in the order of the names; 'O' is 0."""
    marks = {"bilou": "BILU", "iob2": "BI"}[scheme]
    tags = [f"{m}-{label}" for label in sorted(set(labels)) for m in marks]
    return {tag: i for i, tag in enumerate(["O", *tags])}


def entity_tags(length: int, label: str, scheme: str = "bilou") -> list[str]:
    """Tags of an entity of that many tokens."""
    if scheme == "iob2":
        return [f"B-{label}"] + [f"I-{label}"] * (length - 1)
    return [f"U-{label}"] if length == 1 else [f"B-{label}"] + [f"I-{label}"] * (length - 2) + [f"L-{label}"]


def align_tags(offsets: list[tuple[int, int] | None], tags: list[str], tag_ids: dict[str, int], map_subtokens: bool = True, skipped: int = -100) -> list[int]:
    """Ids of token tags from character tags: a token takes its first character's tag; without characters, or a continuation if those aren't mapped, `skipped`."""
    out = []
    end = None
    for piece in offsets:
        if piece is None or piece[0] == piece[1]:
            out.append(skipped)
            continue
        a, b = piece
        part = a == end and not map_subtokens
        out.append(skipped if part else tag_ids[tags[a]])
        end = b
    return out


def character_tags(entities: DataFrame, scheme: str = "bilou", key: str = "doc_id") -> DataFrame:
    """key, pos, tag of every character that an entity (n_start, n_end, label) covers; of overlaps the first in order stays."""
    first = Window.partitionBy(key, "pos").orderBy("n_start", F.desc("n_end"), "label")
    rows = entities.where("n_end > n_start").select(key, "n_start", "n_end", "label", F.explode(F.sequence("n_start", F.col("n_end") - 1)).alias("pos"))
    rows = rows.withColumn("r_", F.row_number().over(first)).where("r_ = 1")
    at_start, at_end = F.col("pos") == F.col("n_start"), F.col("pos") == F.col("n_end") - 1
    mark = F.when(at_start, "B").otherwise("I")
    if scheme == "bilou":
        mark = F.when(at_start & at_end, "U").when(at_start, "B").when(at_end, "L").otherwise("I")
    return rows.select(key, "pos", F.concat_ws("-", mark, "label").alias("tag"))


def chunks_of_tags(tags: DataFrame, key: str = "doc_id") -> DataFrame:
    """Entities that tags describe: runs of one label that begin at B or U, after a gap, or after L or U (gaps and islands)."""
    order = Window.partitionBy(key).orderBy("pos")
    mark, label = F.substring("tag", 1, 1), F.substr("tag", F.lit(3))
    rows = tags.where("tag <> 'O'").withColumn("mark", mark).withColumn("label", label)
    before = lambda c: F.lag(c).over(order)
    new = before("pos").isNull() | (before("pos") != F.col("pos") - 1) | (before("label") != F.col("label")) | F.col("mark").isin("B", "U") | before("mark").isin("L", "U")
    rows = rows.withColumn("chunk", F.sum(new.cast("int")).over(order))
    return rows.groupBy(key, "chunk").agg(F.min("pos").alias("n_start"), (F.max("pos") + 1).alias("n_end"), F.first("label").alias("label")).drop("chunk")


def entity_scores(truth: DataFrame, predicted: DataFrame, average: str = "macro", by_label: bool = True, key: str = "doc_id") -> DataFrame:
    """label, precision, recall, f1, support over exact (document, start, end, label) matches, with an 'overall' row.

    Repeated entities of one place and label count once.
    """
    cols = [key, "n_start", "n_end", "label"]
    both = truth.select(*cols).distinct().withColumn("t", F.lit(1)).join(predicted.select(*cols).distinct().withColumn("p", F.lit(1)), cols, "full_outer")
    each = both.groupBy("label").agg(F.count(F.when(F.col("t").isNotNull() & F.col("p").isNotNull(), 1)).alias("tp"), F.count("p").alias("predicted_n"), F.count("t").alias("support"))
    each = _scores(each)
    if average == "micro":
        overall = _scores(each.agg(F.sum("tp").alias("tp"), F.sum("predicted_n").alias("predicted_n"), F.sum("support").alias("support")))
    else:
        weight = F.lit(1.0) if average == "macro" else F.col("support").cast("double")
        mean = lambda c: _safe(F.sum(F.col(c) * weight), F.sum(weight)).alias(c)
        overall = each.agg(mean("precision"), mean("recall"), mean("f1"), F.sum("support").alias("support"))
    rounded = [F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]
    rows = overall.select(F.lit("overall").alias("label"), *rounded, "support")
    return rows.unionByName(each.select("label", *rounded, "support")) if by_label else rows


def tag_accuracy(lengths: DataFrame, truth: DataFrame, predicted: DataFrame, scheme: str = "bilou", key: str = "doc_id", length: str = "length") -> DataFrame:
    """accuracy over all characters of the documents (key, length); a character that neither table tags agrees."""
    t = character_tags(truth, scheme, key).withColumnRenamed("tag", "t_tag")
    p = character_tags(predicted, scheme, key).withColumnRenamed("tag", "p_tag")
    differ = t.join(p, [key, "pos"], "full_outer").where(~F.col("t_tag").eqNullSafe(F.col("p_tag"))).agg(F.count("*").alias("wrong"))
    total = lengths.agg(F.sum(length).alias("total"))
    return total.crossJoin(differ).select(F.round(1 - _safe(F.col("wrong"), F.col("total")), 6).alias("accuracy"), F.col("total").cast("long").alias("n_tags"))


def tags_of_logits(predictions: DataFrame, labels: list[str], ignored: int = -100, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Tag tables (key, pos, tag) of the truth and of the best logit, from rows (key, pos, logits, label_id); masked tokens go."""
    names = F.array(*map(F.lit, labels))
    rows = predictions.where(F.col("label_id") != ignored)
    best = (F.array_position("logits", F.array_max("logits"))).cast("int")
    return (
        rows.select(key, "pos", F.element_at(names, (F.col("label_id") + 1).cast("int")).alias("tag")),
        rows.select(key, "pos", F.element_at(names, best).alias("tag")),
    )


def top_values(rows: DataFrame, group: str, value: str, top: int = 50, order: str | None = None) -> DataFrame:
    """group, value, n: the most frequent values of each group; of equal counts the first seen (by `order`, else by value)."""
    seen = F.min(order if order else value).alias("first_")
    counted = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"), seen)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "first_", value))
    return counted.withColumn("r_", rank).where(F.col("r_") <= top).select(group, value, "n")
