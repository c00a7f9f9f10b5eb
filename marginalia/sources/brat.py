"""Stand-off annotation files (.txt beside .ann): reading, writing, and the configuration of the tool."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import spans as S
from marginalia.functions.text import strip_range
from marginalia.operators.kernel import arrow_schema, attribute, norm_attribute
from marginalia.operators.metrics import top_values
from marginalia.schema import ANN, RELATION, make_uid

_CUI = re.compile(r"\bC\d{7}\b")


def read_pairs(spark: SparkSession, folder: str, ann_ext: str = ".ann", text_ext: str = ".txt") -> DataFrame:
    """stem, text, ann of all files; either side may be missing."""
    def side(ext: str, name: str) -> DataFrame:
        rows = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ext}").load(folder)
        stem = F.regexp_replace("path", ext.replace(".", r"\.") + "$", "")
        return rows.select(stem.alias("stem"), F.decode("content", "UTF-8").alias(name))

    return side(text_ext, "text").join(side(ann_ext, "ann"), "stem", "full_outer")


def parse_lines(ann: str) -> tuple[dict, dict, dict, list]:
    """Entities, relations, attributes by id, and notes; lines of other kinds are left out."""
    entities, relations, attrs, notes = {}, {}, {}, []
    for line in (ann or "").split("\n"):
        key, _, rest = line.partition("\t")
        if not rest or not key:
            continue
        if key[0] == "T":
            head, _, text = rest.partition("\t")
            label, _, places = head.partition(" ")
            entities[key] = label, [tuple(map(int, p.split())) for p in places.split(";")], text
        elif key[0] == "R":
            label, first, second = rest.split()[:3]
            relations[key] = label, first.partition(":")[2], second.partition(":")[2]
        elif key[0] == "A":
            parts = rest.split(None, 2)
            attrs[key] = parts[0], parts[1], parts[2] if len(parts) > 2 else None
        elif key[0] == "#":
            head, _, note = rest.partition("\t")
            notes.append((head.split()[-1], note))
    return entities, relations, attrs, notes


def load(spark: SparkSession, folder: str, detect_cuis_in_notes: bool = True, notes_label: str = "brat_note", ann_ext: str = ".ann", text_ext: str = ".txt") -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs, anns, relations of a folder. Fragments of an entity are joined by a blank that stands for nothing in the text."""
    pairs = read_pairs(spark, folder, ann_ext, text_ext)
    docs = pairs.select(F.substring(F.sha2(F.concat_ws("\0", F.lit("brat"), F.col("stem")), 256), 1, 32).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.create_map(F.lit("path_to_text"), F.concat("stem", F.lit(text_ext))).alias("metadata"))
    schema, rel_schema = arrow_schema(ANN), arrow_schema(RELATION)

    def parse(stem: str, text: str, ann: str) -> tuple[list[dict], list[dict]]:
        doc = make_uid("brat", stem)
        entities, relations, attrs, notes = parse_lines(ann)
        uid = lambda k: make_uid("brat", doc, k)
        own: dict[str, list[dict]] = {}
        for k, (label, target, value) in attrs.items():
            own.setdefault(target, []).append(attribute(label, True if value is None else value) | {"uid": uid(k)})
        for n, (target, note) in enumerate(notes):
            cuis = _CUI.findall(note) if detect_cuis_in_notes else []
            new = [norm_attribute(kb_name="umls", kb_id=c) for c in dict.fromkeys(cuis)] or [attribute(notes_label, note)]
            own.setdefault(target, []).extend(a | {"uid": make_uid("brat-note", doc, n, k)} for k, a in enumerate(new))
        rows = []
        for seq, (k, (label, places, shown)) in enumerate(entities.items()):
            spans: list = []
            for a, b in places:
                spans += [S.Mod(1), S.Span(a, b)] if spans else [S.Span(a, b)]
            body = " ".join(text[a:b] for a, b in places) if text else shown
            rows.append({"doc_id": doc, "uid": uid(k), "parent_uid": None, "kind": "entity", "label": label, "text": body, "spans": S.to_rows(spans), "n_start": min(p[0] for p in places), "n_end": max(p[1] for p in places), "keys": None, "metadata": {"brat_id": k}, "seq": seq, "attrs": own.get(k)})
        links = []
        for seq, (k, (label, a, b)) in enumerate(relations.items()):
            if a not in entities or b not in entities:
                raise KeyError(f"{stem}: {k} has an end that isn't there")
            links.append({"doc_id": doc, "uid": uid(k), "label": label, "source_id": uid(a), "target_id": uid(b), "metadata": {"brat_id": k}, "seq": seq})
        return rows, links

    def part(which: int, to: pa.Schema):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [x for r in batch.to_pylist() for x in parse(r["stem"], r["text"], r["ann"])[which]]
                yield pa.RecordBatch.from_pylist(rows, to)

        return run

    with_anns = pairs.where("ann IS NOT NULL").select("stem", "text", "ann")
    return docs, with_anns.mapInArrow(part(0, schema), ANN), with_anns.mapInArrow(part(1, rel_schema), RELATION)


def grouped_entities(anns: DataFrame, relations: DataFrame, group_types: Iterable[str] = ("And-Group", "Or-Group")) -> DataFrame:
    """group_uid, group_type, members: entities of a grouping type with what their relations lead to."""
    groups = anns.where(F.col("label").isin(list(group_types))).select(F.col("uid").alias("source_id"), F.col("label").alias("group_type"))
    return groups.join(relations, "source_id").groupBy(F.col("source_id").alias("group_uid"), "group_type").agg(F.array_sort(F.collect_set("target_id")).alias("members"))


def augmented_entities(anns: DataFrame, relations: DataFrame) -> DataFrame:
    """uid, label, text, relations_from, relations_to, attributes of each entity, by equi joins."""
    side = lambda own, other, name: relations.groupBy(F.col(own).alias("uid")).agg(F.array_sort(F.collect_list(F.struct("label", F.col(other).alias("other")))).alias(name))
    attrs = F.transform(F.coalesce("attrs", F.array()), lambda a: F.struct(a.label.alias("label"), a.value.alias("value"))).alias("attributes")
    out = anns.where("kind = 'entity'").select("doc_id", "uid", "label", "text", attrs)
    return out.join(side("source_id", "target_id", "relations_from"), "uid", "left").join(side("target_id", "source_id", "relations_to"), "uid", "left")


def line_fragments(text: str, spans: list[S.Span]) -> list[tuple[int, int]]:
    """Ranges of an entity without line ends: a range over several lines becomes one per line, stripped."""
    out = []
    for s in spans:
        at = s.start
        for line in text[s.start : s.end].split("\n"):
            a, b = strip_range(text, at, at + len(line))
            if a < b:
                out.append((a, b))
            at += len(line) + 1
    return out


def brat_value(value: str | None, value_type: str) -> str | None:
    """How the value of an attribute is written; None: the attribute isn't (a false flag)."""
    if value_type == "bool":
        return "" if value == "true" else None
    return value or ""


def document_lines(text: str, anns: list[dict], relations: list[dict], labels: set[str] | None = None, attr_names: set[str] | None = None, ignore_segments: bool = True, notes_label: str = "brat_note", cuis_to_notes: bool = True) -> list[str]:
    """The .ann lines of one document; relations with a missing end are left out."""
    out, number, names = [], Counter(), {}
    for a in anns:
        if (labels is not None and a["label"] not in labels) or (ignore_segments and a["kind"] != "entity"):
            continue
        places = line_fragments(text, S.normalize(S.from_rows(a["spans"])))
        if not places:
            continue
        number["T"] += 1
        key = names[a["uid"]] = f"T{number['T']}"
        out.append(f"{key}\t{a['label'].replace(' ', '_')} {';'.join(f'{s} {e}' for s, e in places)}\t{' '.join(text[s:e] for s, e in places)}")
        cuis, done = [], set()
        for x in a["attrs"] or ():
            norm = x["norm"]
            if cuis_to_notes and norm and norm["kb_name"] == "umls" and norm["kb_id"]:
                cuis.append(norm["kb_id"])
            elif x["label"] == notes_label:
                number["#"] += 1
                out.append(f"#{number['#']}\tAnnotatorNotes {key}\t{x['value'] or ''}")
            elif attr_names is None or x["label"] in attr_names:
                value = brat_value(x["value"], x["value_type"])
                line = f"{x['label'].replace(' ', '_')} {key} {value or ''}".rstrip()
                if value is not None and line not in done:
                    done.add(line)
                    number["A"] += 1
                    out.append(f"A{number['A']}\t{line}")
        if cuis:
            number["#"] += 1
            out.append(f"#{number['#']}\tAnnotatorNotes {key}\t{' '.join(dict.fromkeys(cuis))}")
    for r in relations:
        if r["source_id"] in names and r["target_id"] in names and (labels is None or r["label"] in labels):
            number["R"] += 1
            out.append(f"R{number['R']}\t{r['label'].replace(' ', '_')} Arg1:{names[r['source_id']]} Arg2:{names[r['target_id']]}")
    return out


def render(docs: DataFrame, anns: DataFrame, relations: DataFrame | None = None, **settings) -> DataFrame:
    """doc_id, text, ann: the content of both files of each document."""
    keep = ["uid", "kind", "label", "spans", "attrs"]
    packed = anns.groupBy("doc_id").agg(F.collect_list(F.struct("seq", *keep)).alias("anns"))
    both = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").join(packed, "doc_id", "left")
    if relations is None:
        both = both.withColumn("rels", F.lit(None).cast("array<struct<seq: bigint, uid: string, label: string, source_id: string, target_id: string>>"))
    else:
        both = both.join(relations.groupBy("doc_id").agg(F.collect_list(F.struct("seq", "uid", "label", "source_id", "target_id")).alias("rels")), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = lambda rows: sorted(rows or [], key=lambda r: (r["seq"] or 0, r["uid"]))
        for batch in batches:
            rows = batch.to_pylist()
            shown = ["".join(f"{x}\n" for x in document_lines(r["text"] or "", order(r["anns"]), order(r["rels"]), **settings)) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shown, pa.string())], ["doc_id", "text", "ann"])

    return both.mapInArrow(run, "doc_id string, text string, ann string")


def save(docs: DataFrame, anns: DataFrame, folder: str, relations: DataFrame | None = None, create_config: bool = True, top_values_by_attr: int = 50, **settings) -> None:
    """Both files of every document into a folder that executors and driver share; with annotation.conf."""
    Path(folder).mkdir(parents=True, exist_ok=True)

    def write(rows: Iterable) -> None:
        for r in rows:
            Path(folder, f"{r['doc_id']}.txt").write_text(r["text"] or "")
            Path(folder, f"{r['doc_id']}.ann").write_text(r["ann"])

    render(docs, anns, relations, **settings).foreachPartition(write)
    if create_config:
        Path(folder, "annotation.conf").write_text(configuration(anns, relations, top_values_by_attr))


def configuration(anns: DataFrame, relations: DataFrame | None = None, top: int = 50) -> str:
    """annotation.conf: entity types, relations with the types of their ends, attributes with their most frequent values."""
    entities = anns.where("kind = 'entity'")
    types = sorted(r[0].replace(" ", "_") for r in entities.select("label").distinct().collect())
    any_ = "<ENTITY>"
    lines = ["[entities]", "", *types, "", "[relations]", "", f"<OVERLAP>\tArg1:{any_}, Arg2:{any_}, <OVL-TYPE>:<ANY>"]
    if relations is not None:
        label = lambda name: entities.select(F.col("uid").alias(name), F.col("label").alias(name + "_l"))
        ends = relations.join(label("source_id"), "source_id").join(label("target_id"), "target_id")
        found = ends.groupBy("label").agg(F.array_sort(F.collect_set("source_id_l")).alias("a"), F.array_sort(F.collect_set("target_id_l")).alias("b")).orderBy("label")
        lines += [f"{r['label']}\tArg1:{'|'.join(r['a'])}, Arg2:{'|'.join(r['b'])}" for r in found.collect()]
    lines += ["", "[attributes]", ""]
    attrs = entities.select(F.explode("attrs").alias("a"), "seq").select("a.label", "a.value", "a.value_type", "seq").where("value_type <> 'bool' OR value = 'true'")
    values = top_values(attrs.where("value_type <> 'bool'"), "label", "value", top, "seq")
    listed = {r["label"]: sorted(r["v"]) for r in values.groupBy("label").agg(F.collect_list("value").alias("v")).collect()}
    for r in attrs.select("label").distinct().orderBy("label").collect():
        shown = f", Value:{'|'.join(listed[r[0]])}" if r[0] in listed else ""
        lines.append(f"{r[0].replace(' ', '_')}\tArg:<ENTITY>{shown}")
    return "\n".join([*lines, "", "[events]", "", ""])


def entity_lines(entities: DataFrame) -> DataFrame:
    """doc_id, line: entity lines of plain entities (one span each), numbered in the JVM."""
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("n_start", "n_end", "label"))
    return entities.select("doc_id", F.concat(F.lit("T"), at.cast("string"), F.lit("\t"), F.col("label"), F.lit(" "), F.col("n_start").cast("string"), F.lit(" "), F.col("n_end").cast("string"), F.lit("\t"), F.col("text")).alias("line"))
