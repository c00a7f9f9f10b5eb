"""Model-backed operations behind one interface: load() once per worker, then batches of texts.

The engine never imports a model library.  `load` is any function that returns a callable;
it runs on the executors, so what it needs must be installed there.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import spans as S
from marginalia.functions.text import capitalized
from marginalia.operators.kernel import Found, Rows, Segment, arrow_schema, attribute, pieces
from marginalia.operators.matching import link_embeddings
from marginalia.plans.tables import written
from marginalia.schema import ANN, attach_attrs, op_id, uid_column


class ModelOperation:
    """load() gives predict(texts) -> for each text its findings (Found); texts go in batches."""

    def __init__(self, name: str, config: dict, load: Callable[[], Callable[[list[str]], list[Iterable[Found]]]], batch_size: int = 16, attrs_to_copy: Iterable[str] = ()):
        self.name, self.load, self.batch_size, self.copied = name, load, batch_size, frozenset(attrs_to_copy)
        self.op_id = op_id(name, config)

    def run(self, segments: DataFrame) -> DataFrame:
        load, size, out = self.load, self.batch_size, Rows(self.op_id, self.copied)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            predict = load()
            for batch in pieces(batches):
                rows = batch.to_pylist()
                for i in range(0, len(rows), size):
                    part = rows[i : i + size]
                    for r, found in zip(part, predict([r["text"] for r in part])):
                        seg = Segment.of(r)
                        out.add(seg, (f(seg) if callable(f) else f for f in found))
                yield out.batch()

        return segments.select("doc_id", "uid", "label", "text", "spans", "attrs").mapInArrow(run, ANN)


class ModelEntityMatcher(ModelOperation):
    """Entities of a token classifier: classify(texts) gives (label, start, end, score) per text."""

    def __init__(self, load, batch_size: int = 16, attrs_to_copy=()):
        def ready():
            classify = load()
            return lambda texts: [[Found(label, (a, b), kind="entity", attrs=[attribute("confidence", float(score))]) for label, a, b, score in found] for found in classify(texts)]

        super().__init__("ModelEntityMatcher", {}, ready, batch_size, attrs_to_copy)


class Translator(ModelOperation):
    """Translations whose spans lead back: translate(texts) gives (text, [((start, end), [(start, end), …]), …]).

    Each pair aligns a stretch of the translation with stretches of the source; what isn't
    aligned stands for nothing in the document.
    """

    def __init__(self, load, output_label="translation", batch_size: int = 16, attrs_to_copy=()):
        def place(text: str, pairs: list) -> Callable[[Segment], Found]:
            def found(seg: Segment) -> Found:
                spans, at = [], 0
                for (a, b), sources in sorted(pairs):
                    if a > at:
                        spans.append(S.Mod(a - at))
                    spans.append(S.Mod(b - a, tuple(S.normalize([x for s, e in sources for x in S.cut(seg.spans, s, e)]))))
                    at = b
                if at < len(text):
                    spans.append(S.Mod(len(text) - at))
                return Found(output_label, text=text, spans=spans)

            return found

        def ready():
            translate = load()
            return lambda texts: [[place(t, pairs)] for t, pairs in translate(texts)]

        super().__init__("Translator", {"label": output_label}, ready, batch_size, attrs_to_copy)


def align_words(forward: np.ndarray, backward: np.ndarray, threshold: float = 1e-3) -> list[tuple[int, int]]:
    """Pairs (source, target) of words that both soft-max directions of a similarity matrix support."""
    soft = lambda x, axis: np.exp(x - x.max(axis, keepdims=True)) / np.exp(x - x.max(axis, keepdims=True)).sum(axis, keepdims=True)
    both = (soft(forward, 1) > threshold) & (soft(backward, 0) > threshold)
    return [tuple(map(int, p)) for p in np.argwhere(both)]


class ServiceMatcher(ModelOperation):
    """Entities of a service that takes one text per request and answers (body, start, end, dim, value) objects."""

    def __init__(self, output_label: str, url: str, locale: str = "fr_FR", dims: Iterable[str] | None = None, version: str = "", timeout: float = 30, send: Callable[[str, dict], list[dict]] | None = None, attrs_to_copy=()):
        dims = list(dims) if dims is not None else None

        def post(text: str, about: dict) -> list[dict]:
            data = urllib.parse.urlencode({"text": text, **about}).encode()
            with urllib.request.urlopen(urllib.request.Request(url, data), timeout=timeout) as answer:
                return json.load(answer)

        def ready():
            ask = send or post
            about = {"locale": locale} | ({"dims": json.dumps(dims)} if dims is not None else {})

            def one(text: str) -> list[Found]:
                hits = [h for h in ask(text, about) if dims is None or h["dim"] in dims]
                return [Found(output_label, (h["start"], h["end"]), kind="entity", attrs=[attribute(h["dim"], json.dumps(h["value"], ensure_ascii=False, sort_keys=True), metadata={"version": version})]) for h in hits]

            return lambda texts: [one(t) for t in texts]

        super().__init__("ServiceMatcher", {"label": output_label, "url": url, "dims": dims, "version": version}, ready, 1, attrs_to_copy)


class ParserPipeline(ModelOperation):
    """A language pipeline as an operation: parse(texts) gives objects that `convert` turns into findings.

    Findings that overlap others can be left out (`no_overlap`), as document objects of such
    pipelines can't hold them; spans in pieces are widened to their hull.
    """

    def __init__(self, load, convert: Callable[[object], Iterable[tuple[str, int, int, dict]]], no_overlap: bool = False, kind: str = "entity", batch_size: int = 64, attrs_to_copy=()):
        def ready():
            parse = load()

            def one(parsed) -> list[Found]:
                out, at = [], 0
                for label, a, b, attrs in sorted(convert(parsed), key=lambda x: (x[1], -x[2], x[0])):
                    if no_overlap and a < at:
                        continue
                    at = max(at, b)
                    out.append(Found(label, (a, b), kind=kind, attrs=[attribute(k, v) for k, v in attrs.items()]))
                return out

            return lambda texts: [one(p) for p in parse(texts)]

        super().__init__("ParserPipeline", {"kind": kind, "no_overlap": no_overlap}, ready, batch_size, attrs_to_copy)


def hulls(anns: DataFrame) -> DataFrame:
    """doc_id, uid, label, n_start, n_end in order, for pipelines whose spans are in one piece."""
    return anns.where("n_start IS NOT NULL").select("doc_id", "uid", "label", "n_start", "n_end")


def embed(rows: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], uid: str = "uid", text: str = "text", batch_size: int = 128, normalize: bool = True) -> DataFrame:
    """uid, embedding of texts by a model that is loaded once per worker."""
    kind = rows.schema[uid].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i in range(0, len(texts), batch_size):
                x = np.asarray(model(texts[i : i + batch_size]), np.float64)
                if normalize:
                    norm = np.sqrt((x * x).sum(1, keepdims=True))
                    x = x / np.where(norm > 0, norm, 1)
                flat = pa.array(x.astype(np.float32).ravel())
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, batch_size), pa.ListArray.from_arrays(offsets, flat)], ["uid", "embedding"])

    return rows.select(F.col(uid).alias("uid"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, f"uid {kind}, embedding array<float>")


class EmbeddingNormaliser:
    """Entities with the terms that are nearest to them as normalisations.

    Distinct texts of entities and terms are embedded by one model, linked by cosine, and the
    `top` terms (of at least `threshold`) of a text are attached to every entity that has it.
    """

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]], top: int = 1, threshold: float | None = None, kb_name: str = "umls", kb_version: str | None = None, batch_size: int = 128):
        self.load, self.top, self.threshold, self.kb, self.batch_size = load, top, threshold, (kb_name, kb_version), batch_size
        self.op_id = op_id("EmbeddingNormaliser", {"top": top, "threshold": threshold, "kb": self.kb})

    def run(self, entities: DataFrame, terms: DataFrame) -> DataFrame:
        """`terms` has cui and term."""
        known = terms.select("cui", "term").where("term IS NOT NULL").distinct()
        texts = entities.where("text IS NOT NULL").select("text").distinct()
        vectors = [embed(rows, self.load, column, column, self.batch_size) for rows, column in ((texts, "text"), (known.select("term").distinct(), "term"))]
        links = link_embeddings(written(vectors[0], "text-vectors"), written(vectors[1], "term-vectors"), self.top, self.threshold, "uid", "uid")
        found = links.join(known, F.col("term_id") == F.col("term")).select(F.col("entity_id").alias("text"), "cui", "term", "score")
        name, version = (F.lit(x).cast("string") for x in self.kb)
        norm = F.struct(name.alias("kb_name"), F.col("cui").alias("kb_id"), version.alias("kb_version"), "term", F.col("score"))
        attrs = entities.select("uid", "text").join(found, "text").select(
            F.col("uid").alias("owner_id"), uid_column(F.lit(self.op_id), F.col("uid"), F.col("cui"), F.col("term")).alias("uid"), F.lit("EntityNorm").alias("attr_class"), F.lit("NORMALIZATION").alias("label"),
            F.concat_ws(":", name, "cui").alias("value"), F.lit("string").alias("value_type"), norm.alias("norm"),
        )
        return attach_attrs(entities, attrs)


def pool(states: np.ndarray, mask: np.ndarray, how: str = "cls") -> np.ndarray:
    """One vector per text of token states (texts, tokens, width): the first token's, or the mean of the unmasked ones."""
    if how == "cls":
        return states[:, 0]
    if how != "mean":
        raise ValueError(how)
    weight = mask[..., None].astype(float)
    return (states * weight).sum(1) / np.maximum(weight.sum(1), 1e-9)


def sentence_case(text):
    """A column with its first letter in upper and the rest in lower case, as transcribers write it."""
    return capitalized(text)
