"""Information-theoretic sanitisation of personal data.

Protected entities (e-mail addresses, telephone, card and account numbers, network
addresses, access keys, passwords, tokens) are found by their form and generalised to their
kind.  Other terms can still reveal them: for an entity e and a term t within WINDOW terms of
a mention, the corpus gives

    PMI(e; t) = log2 p(e, t) / (p(e) p(t))

and t discloses e when PMI(e; t) >= ALPHA * IC(e), IC(e) = -log2 p(e): t gives away at least
that part of what e says.  p counts documents with distinct text; p(t) counts SMOOTHING more
than have t, so that a term isn't taken for rare because the corpus is small.  Every entity's
terms are estimated, also those of an entity with one mention: there t discloses when at most
sqrt(N) - SMOOTHING of N documents have it.  In documents that mention e its disclosing terms
are generalised (digits to [NUMBER], capitalised words to [NAME]) or, other words, removed.

The three passes are: contexts of mentions (only documents with one), document frequency of
candidate terms (over all documents), and rewriting.

Defined results: a null text stays null, an empty one empty; texts without entities come
back byte for byte.  Repeated rows are counted once and rewritten alike.  Overlapping
patterns resolve to the leftmost, then to the order of PATTERNS.  A tie at the threshold
discloses.  Added columns whose name is taken get an underscore.  An empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import fresh, materialize, sliced

WINDOW, ALPHA, SMOOTHING = 8, 0.5, 7
#: Disclosing (entity, term) pairs up to which they travel with the kernel; beyond it they are joined by document.
MAX_PAIRS = 200_000

#: Kind and form of protected entities. Forms start with something rare, so that scanning stays cheap.
PATTERNS = (
    ("SECRET", r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b[\"']?\s*[:=]\s*)(?P<secret>\"[^\"\n]+\"|'[^'\n]+'|[^\s\"',;]+)"),
    ("EMAIL", r"(?<![\w.+%-])[\w.+%-]{1,64}@[\w-]+(?:\.[\w-]+)+"),
    ("KEY", r"\b(?:AKIA|ASIA)[0-9A-Z]{12,}\b|\b(?:sk|pk|gh[pousr])[-_][A-Za-z0-9_]{16,}\b"),
    ("ACCOUNT", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("PHONE", r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}\b|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}\b|(?<![\w.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])"),
    ("ADDRESS", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)"),
    ("SSN", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("CARD", r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])"),
)
ENTITY = re.compile("|".join(f"(?P<{kind}>{form})" for kind, form in PATTERNS))
#: Whether a text can hold an entity at all: one pass with cheap alternatives. Every match of PATTERNS has a hint in it.
HINT = re.compile(r"@|\d[\d -]\d|\d\.\d|\+\d|[A-Z]\d\d|AKIA|ASIA|[=:]|(?:sk|pk|gh[pousr])[-_]")
TERM = re.compile(r"[^\W_]+")


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """start, end, kind, value of the protected entities; of a secret only the value, not its name."""
    out = []
    for m in ENTITY.finditer(text):
        kind = "SECRET" if m.group("SECRET") is not None else m.lastgroup
        start, end = m.span("secret") if kind == "SECRET" else m.span()
        out.append((start, end, kind, text[start:end]))
    return out


def contexts(text: str, window: int = WINDOW) -> Iterator[tuple[str, str, list[str]]]:
    """Entity, context, terms of the context, for each mention in the text."""
    found = entities(text)
    if not found:
        return
    masked = list(text)
    for s, e, _, _ in found:
        masked[s:e] = " " * (e - s)
    plain = "".join(masked)
    terms = [(m.start(), m.group().lower()) for m in TERM.finditer(plain)]
    starts = np.array([s for s, _ in terms], np.int64)
    for s, _, kind, value in found:
        at = int(np.searchsorted(starts, s))
        near = [t for _, t in terms[max(0, at - window) : at + window]]
        yield f"{kind}:{value.lower()}", " ".join(near), near


def generalise(word: str) -> str:
    if any(c.isdigit() for c in word):
        return "[NUMBER]"
    return "[NAME]" if word[:1].isupper() else ""


def sanitise(text: str, disclosing: dict[str, list[str]] | None = None) -> tuple[str, int, int]:
    """The text with entities and their disclosing terms generalised, and how many there were of each."""
    if not text or not HINT.search(text):
        return text, 0, 0
    found = entities(text)
    if not found:
        return text, 0, 0
    bad = {t for _, _, kind, v in found for t in (disclosing or {}).get(f"{kind}:{v.lower()}", ())}
    return _rewrite(text, found, bad)


def _rewrite(text: str, found: list[tuple[int, int, str, str]], bad: set[str]) -> tuple[str, int, int]:
    hidden = 0

    def hide(m: re.Match) -> str:
        nonlocal hidden
        if m.group().lower() not in bad:
            return m.group()
        hidden += 1
        return generalise(m.group())

    parts, at = [], 0
    for s, e, kind, _ in found:
        piece = text[at:s]
        parts += [TERM.sub(hide, piece) if bad else piece, f"[{kind}]"]
        at = e
    parts.append(TERM.sub(hide, text[at:]) if bad else text[at:])
    return "".join(parts), len(found), hidden


def disclosing_terms(docs: DataFrame, window: int = WINDOW, alpha: float = ALPHA, smoothing: int = SMOOTHING, text: str = "text") -> DataFrame:
    """entity, term, pmi, ic of the terms that reveal an entity at or over the threshold."""
    source = docs.select(F.col(text).alias("text")).where("text IS NOT NULL")

    def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0):
            out = []
            for t in batch.column(0).to_pylist():
                if HINT.search(t):
                    doc = hash_text(t)
                    out += [(e, c, doc) for e, c, _ in contexts(t, window)]
            e, c, d = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.string()), pa.array(c, pa.string()), pa.array(d, pa.int64())], ["entity", "context", "doc"])

    found = materialize(source.mapInArrow(mentions, "entity string, context string, doc long"), "mentions")
    per_entity = found.groupBy("entity").agg(F.countDistinct("doc").alias("n_e"))
    pairs = (
        found.join(per_entity, "entity")
        .withColumn("term", F.explode(F.array_distinct(F.split("context", " "))))
        .where("term <> ''")
        .groupBy("entity", "n_e", "term")
        .agg(F.countDistinct("doc").alias("n_et"))
    )
    pairs = materialize(pairs, "pairs")
    if not pairs.limit(1).count():
        return pairs.select("entity", "term", F.lit(0.0).alias("pmi"), F.lit(0.0).alias("ic"))
    # Document frequency of the candidate terms over all documents with distinct text: each of m copies counts 1 / m.
    wanted = pairs.select("term").distinct()
    hashed = source.select(F.xxhash64("text").alias("h"))
    copies = materialize(hashed.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "copies")
    again = copies.agg(F.count("*"), F.sum("m")).collect()[0]
    total = hashed.count() - (again[1] or 0) + again[0]
    copies = F.broadcast(copies) if again[0] <= MAX_PAIRS else copies
    seen = source.withColumn("h", F.xxhash64("text")).join(copies, "h", "left")
    seen = seen.select((F.lit(1.0) / F.coalesce("m", F.lit(1))).alias("w"), F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("term"))
    wanted = F.broadcast(wanted) if wanted.limit(MAX_PAIRS + 1).count() <= MAX_PAIRS else wanted
    frequency = seen.join(wanted, "term", "left_semi").groupBy("term").agg(F.round(F.sum("w")).alias("n_t"))
    n = F.lit(float(max(total, 1)))
    scored = pairs.join(frequency, "term", "left").select(
        "entity", "term", F.log2(F.col("n_et") * n / (F.col("n_e") * (F.greatest("n_t", "n_et") + smoothing))).alias("pmi"), F.log2(n / F.col("n_e")).alias("ic")
    )
    return scored.where(F.col("pmi") >= alpha * F.col("ic") - 1e-9)


def hash_text(text: str) -> int:
    """A 64-bit hash of one text that is alike on every worker."""
    import xxhash

    return xxhash.xxh64_intdigest(text) - (1 << 63)


def sanitise_documents(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", counts: bool = False, **settings) -> DataFrame:
    """All rows and columns with the text sanitised and its length updated; `counts` adds n_entities and n_terms."""
    pairs = materialize(disclosing_terms(docs, text=text, **settings).select("entity", "term"), "disclosing")
    rows = pairs.limit(MAX_PAIRS + 1).collect()
    schema = docs.schema
    at = docs.columns.index(text)
    length = docs.columns.index(n_chars) if n_chars in docs.columns else None
    added = [fresh(docs, c) for c in ("n_entities", "n_terms")]
    by_entity: dict[str, list[str]] = {}
    joined = len(rows) > MAX_PAIRS
    if joined:
        docs, term_at = _attach(docs, pairs, text)
    else:
        for r in rows:
            by_entity.setdefault(r["entity"], []).append(r["term"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            extra = batch.column(term_at).to_pylist() if joined else None
            texts, found, hidden = [], [], []
            for k, t in enumerate(batch.column(at).to_pylist()):
                if extra and extra[k]:
                    new, e, h = _rewrite(t, entities(t), set(extra[k]))
                else:
                    new, e, h = sanitise(t, by_entity)
                texts.append(new)
                found.append(e)
                hidden.append(h)
            columns = list(batch.columns)[: len(schema)]
            columns[at] = pa.array(texts, pa.string())
            if length is not None:
                kind = columns[length].type
                changed = pa.array([e > 0 for e in found], pa.bool_())
                sizes = pa.array([None if t is None else len(t) for t in texts]).cast(kind)
                columns[length] = pc.if_else(changed, sizes, columns[length])
            names = list(schema.names)
            if counts:
                columns += [pa.array(found, pa.int32()), pa.array(hidden, pa.int32())]
                names += added
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = schema
    if counts:
        from pyspark.sql.types import IntegerType, StructField, StructType

        out = StructType([*schema.fields, *(StructField(c, IntegerType()) for c in added)])
    return docs.mapInArrow(run, out)


def _attach(docs: DataFrame, pairs: DataFrame, text: str) -> tuple[DataFrame, int]:
    """The documents with one more column, the disclosing terms of their entities, joined by the text's hash."""
    source = docs.select(F.col(text).alias("text")).where("text IS NOT NULL")

    def mentioned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0):
            out = [(t, f"{k}:{v.lower()}") for t in batch.column(0).to_pylist() if HINT.search(t) for _, _, k, v in entities(t)]
            t, e = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(e, pa.string())], ["text", "entity"])

    per_text = source.mapInArrow(mentioned, "text string, entity string").select(F.xxhash64("text").alias("h_"), "entity").distinct()
    per_text = per_text.join(pairs, "entity").groupBy("h_").agg(F.collect_set("term").alias("terms_"))
    names = [f"c{i}_" for i in range(len(docs.columns))]
    renamed = docs.toDF(*names)
    joined = renamed.withColumn("h_", F.xxhash64(names[docs.columns.index(text)])).join(per_text, "h_", "left").select(*names, "terms_")
    return joined, len(names)
