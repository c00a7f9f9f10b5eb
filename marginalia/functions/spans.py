"""Span algebra: edits of a text together with the spans that say where it comes from.

A span is (start, end), a stretch of the document, or Mod(length, replaced): text of that
length that stands for the stretches in `replaced`.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Span(NamedTuple):
    start: int
    end: int


class Mod(NamedTuple):
    length: int
    replaced: tuple[Span, ...] = ()


AnySpan = Span | Mod


def size(span: AnySpan) -> int:
    return span.end - span.start if isinstance(span, Span) else span.length


def check(text: str, spans: list[AnySpan]) -> None:
    if sum(map(size, spans)) != len(text):
        raise ValueError("the spans are not as long as the text")


def cut(spans: list[AnySpan], start: int, end: int) -> list[AnySpan]:
    """The spans of text[start:end]. Part of a Mod keeps all it stands for, as its parts can't be told apart."""
    out: list[AnySpan] = []
    at = 0
    for s in spans:
        n = size(s)
        a, b = max(start - at, 0), min(end - at, n)
        if a < b:
            out.append(Span(s.start + a, s.start + b) if isinstance(s, Span) else Mod(b - a, s.replaced))
        at += n
        if at >= end:
            break
    return out


def sources(spans: list[AnySpan]) -> tuple[Span, ...]:
    out: list[Span] = []
    for s in spans:
        out.extend([s] if isinstance(s, Span) else s.replaced)
    return tuple(out)


def replace(text: str, spans: list[AnySpan], ranges: list[tuple[int, int]], texts: list[str]) -> tuple[str, list[AnySpan]]:
    """Replace sorted, disjoint ranges; an empty replacement removes, an empty range inserts."""
    check(text, spans)
    if len(ranges) != len(texts):
        raise ValueError("as many replacements as ranges are needed")
    new_text, new_spans, at = [], [], 0
    for (a, b), new in zip(ranges, texts):
        if a < at or b < a or b > len(text):
            raise ValueError("ranges must be sorted, disjoint and within the text")
        new_text += [text[at:a], new]
        new_spans += cut(spans, at, a)
        if new:
            new_spans.append(Mod(len(new), sources(cut(spans, a, b))))
        at = b
    new_text.append(text[at:])
    new_spans += cut(spans, at, len(text))
    return "".join(new_text), new_spans


def remove(text: str, spans: list[AnySpan], ranges: list[tuple[int, int]]) -> tuple[str, list[AnySpan]]:
    nothing = [""] * len(ranges)
    return replace(text, spans, ranges, nothing)


def insert(text: str, spans: list[AnySpan], positions: list[int], texts: list[str]) -> tuple[str, list[AnySpan]]:
    return replace(text, spans, [(p, p) for p in positions], texts)


def extract(text: str, spans: list[AnySpan], ranges: list[tuple[int, int]]) -> tuple[str, list[AnySpan]]:
    """The text of the ranges and its spans; no range gives an empty text."""
    check(text, spans)
    if any(b > len(text) or a < 0 for a, b in ranges):
        raise ValueError("ranges must be within the text")
    return "".join(text[a:b] for a, b in ranges), [s for a, b in ranges for s in cut(spans, a, b)]


def move(text: str, spans: list[AnySpan], moved: tuple[int, int], to: int) -> tuple[str, list[AnySpan]]:
    a, b = moved
    if a < to <= b:
        raise ValueError("the destination lies in what is moved")
    order = [(0, to), (a, b), (to, a), (b, len(text))] if to <= a else [(0, a), (b, to), (a, b), (to, len(text))]
    return extract(text, spans, order)


def concatenate(texts: list[str], all_spans: list[list[AnySpan]]) -> tuple[str, list[AnySpan]]:
    return "".join(texts), [s for spans in all_spans for s in spans]


def normalize(spans: list[AnySpan]) -> list[Span]:
    """Stretches of the document in order; only those that touch are merged."""
    out: list[Span] = []
    for s in sorted(x for x in sources(spans)):
        if out and out[-1].end == s.start:
            out[-1] = Span(out[-1].start, s.end)
        else:
            out.append(s)
    return out


def close_gaps(spans: list[Span], text: str, max_gap: int = 3) -> list[Span]:
    """Merge normalized spans whose gap holds at most max_gap characters, white space at its edges apart."""
    out: list[Span] = []
    for s in spans:
        if out and len(text[out[-1].end : s.start].strip()) <= max_gap:
            out[-1] = Span(out[-1].start, s.end)
        else:
            out.append(s)
    return out


def overlaps(a: Span, b: Span) -> bool:
    return a.start < b.end and a.end > b.start


def from_rows(rows: list[dict] | None) -> list[AnySpan]:
    out: list[AnySpan] = []
    for r in rows or ():
        if r["length"] is None:
            out.append(Span(r["start"], r["end"]))
        else:
            out.append(Mod(r["length"], tuple(Span(x["start"], x["end"]) for x in r["replaced"] or ())))
    return out


def to_rows(spans: list[AnySpan]) -> list[dict]:
    return [
        {"start": s.start, "end": s.end, "length": None, "replaced": None}
        if isinstance(s, Span)
        else {"start": None, "end": None, "length": s.length, "replaced": [{"start": r.start, "end": r.end} for r in s.replaced]}
        for s in spans
    ]


def bounds(spans: list[AnySpan]) -> tuple[int | None, int | None]:
    found = sources(spans)
    return (min(s.start for s in found), max(s.end for s in found)) if found else (None, None)


# Column forms, for plans that stay in the JVM.


def normalize_column(spans: Column) -> Column:
    """The same as `normalize` for a span array column."""
    flat = F.flatten(F.transform(spans, lambda s: F.when(s.length.isNull(), F.array(F.struct(s.start.alias("start"), s.end.alias("end")))).otherwise(s.replaced)))
    start = F.array().cast("array<struct<start: int, end: int>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last.start.alias("start"), s.end.alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)).end == s.start), joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(flat), start, step)


def overlap_column(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (a_end > b_start)
