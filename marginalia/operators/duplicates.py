"""Duplicated stretches between the documents of a collection, in the order of the documents.

`DuplicateFinder` is exact within a collection (a patient's documents, say): one group, one
task.  `first_occurrences` needs no group: every fingerprint points to the first document
that holds it, so a collection may be as large as the corpus.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.kernel import Found, Rows, Segment, attribute, pieces
from marginalia.functions.spans import Span
from marginalia.plans.tables import written
from marginalia.schema import ANN, make_uid, op_id

_WORD, _SOLID, _CUT = re.compile(r"\w+|[^\w\s]"), re.compile(r"\w"), re.compile(r"(\w+|[^\w\s])")


def fingerprints(text: str, kind: str = "word", length: int = 2, step: int = 1, case_sensitive: bool = True, multiline: bool = True) -> Iterator[tuple[str, int, int]]:
    """(fingerprint, start, end) of runs of `length` words or characters; without `multiline` none crosses a line end."""
    shown = text if case_sensitive else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    parts = [(0, len(text))] if multiline else [m.span() for m in re.finditer(r"[^\n]+", text)]
    for a, b in parts:
        if kind == "char":
            for i in range(a, b - length + 1, step):
                yield shown[i : i + length], i, i + length
        else:
            words = [m.span() for m in _WORD.finditer(shown, a, b)]
            for i in range(0, len(words) - length + 1, step):
                run = words[i : i + length]
                yield "\0".join(shown[s:e] for s, e in run), run[0][0], run[-1][1]


class CollectionIndex:
    """Fingerprints of the documents seen so far."""

    def __init__(self, kind="word", length=2, step=1, case_sensitive=True, multiline=True, shortest=5):
        self.settings, self.shortest = (kind, length, step, case_sensitive, multiline), shortest
        self.places: dict[str, list[tuple[int, int, int]]] = {}

    def add(self, doc: int, text: str) -> list[tuple[int, int, int, int, int]]:
        """(start, end, source document, source start, source end) of what earlier documents hold, longest first chosen, in text order."""
        open_: dict[tuple[int, int], list[int]] = {}
        runs: list[tuple[int, int, int, int, int]] = []
        own = list(fingerprints(text, *self.settings))
        for print_, s, e in own:
            now: dict[tuple[int, int], list[int]] = {}
            for d, ss, se in self.places.get(print_, ()):
                key = (d, ss - s)
                # A run goes on while the next fingerprint lies on the same diagonal and touches the last.
                run = open_.get(key)
                if run is not None and s <= run[1] and e - s == se - ss:
                    run[1], run[3] = e, se
                    now[key] = run
                else:
                    if run is not None:
                        runs.append((run[0], run[1], d, run[2], run[3]))
                    now[key] = [s, e, ss, se]
            for key, run in open_.items():
                if key not in now:
                    if run[1] > s:
                        now[key] = run
                    else:
                        runs.append((run[0], run[1], key[0], run[2], run[3]))
            open_ = now
        runs += [(r[0], r[1], k[0], r[2], r[3]) for k, r in open_.items()]
        for print_, s, e in own:
            self.places.setdefault(print_, []).append((doc, s, e))
        kept: list[tuple[int, int, int, int, int]] = []
        for run in sorted({r for r in runs if r[1] - r[0] >= self.shortest}, key=lambda r: (r[0] - r[1], r[0], r[2], r[3])):
            if all(run[1] <= k[0] or k[1] <= run[0] for k in kept):
                kept.append(run)
        return sorted(kept)


_kept: dict[tuple, tuple[list[str], CollectionIndex]] = {}
#: Collections whose index a worker keeps between calls.
MAX_KEPT = 64


def kept_index(key: tuple, ids: list[str], texts: list[str], settings: dict) -> CollectionIndex:
    """The index of these documents: the one that this worker kept under the key if it is of the same ids, else built anew."""
    name = (key, tuple(sorted(settings.items())))
    known = _kept.pop(name, None)
    if known is not None and known[0] == ids:
        return known[1]
    index = CollectionIndex(**settings)
    for n, text in enumerate(texts):
        index.add(n, text)
    return index


def keep_index(key: tuple, ids: list[str], index: CollectionIndex, settings: dict) -> None:
    while len(_kept) >= MAX_KEPT:
        _kept.pop(next(iter(_kept)))
    _kept[key, tuple(sorted(settings.items()))] = (list(ids), index)


class DuplicateFinder:
    """Segments of what a document shares with earlier ones of its collection ('dup'), of the rest ('nondup'), or both.

    The order is that of `order_by` (a date, say), then of the document id.
    """

    def __init__(self, output_label="duplicate", segments_to_output="dup", min_duplicate_length=5, fingerprint_type="word", fingerprint_length=2, case_sensitive=True, allow_multiline=True, step=1):
        if segments_to_output not in ("dup", "nondup", "both"):
            raise ValueError(segments_to_output)
        self.label, self.output = output_label, segments_to_output
        self.settings = {"kind": fingerprint_type, "length": fingerprint_length, "step": step, "case_sensitive": case_sensitive, "multiline": allow_multiline, "shortest": min_duplicate_length}
        self.op_id = op_id("DuplicateFinder", {"label": output_label, "output": segments_to_output, **self.settings})

    def find(self, docs: Iterable[tuple[str, str, str | None]]) -> Iterator[tuple[Segment, list[Found]]]:
        """Each document of (doc_id, text, date), in order, with what is found in it."""
        index, seen = CollectionIndex(**self.settings), []
        for n, (doc_id, text, date) in enumerate(docs):
            text = text or ""
            seen.append((doc_id, date))
            seg = Segment(doc_id, make_uid("RAW_TEXT", doc_id), "RAW_TEXT", text, [Span(0, len(text))] if text else [])
            found: list[tuple[int, int, dict]] = []
            at = 0
            for s, e, source, ss, se in [*index.add(n, text), (len(text), len(text), -1, 0, 0)]:
                if at < s and self.output != "dup":
                    found.append((at, s, attribute("is_duplicate", False, "DuplicationAttribute")))
                if e > s and self.output != "nondup":
                    about = {"source_doc_id": seen[source][0], "source_start": ss, "source_end": se} | ({"source_doc_date": seen[source][1]} if seen[source][1] is not None else {})
                    found.append((s, e, attribute("is_duplicate", True, "DuplicationAttribute", metadata=about)))
                at = e
            kept = [f for f in found if _SOLID.search(text, f[0], f[1])]
            yield seg, [Found(self.label, (s, e), attrs=[attr]) for s, e, attr in kept]

    def run(self, docs: DataFrame, collection: str = "collection_id", doc_id: str = "doc_id", text: str = "text", order_by: str | None = None) -> DataFrame:
        me, out = self, Rows(self.op_id)

        def one(table):
            rows = sorted(table.to_pylist(), key=lambda r: (r["o"] is not None, r["o"] or "", r["n"] is None, r["n"] if r["n"] is not None else 0, r["d"] or ""))
            for seg, found in me.find((r["d"], r["t"], r["o"]) for r in rows):
                out.add(seg, found)
            return pa.Table.from_batches([out.batch()])

        number = F.expr(f"try_cast(`{doc_id}` AS BIGINT)")
        shown = F.col(order_by).cast("string") if order_by else F.lit(None).cast("string")
        rows = docs.select(F.col(collection).alias("c"), F.col(doc_id).cast("string").alias("d"), number.alias("n"), F.col(text).alias("t"), shown.alias("o"))
        return rows.groupBy("c").applyInArrow(one, ANN)


def exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, source_doc_id of documents whose whole text an earlier one has.

    Texts are compared by their SHA-256 and never shuffled: a digest and an id a document are.
    """
    rows = docs.where(F.col(text).isNotNull()).select(doc_id, F.unhex(F.sha2(text, 256)).alias("digest_"))
    first = rows.groupBy("digest_").agg(F.min(doc_id).alias("source_doc_id"), F.max(doc_id).alias("last_")).where("source_doc_id < last_").drop("last_")
    return rows.join(first, "digest_").where(F.col(doc_id) > F.col("source_doc_id")).select(doc_id, "source_doc_id")


def line_occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = 5) -> DataFrame:
    """doc_id, line_no, line: the lines of the documents of at least that many characters, with their numbers from 0."""
    rows = docs.select(doc_id, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return rows.where(F.length("line") >= shortest)


def hashed_runs(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, 64-bit hash, start and end of every run of `length` words in each text."""
    import xxhash

    words: list[str] = []
    starts, ends, count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(texts), np.int64)
    for n, text in enumerate(texts):
        parts = _CUT.split(text)  # what lies between the words, and the words
        edge = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        starts.append(edge[:-1:2])
        ends.append(edge[1::2])
        words += parts[1::2]
        count[n] = len(parts) // 2
    start, end, total = np.concatenate(starts), np.concatenate(ends), len(words)
    coded = pa.array(words, pa.string()).dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = known[np.asarray(coded.indices)] if total else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), count)
    fits = np.flatnonzero(np.arange(total) + length <= np.cumsum(count)[owner]) if total else np.zeros(0, np.int64)
    out = np.zeros(len(fits), np.uint64)
    for j in range(length):
        # A polynomial of the word hashes; each step also mixes the high bits down.
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[fits + j]
    return owner[fits], out.view(np.int64), start[fits].astype(np.int32), end[fits + length - 1].astype(np.int32) if len(fits) else np.zeros(0, np.int32)


#: Bytes of fingerprints that a task gets together, and about how many a character of text has.
PRINTS_AT_ONCE, BYTES_PER_CHARACTER = 32 << 20, 4
_PARTS = (("print", np.int64), ("doc", np.int64), ("s", np.int32), ("e", np.int32))


def _packed(columns: list[np.ndarray]) -> bytes:
    """Numbers of equal count, byte by byte: the high bytes of most are alike and shrink in a shuffle."""
    return b"".join(np.ascontiguousarray(x.astype(k).view(np.uint8).reshape(len(x), -1).T).tobytes() for x, (_, k) in zip(columns, _PARTS))


def _unpacked(data: bytes) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for _, k in _PARTS]
    n, at, out = len(data) // sum(sizes), 0, []
    for (_, k), size in zip(_PARTS, sizes):
        out.append(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T.copy().view(k).ravel())
        at += n * size
    return out


def _shared_runs(source: DataFrame, length: int) -> DataFrame:
    """The runs of documents (whose ids are integers) that an earlier document has as well, with the first place there.

    Fingerprints are shuffled once, packed, to tasks by their hash; a task sorts what it gets.
    """
    spark = source.sparkSession
    size = source.agg(F.sum(F.length("text"))).first()[0] or 0
    tasks = max(math.ceil(size * BYTES_PER_CHARACTER / PRINTS_AT_ONCE), spark.sparkContext.defaultParallelism)
    # A number for each task that Spark's hash sends to it.
    number = F.col("id").cast("int")
    goals = np.array([r[0] for r in spark.range(tasks * 16).groupBy(F.pmod(F.hash(number), F.lit(tasks))).agg(F.min(number)).collect()], np.int32)
    goals.sort()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            owner, h, s, e = hashed_runs(batch.column(1).to_pylist(), length)
            ids = np.asarray(batch.column(0))[owner]
            turn = ((h.view(np.uint64) ^ (h.view(np.uint64) >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(len(goals))
            order = np.argsort(turn, kind="stable")
            cuts = np.flatnonzero(np.diff(turn[order], prepend=-1)) if len(order) else np.zeros(0, np.int64)
            groups = np.split(order, cuts[1:]) if len(cuts) else []
            yield pa.RecordBatch.from_arrays([pa.array([int(goals[turn[g[0]]]) for g in groups], pa.int32()), pa.array([_packed([h[g], ids[g], s[g], e[g]]) for g in groups], pa.binary())], ["goal", "data"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [_unpacked(x) for batch in batches for x in batch.column(1).to_pylist()]
        if not got:
            return
        h, doc, s, e = (np.concatenate(x) for x in zip(*got))
        del got
        order = np.lexsort((s, doc, h))
        h, doc, s, e = h[order], doc[order], s[order], e[order]
        new = np.append(True, h[1:] != h[:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        # In one document the first start and the first end belong to the same run.
        later = np.flatnonzero(doc != doc[first])
        for a in range(0, len(later), 1 << 16):
            at = later[a : a + (1 << 16)]
            of = first[at]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[at], doc[of], s[at], e[at], s[of], e[of])], ["doc_id", "source_doc_id", "s", "e", "ss", "se"])

    dealt = source.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(deal, "goal int, data binary").repartition(tasks, "goal")
    kind = source.schema["doc_id"].dataType
    found = dealt.mapInArrow(meet, "doc_id long, source_doc_id long, s int, e int, ss int, se int")
    return found.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("source_doc_id").cast(kind).alias("source_doc_id"), "s", "e", "ss", "se")


def first_occurrences(docs: DataFrame, length: int = 8, doc_id: str = "doc_id", text: str = "text", shortest: int = 5) -> DataFrame:
    """doc_id, start, end, source_doc_id, source_start, source_end: maximal runs of words that an earlier document has first.

    A shuffle on the fingerprint (hash of `length` words) finds its first document; runs are
    the islands of one diagonal.  Its cost is linear in the text however often a stretch recurs.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    kind = source.schema["doc_id"].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return _islands(_shared_runs(source, length), shortest)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            owner, h, s, e = hashed_runs(batch.column(1).to_pylist(), length)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(h), pa.array(s), pa.array(e)], ["doc_id", "print", "s", "e"])

    found = written(source.mapInArrow(prints, f"doc_id {kind}, print long, s int, e int"), "runs")
    # A hash aggregate with map-side combine finds the prints of several documents; only their rows go further.
    origin = found.groupBy("print").agg(F.min("doc_id").alias("source_doc_id"), F.max("doc_id").alias("last")).where("source_doc_id < last").drop("last")
    shared = written(found.join(origin, "print"), "shared-runs")
    # In one document the first start and the first end belong to the same run.
    firsts = shared.where("doc_id = source_doc_id").groupBy("print").agg(F.min("s").alias("ss"), F.min("e").alias("se"))
    return _islands(shared.where("doc_id > source_doc_id").join(firsts, "print"), shortest)


def _islands(hits: DataFrame, shortest: int) -> DataFrame:
    """Runs that follow one another on a diagonal as one."""
    hits = hits.withColumn("diagonal", F.col("ss") - F.col("s"))
    order = Window.partitionBy("doc_id", "source_doc_id", "diagonal").orderBy("s")
    gap = (F.lag("e").over(order).isNull() | (F.col("s") > F.lag("e").over(order))).cast("int")
    islands = hits.withColumn("g", gap).withColumn("island", F.sum("g").over(order))
    runs = islands.groupBy("doc_id", "source_doc_id", "diagonal", "island").agg(F.min("s").alias("start"), F.max("e").alias("end"), F.min("ss").alias("source_start"), F.max("se").alias("source_end"))
    return runs.where(F.col("end") - F.col("start") >= shortest).select("doc_id", "start", "end", "source_doc_id", "source_start", "source_end")
