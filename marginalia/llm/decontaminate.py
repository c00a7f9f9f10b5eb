"""Benchmark decontamination with a distributed positional inverted index.

The index has one posting row per document and term: (term hash, document, positions); it is
written once to the shared folder and partitioned by document, so building it needs no
shuffle.  Postings are stored for the terms that the test items hold (no other list is ever
looked up), or for all terms when that vocabulary is too large to ship.

For each item the lists are intersected from its rarest terms: an item of n terms may miss
m = n - ceil(ratio * n) of them, hence any match holds at least k of the m + k rarest, and
only documents that do are looked at further.  Their lists of all terms are then adjusted by
the term's offset in the item: votes on one diagonal give an exact phrase, votes within
`slack` of a diagonal for at least `ratio` of the terms a proximity match.

Defined results: terms are lower-case runs of letters, digits and non-ASCII characters.
Null or empty texts and items without terms match nothing.  Items of fewer than SHORT terms
only match as exact phrases.  The best alignment of each (document, item) is reported: most
terms, then the phrase, then the earliest diagonal.  Repeated rows count as one document,
repeated items each report.  Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import Tokens, fresh, hash_strings, lowered, materialize, row_key, sliced, text_array

RATIO, SLACK, SHORT, SEED_VOTES = 0.8, 3, 10, 3
#: Distinct test terms up to which the vocabulary travels to the workers; beyond it all terms are indexed.
MAX_VOCABULARY = 2_000_000
#: Candidate rows up to which a join side is broadcast (24 bytes each).
MAX_BROADCAST = 500_000


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term of a batch of texts and each text's first term."""
    tokens = Tokens(lowered(column))
    codes, words = tokens.encode()
    return hash_strings(words).view(np.int64)[codes], tokens.first


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, item, i, term, n: the terms of each test item with their offsets; item is the item's row key."""
    source = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"), row_key(item_id, text).alias("item"))
    kind = source.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            terms, first = token_hashes(text_array(batch.column(1)))
            n = np.diff(first)
            owner = np.repeat(np.arange(len(n)), n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner)), batch.column(2).take(pa.array(owner)), pa.array((np.arange(len(terms)) - first[owner]).astype(np.int32)), pa.array(terms), pa.array(n[owner].astype(np.int32))],
                ["item_id", "item", "i", "term", "n"],
            )

    return source.mapInArrow(run, f"item_id {kind}, item long, i int, term long, n int")


def build_index(docs: DataFrame, vocabulary: np.ndarray | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """term, key, doc_id, n, positions: the postings of each document, for the sorted hashes of `vocabulary` or all terms."""
    source = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("key"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            tokens = Tokens(lowered(text_array(batch.column(2))))
            codes, words = tokens.encode()
            hashes = hash_strings(words).view(np.int64)
            owner = tokens.texts()
            place = np.arange(len(codes)) - tokens.first[:-1][owner]
            if vocabulary is not None:
                spot = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
                wanted = vocabulary[spot] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
                use = np.flatnonzero(wanted[codes])
                codes, owner, place = codes[use], owner[use], place[use]
            if not len(codes):
                continue
            order = np.argsort(owner * (int(codes.max()) + 1) + codes, kind="stable")
            codes, owner, place = codes[order], owner[order], place[order].astype(np.int32)
            cut = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])))
            offsets = np.append(cut, len(codes)).astype(np.int32)
            rows = pa.array(owner[cut])
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[codes[cut]]), batch.column(1).take(rows), batch.column(0).take(rows), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(place))],
                ["term", "key", "doc_id", "n", "positions"],
            )

    return source.mapInArrow(run, f"term long, key long, doc_id {kind}, n int, positions array<int>")


def best_alignment(i: np.ndarray, pos: np.ndarray, n: int, ratio: float, slack: int, short: int) -> tuple[str, int, int] | None:
    """(kind, first position, matched terms) of the best alignment of an item of n terms, or None."""
    pairs = np.unique(np.stack([pos - i, i], 1), axis=0)
    diag, term = pairs[:, 0], pairs[:, 1]
    starts = np.flatnonzero(np.append(True, diag[1:] != diag[:-1]))
    counts = np.diff(np.append(starts, len(diag)))
    exact = np.flatnonzero(counts == n)
    if len(exact):
        return "phrase", int(diag[starts[exact[0]]]), n
    if n < short:
        return None
    need = math.ceil(ratio * n - 1e-9)
    values = diag[starts]
    low, high = np.searchsorted(diag, values - slack, "left"), np.searchsorted(diag, values + slack, "right")
    best = None
    for v, a, b in zip(values, low, high):
        if b - a >= need and (k := len(np.unique(term[a:b]))) >= need and (best is None or k > best[2]):
            best = "proximity", int(v), k
    return best


def _broadcast_if_small(df: DataFrame, limit: int = MAX_BROADCAST) -> DataFrame:
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def matches(
    docs: DataFrame, items: DataFrame, ratio: float = RATIO, slack: int = SLACK, short: int = SHORT, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", max_vocabulary: int = MAX_VOCABULARY
) -> DataFrame:
    """doc_id, key, item_id, kind, position, matched, n_terms of all phrase and proximity matches."""
    terms = materialize(item_terms(items, item_id, item_text).distinct(), "item-terms")
    distinct = terms.select("term").distinct().limit(max_vocabulary + 1).toPandas()["term"].to_numpy(np.int64)
    vocabulary = np.sort(distinct) if len(distinct) <= max_vocabulary else None
    index = materialize(build_index(docs, vocabulary, doc_id, text), "postings")
    frequency = index.groupBy("term").agg(F.sum("n").alias("f"))
    missing = F.when(F.col("n") < short, 0).otherwise(F.col("n") - F.ceil(F.lit(ratio) * F.col("n") - 1e-9)).cast("int")
    rarest = Window.partitionBy("item").orderBy("f", "i", "term")
    seeds = (
        terms.join(frequency, "term", "left")
        .fillna({"f": 0})
        .withColumn("votes", F.least(F.lit(SEED_VOTES), F.col("n") - missing))
        .withColumn("r", F.row_number().over(rarest))
        .where((F.col("r") <= missing + F.col("votes")) & (F.col("f") > 0))
        .select("term", "item", "i", "votes")
    )
    seeds = materialize(seeds, "seeds")
    found = index.select("term", "key").join(_broadcast_if_small(seeds), "term")
    pairs = found.groupBy("item", "key").agg(F.countDistinct("i").alias("hits"), F.first("votes").alias("votes")).where("hits >= votes").select("item", "key")
    pairs = materialize(pairs, "candidates")
    wanted = pairs.join(terms.select("item", "term", "i", F.col("n").alias("n_terms")).distinct(), "item")
    keys = pairs.select("key").distinct()
    lists = index.join(_broadcast_if_small(keys), "key", "left_semi").join(wanted, ["key", "term"]).select("item", "key", "doc_id", "positions", "i", "n_terms")
    votes = lists.groupBy("item", "key", "n_terms").agg(F.first("doc_id").alias("doc_id"), F.collect_set(F.struct("i", "positions")).alias("votes"))
    kind = votes.schema["doc_id"].dataType.simpleString()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            sizes = batch.column(2).to_pylist()
            for row, votes_ in enumerate(batch.column(4)):
                i = np.concatenate([np.full(len(v["positions"]), v["i"].as_py()) for v in votes_])
                pos = np.concatenate([np.asarray(v["positions"].values) for v in votes_])
                if best := best_alignment(i, pos, sizes[row], ratio, slack, short):
                    keep.append(row)
                    out.append(best)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), batch.column(3).take(rows), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32()), batch.column(2).take(rows)],
                ["item", "key", "doc_id", "kind", "position", "matched", "n_terms"],
            )

    aligned = votes.select("item", "key", "n_terms", "doc_id", "votes").mapInArrow(align, f"item long, key long, doc_id {kind}, kind string, position int, matched int, n_terms int")
    names = terms.select("item", "item_id").distinct()
    return aligned.join(names, "item").select("doc_id", "key", "item_id", "kind", "position", "matched", "n_terms")


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The documents in which no test item was found; all columns are kept."""
    key = fresh(docs, "row_key")
    gone = materialize(matches(docs, items, doc_id=doc_id, text=text, **settings).select(F.col("key").alias(key)).distinct(), "contaminated")
    return docs.withColumn(key, row_key(doc_id, text)).join(_broadcast_if_small(gone), key, "left_anti").drop(key)
