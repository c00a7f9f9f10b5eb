"""MinHash near-duplicates by a multi-index Hamming join.

Each text has a signature of LANES b-bit minima over its word bigrams.  Two texts are near
duplicates if at most RADIUS lanes differ.  The lanes are split into CHUNKS chunks; by the
pigeonhole principle a pair within RADIUS < 2 * CHUNKS lanes has a chunk with at most one
wrong lane, so every chunk is indexed once per lane with that lane left out (the enumeration
of the allowed chunk error).  A key holds three lanes at least, 48 bits, so that of n
signatures about n / 2^48 meet by chance in a bucket, less than one up to 10^14.  All pairs under the distance threshold therefore meet in some
bucket; none is dropped and no bucket is capped.  A bucket of n signatures is resolved by
pivots: one pivot is compared with all, then every signature outside its component is, which
finds exactly the links that connect components without writing n * n / 2 pairs.  Groups are
the connected components over all buckets.

Texts with equal signatures are collapsed before the join, so thousands of copies cost one
row.  Every bigram of a text enters every lane, so lanes agree as often as the sets of bigrams overlap.

Defined results: null, empty and word-less texts are in no group and stay.  A one-word text
counts that word as its bigram.  The document that stays is the one with the lowest id
(null ids last), ties by row key.  Rows that repeat another (same id, same text) are one
document; of them one row stays.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import Tokens, fresh, hash_strings, lowered, materialize, mix, row_key, sliced, text_array

LANES, BITS, CHUNKS, RADIUS = 64, 16, 14, 27
#: Up to this many links one task joins the components; beyond it label propagation does. Both are exact.
LINKS_IN_ONE_TASK = 1_000_000

_rng = np.random.default_rng(20240607)
_A = (_rng.integers(0, 2**31, 256, dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
_B = _rng.integers(0, 2**32, 256, dtype=np.uint32)


def chunk_bounds(lanes: int, chunks: int) -> list[tuple[int, int]]:
    cuts = [round(i * lanes / chunks) for i in range(chunks + 1)]
    return list(zip(cuts[:-1], cuts[1:]))


def signatures(column: pa.Array, lanes: int = LANES, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """One row of b-bit lanes per text, and which texts have any word."""
    tokens = Tokens(lowered(column))
    codes, words = tokens.encode()
    n = len(tokens.first) - 1
    has = np.diff(tokens.first) > 0
    dtype = np.uint8 if bits <= 8 else np.uint16
    out = np.zeros((n, lanes), dtype)
    if not len(codes):
        return out, has
    h = hash_strings(words)[codes]
    last = np.zeros(len(h), bool)
    last[tokens.first[1:][has] - 1] = True
    h2 = np.append(h[1:], np.uint64(0))
    gram = mix(h * np.uint64(3) + np.where(last, np.uint64(0), h2 * np.uint64(5)))
    # The pair that would cross into the next text is left out, unless it is a text's only word.
    single = last & (np.repeat(np.diff(tokens.first), np.diff(tokens.first)) == 1)
    use = ~last | single
    gram = (gram[use] >> np.uint64(32)).astype(np.uint32)
    count = np.where(has, np.maximum(np.diff(tokens.first) - 1, 1), 0)
    starts = np.cumsum(count) - count
    full = np.flatnonzero(has)
    mask = np.uint32((1 << bits) - 1)
    for k in range(lanes):
        v = gram * _A[k]
        v += _B[k]
        low = np.minimum.reduceat(v, starts[full])
        out[full, k] = (mix(low.astype(np.uint64)) & np.uint64(mask)).astype(dtype)
    return out, has


def bucket_keys(sig: np.ndarray, chunks: int = CHUNKS) -> np.ndarray:
    """For each signature one 64-bit key per lane: its chunk without that lane."""
    n, lanes = sig.shape
    out = np.zeros((n, lanes), np.uint64)
    wide = sig.astype(np.uint64)
    for c, (a, b) in enumerate(chunk_bounds(lanes, chunks)):
        for skip in range(a, b):
            acc = np.full(n, np.uint64(c * 1000 + skip + 1), np.uint64)
            for k in range(a, b):
                if k != skip:
                    acc = mix(acc * np.uint64(0x100000001B3) + wide[:, k] + np.uint64(1))
            out[:, skip] = acc
    return out


def bucket_links(ids: np.ndarray, sig: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect all components of a bucket: (id, smallest id of its component)."""
    n = len(ids)
    if n == 2:
        return [(int(ids.max()), int(ids.min()))] if (sig[0] != sig[1]).sum() <= radius else []
    label = np.arange(n)

    def join(p: int) -> None:
        near = np.flatnonzero((sig != sig[p]).sum(1) <= radius)
        old = np.unique(label[near])
        if len(old) > 1:
            label[np.isin(label, old)] = old[0]

    join(0)
    done = np.zeros(n, bool)
    done[0] = True
    while True:
        big = np.bincount(label).argmax()
        todo = np.flatnonzero((label != big) & ~done)
        if not len(todo):
            break
        join(todo[0])
        done[todo[0]] = True
    out = []
    for lab in np.unique(label):
        members = ids[label == lab]
        if len(members) > 1:
            low = members.min()
            out += [(int(x), int(low)) for x in members if x != low]
    return out


def _sketch(source: DataFrame, lanes: int, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            sig, has = signatures(text_array(batch.column(2)), lanes, bits)
            rows = [r.tobytes() for r in sig]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary(), mask=~has)], ["doc_id", "key", "sig"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, key long, sig binary")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by column 0, cut so that no run of equal values is split."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(0))
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        if last == 0 and held and keys[0] == np.asarray(held[-1].column(0))[-1]:
            held.append(batch)
            continue
        if last:
            held.append(batch.slice(0, last))
        if held:
            yield pa.Table.from_batches(held)
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def components(links: DataFrame, in_one_task: int = LINKS_IN_ONE_TASK) -> DataFrame:
    """node, label (smallest id of its component) for links (a, b)."""
    links = links.where("a <> b").distinct()
    if links.limit(in_one_task + 1).count() <= in_one_task:

        def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while (p := parent.setdefault(x, x)) != x:
                    parent[x] = parent[p]
                    x = parent[x]
                return x

            for batch in batches:
                for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ra, rb = root(a), root(b)
                    if ra != rb:
                        parent[max(ra, rb)] = min(ra, rb)
            nodes = list(parent)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "label"])

        return links.select("a", "b").coalesce(1).mapInArrow(union, "node long, label long")
    # Alternating large-star and small-star steps; each is a shuffle of the links, and the number of steps is logarithmic.
    edges = materialize(links.select("a", "b"), "links")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("x"), F.col("m"), "a")
        new = small.select(F.col("x").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = materialize(new, "links")
        if not new.exceptAll(edges).limit(1).count() and not edges.exceptAll(new).limit(1).count():
            break
        edges = new
    tops = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(tops)


def groups(docs: DataFrame, lanes: int = LANES, bits: int = BITS, chunks: int = CHUNKS, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key, rep_id, group_size, keep, rows for every distinct document."""
    if radius >= 2 * chunks:
        raise ValueError("radius must stay below 2 * chunks, else pairs could be missed")
    source = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("key"), F.col(text).alias("text"))
    sketch = materialize(_sketch(source, lanes, bits), "signatures")
    by_row = sketch.groupBy("doc_id", "key", "sig").agg(F.count("*").alias("rows"))
    nodes = materialize(by_row.where("sig IS NOT NULL").groupBy("sig").agg(F.min("key").alias("node")), "nodes")
    width, kind = lanes, np.uint8 if bits <= 8 else np.uint16

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), kind).reshape(-1, width)
                keys = bucket_keys(sig, chunks)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(np.asarray(part.column(0)), width))], ["bucket", "node"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            keys = np.asarray(table.column(0))
            same = keys[1:] == keys[:-1]
            many = np.append(same, False) | np.append(False, same)
            if many.any():
                yield from table.filter(pa.array(many)).to_batches()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            keys, ids = np.asarray(table.column(0)), np.asarray(table.column(1))
            sig = np.frombuffer(b"".join(table.column(2).to_pylist()), kind).reshape(-1, width)
            cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            ends = np.append(cuts[1:], len(keys))
            size = ends - cuts
            two = cuts[size == 2]
            near = (sig[two] != sig[two + 1]).sum(1) <= radius
            pairs = [np.stack([np.maximum(ids[two], ids[two + 1]), np.minimum(ids[two], ids[two + 1])], 1)[near]]
            for s, e in zip(cuts[size > 2], ends[size > 2]):
                if found := bucket_links(ids[s:e], sig[s:e], radius):
                    pairs.append(np.array(found, np.int64))
            both = np.unique(np.concatenate(pairs), axis=0)
            if len(both):
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    keyed = nodes.select("node", "sig").mapInArrow(index, "bucket long, node long")
    meet = keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(shared, "bucket long, node long")
    meet = meet.join(nodes, "node").select("bucket", "node", "sig")
    links = meet.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(verify, "a long, b long")
    label = components(materialize(links, "links"))
    member = by_row.join(nodes, "sig", "left").join(label, "node", "left")
    member = member.select("doc_id", "key", "rows", F.coalesce("label", "node").alias("label"))
    alone, grouped = member.where("label IS NULL"), member.where("label IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("key").alias("key"))).alias("first")
    heads = grouped.groupBy("label").agg(first, F.sum("rows").alias("group_size"))
    joined = grouped.join(heads, "label").select(
        "doc_id", "key", F.col("first.id").alias("rep_id"), "group_size", (F.col("key") == F.col("first.key")).alias("keep"), "rows"
    )
    return joined.unionByName(alone.select("doc_id", "key", F.col("doc_id").alias("rep_id"), F.col("rows").alias("group_size"), F.lit(True).alias("keep"), "rows"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The documents without the near copies: of each group the first stays. All columns are kept."""
    key = fresh(docs, "row_key")
    found = materialize(groups(docs, doc_id=doc_id, text=text, **settings).where("NOT keep OR rows > 1").select("key", "keep", "rows"), "groups")
    keyed = docs.withColumn(key, row_key(doc_id, text))
    gone = found.where("NOT keep").select(F.col("key").alias(key))
    left = keyed.join(gone, key, "left_anti")
    again = found.where("keep AND rows > 1").select(F.col("key").alias(key))
    if not again.limit(1).count():
        return left.drop(key)
    once = left.join(again, key, "left_semi").dropDuplicates([key])
    return left.join(again, key, "left_anti").unionByName(once).drop(key)
