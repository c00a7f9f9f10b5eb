"""Exact top-k search by inner product with norm buckets.

Queries are the rows whose id is divisible by `every`; they are searched in all rows.
Vectors are grouped by length (at most BUCKETS quantiles of the norm, the longest first) and
packed in blocks; a bucket takes as many blocks as it needs.  Queries go in groups of at most
about GROUP_BYTES, which every task of a scan over the blocks gets as a broadcast.  A group
scans the bucket of the longest vectors first, which gives a lower bound theta of each
query's k-th best product, then the others: a query meets a block only where its bound can
still be reached, theta <= |q| * max |v|.  Per query and block the local cosine threshold
t = theta / (|q| * max |v|) picks the pruning: above COORDINATE_FROM, vectors must lie in the
feasible interval of the query's largest coordinates; otherwise the prefix of vectors that
are long enough is taken.  What is left is verified by its product.  A task keeps `top` rows
a query, and its bounds grow with them.  The search is exact.

Defined results: score is the product rounded to DIGITS decimals; ties go to the lower id.
A query is not its own neighbour, nor is a row of equal id.  Rows whose id is null or not a
whole number, or whose vector is null, empty, not finite or of another dimension than most,
are neither queries nor neighbours.  Fewer than k others give fewer rows.  Zero vectors have
product 0 with all.  Rows that repeat another (same id, same vector) count once; one of equal
id and another vector is a query and a neighbour of its own.  An empty table, or one without
a query, gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import materialize

TOP, EVERY, BLOCK, BUCKETS, DIGITS = 10, 50, 2048, 64, 8
COORDINATE_FROM, FOCUS = 0.75, 4
#: Bytes of query vectors that are broadcast at once.
GROUP_BYTES = 16 << 20
_MARGIN = 1e-7
#: Pairs whose exact products are taken at once.
_PAIRS = 1 << 16
_FOUND = "q int, neighbor_id long, row long, score double"


def candidates(q: np.ndarray, norm: float, theta: float, vectors: np.ndarray, norms: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Indices of vectors (norms descending) whose product with q can reach theta; a superset of those that do."""
    if not np.isfinite(theta) or theta <= 0 or norm == 0:
        return np.arange(len(norms))
    long = int(np.searchsorted(-norms, -(theta - _MARGIN) / norm, side="right"))
    if long == 0:
        return np.arange(0)
    t = min((theta - _MARGIN) / (norm * norms[0]), 1.0)
    if t < COORDINATE_FROM:
        return np.arange(long)
    direction = q / norm
    keep = None
    for f in np.argsort(-np.abs(direction))[:FOCUS]:
        c = direction[f]
        spread = math.sqrt(max(1 - t * t, 0)) * math.sqrt(max(1 - c * c, 0)) + 1e-9
        col = unit[f, :long] if keep is None else unit[f, keep]
        # Within the angle of t around q lies the axis itself where c > t, and its opposite where c < -t.
        low = -2.0 if c < -t + 1e-9 else c * t - spread
        high = 2.0 if c > t - 1e-9 else c * t + spread
        good = np.flatnonzero((col >= low) & (col <= high))
        keep = good if keep is None else keep[good]
    return keep


def search_block(ids: np.ndarray, queries: np.ndarray, theta: np.ndarray, target_ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, top: int) -> list[tuple[np.ndarray, ...]]:
    """(query, id, row, score) of the `top` best targets of every query that reach theta; targets have descending norms."""
    norms = np.sqrt((vectors * vectors).sum(1))
    q_norm = np.sqrt((queries * queries).sum(1))
    usable = np.isfinite(theta) & (theta > 0) & (q_norm > 0)
    bound = np.where(usable, (theta - _MARGIN) / np.where(q_norm > 0, q_norm, 1), -np.inf)
    local = np.where(usable, bound / max(norms[0], 1e-300), 0)
    reach = np.flatnonzero(~usable | (bound <= norms[0]))
    narrow, wide = reach[local[reach] >= COORDINATE_FROM], reach[local[reach] < COORDINATE_FROM]
    out = []

    def verify(q: np.ndarray, t: np.ndarray) -> None:
        """Exact products of the pairs, which have all pairs of their queries, a slice at a time."""
        parts = [np.einsum("ij,ij->i", queries[q[a : a + _PAIRS]], vectors[t[a : a + _PAIRS]]) for a in range(0, len(q), _PAIRS)]
        score = np.round(np.concatenate(parts), DIGITS) if parts else np.zeros(0)
        mine = (target_ids[t] != ids[q]) & (score >= theta[q] - _MARGIN)
        q, t, score = q[mine], t[mine], score[mine]
        out.append(best_of(q, target_ids[t], rows[t], score, top))

    if len(narrow):
        unit = np.ascontiguousarray((vectors / np.where(norms > 0, norms, 1)[:, None]).T)
        held, count = [], 0
        for q in narrow:
            found = candidates(queries[q], q_norm[q], theta[q], vectors, norms, unit)
            held.append((np.full(len(found), q), found))
            count += len(found)
            if count > _PAIRS or q == narrow[-1]:
                verify(*(np.concatenate(x) for x in zip(*held)))
                held, count = [], 0
    for a in range(0, len(wide), 256):
        part = wide[a : a + 256]
        long = int(np.searchsorted(-norms, -bound[part].min(), side="right"))
        rough = queries[part] @ vectors[:long].T
        rough[ids[part, None] == target_ids[:long]] = -np.inf
        floor = theta[part]
        if long > top:
            floor = np.maximum(floor, np.partition(rough, long - top, axis=1)[:, long - top])
        row, found = np.nonzero(rough >= floor[:, None] - 2 * _MARGIN)
        verify(part[row], found)
    return out


def best_of(q: np.ndarray, t: np.ndarray, row: np.ndarray, score: np.ndarray, top: int) -> tuple[np.ndarray, ...]:
    """The `top` best rows of every query: highest scores, then lowest ids; sorted by query and rank."""
    order = np.lexsort((row, t, -score, q))
    q = q[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    order = order[rank < top]
    return q[rank < top], t[order], row[order], score[order]


class Best:
    """The best rows of the queries in the blocks that a task has seen."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, theta: np.ndarray, top: int):
        self.ids, self.queries, self.theta, self.top = ids, queries, theta.copy(), top
        none = np.zeros(0, np.int64)
        self.held, self.waiting, self.count = (none, none, none, np.zeros(0)), [], 0

    def block(self, target_ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> None:
        found = search_block(self.ids, self.queries, self.theta, target_ids, rows, vectors, self.top)
        self.waiting += found
        self.count += sum(len(f[0]) for f in found)
        if self.count > 2 * self.top * len(self.ids):
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        self.held = best_of(*(np.concatenate(x) for x in zip(self.held, *self.waiting)), self.top)
        self.waiting, self.count = [], 0
        q, score = self.held[0], self.held[3]
        size = np.bincount(q, minlength=len(self.ids))
        full = np.flatnonzero(size >= self.top)
        self.theta[full] = np.maximum(self.theta[full], score[np.cumsum(size)[full] - 1])
        return self.held


def blocks(vectors: DataFrame, vec_id: str, vector: str, block: int, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame, int]:
    """The rows that count (id, v, row); those rows packed in blocks (bucket, ids, rows, data; descending norms, bucket 0 the longest); the dimension."""
    source = vectors.select(F.col(vec_id).try_cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    source = source.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad).dropDuplicates(["id", "v"])
    source = source.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).withColumn("row", F.xxhash64("id", "v"))
    dims = source.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not dims:
        return source, source, 0
    dim, n = dims[0]["d"], dims[0]["n"]
    source = materialize(source.where(F.size("v") == dim), "vectors")
    pieces = max(1, min(buckets, math.ceil(n / block)))
    cuts = sorted(set(source.agg(F.percentile_approx("norm", [i / pieces for i in range(1, pieces)], 100 * pieces)).collect()[0][0])) if pieces > 1 else []
    placed = source.withColumn("bucket", reduce(lambda a, c: a + (F.col("norm") < F.lit(c)).cast("int"), cuts, F.lit(0)))
    sizes = placed.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    placed = placed.join(F.broadcast(sizes), "bucket").withColumn("part", F.pmod("row", F.col("parts")).cast("int"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("norm")).alias("o"), "id", "row", "v")))
    packed = placed.groupBy("bucket", "part").agg(rows.alias("rows"))
    packed = packed.select("bucket", F.col("rows.id").alias("ids"), F.col("rows.row").alias("rows"), F.flatten(F.col("rows.v")).alias("data"))
    return source, materialize(packed.sortWithinPartitions("bucket"), "blocks"), dim


def top_products(vectors: DataFrame, top: int = TOP, every: int = EVERY, block: int = BLOCK, buckets: int = BUCKETS, group_bytes: int = GROUP_BYTES, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, neighbor_id, score, rank: the `top` largest inner products with any row of every row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    source, packed, dim = blocks(vectors, vec_id, vector, block, buckets)
    queries = source.where(F.col("id") % every == 0) if dim else source
    n = queries.count() if dim else 0
    if not n:
        return spark.createDataFrame([], "vec_id long, neighbor_id long, score double, rank int")
    groups = math.ceil(n * dim * 8 / group_bytes)
    best = Window.partitionBy("q").orderBy(F.desc("score"), "neighbor_id", "row")
    done = []
    for group in range(groups):
        table = queries.where(F.pmod(F.xxhash64("row"), F.lit(groups)) == group).select("id", "row", "v").orderBy("id", "row").toArrow()
        if not table.num_rows:
            continue
        ids = np.asarray(table.column("id"))
        matrix = np.asarray(table.column("v").combine_chunks().flatten()).reshape(len(ids), dim)

        def scan(part: DataFrame, theta: np.ndarray, ids=ids, matrix=matrix) -> DataFrame:
            sent = spark.sparkContext.broadcast((ids, matrix, theta))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                found = Best(*sent.value, top)
                for batch in batches:
                    for k in range(batch.num_rows):
                        target_ids, rows, data = (np.asarray(batch.column(c)[k].values) for c in range(3))
                        found.block(target_ids, rows, data.reshape(-1, dim))
                q, t, row, score = found.settle()
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(t), pa.array(row), pa.array(score)], ["q", "neighbor_id", "row", "score"])

            return part.select("ids", "rows", "data").mapInArrow(run, _FOUND)

        none = np.full(len(ids), -np.inf)
        first = materialize(scan(packed.where("bucket = 0"), none).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top), "longest")
        theta = none.copy()
        for r in first.where(F.col("rank") == top).select("q", "score").collect():
            theta[r["q"]] = r["score"]
        rest = scan(packed.where("bucket > 0"), theta)
        whole = first.drop("rank").unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
        names = spark.sparkContext.broadcast(ids)

        def named(batches: Iterator[pa.RecordBatch], names=names) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(names.value[np.asarray(batch.column(0))]), *batch.columns[1:]], ["vec_id", "neighbor_id", "score", "rank"])

        answer = whole.select("q", "neighbor_id", "score", "rank").mapInArrow(named, "vec_id long, neighbor_id long, score double, rank int")
        done.append(materialize(answer, "answers") if groups > 1 else answer)
    return reduce(DataFrame.unionByName, done)
