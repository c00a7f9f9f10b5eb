"""Sharding by vector bin packing.

Groups (a source, or an equal part of a source that takes more than 1 / FINE of a shard) are
sized in bytes, tokens and rows.  Largest first, each is placed in the shard where the dot
product of its size with the shard's residual capacity is highest, among the shards that it
fits.

The groups are packed in pools: a group's hash names its pool, a pool gets its share of the
shards (POOL_SHARDS about), and each pool is packed by one task, so neither the driver nor a
task ever sees all groups, and the work grows with their number.  Up to POOL_SHARDS shards
there is one pool.

Defined results: a null source is a group of its own.  A null text has 0 bytes and tokens and
counts as a row.  Rows that repeat another go to the same shard.  Ties take the group of the
lower source and part, then the lower shard.  Where no shard has room, the one whose tightest
dimension is left best takes the group.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import SOLID_BYTES, Tokens, buffers, materialize, sliced, text_array

SHARD_BYTES, SHARD_ROWS, MIN_SHARDS, POOL_SHARDS = 64 << 20, 1 << 22, 8, 256
#: Groups per shard that a source is cut into at least, and the slack of a shard's capacity.
FINE, SLACK = 8, 0.02
DIMENSIONS = ("bytes", "tokens", "rows")
#: Rows of a table of groups up to which it is broadcast; beyond it the join shuffles.
MAX_BROADCAST = 500_000


def pack(sizes: np.ndarray, n_shards: int, slack: float = SLACK) -> np.ndarray:
    """Shard of each group; sizes has a row per group and a column per dimension."""
    total = sizes.sum(0)
    share = sizes / np.where(total > 0, total, 1)
    left = np.full((n_shards, sizes.shape[1]), (1 + slack) / n_shards)
    out = np.zeros(len(sizes), np.int64)
    for g in np.argsort(-share.max(1), kind="stable"):
        after = left - share[g]
        tight = after.min(1)
        fits = tight >= -1e-12
        value = np.where(fits, left @ share[g], -np.inf) if fits.any() else tight
        out[g] = int(np.argmax(value))
        left[out[g]] = after[out[g]]
    return out


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df


def _in_parts(keyed: DataFrame, owners: DataFrame) -> DataFrame:
    """The rows with the part of their source. Only sources in several parts are joined; those of many rows always by broadcast, as a shuffle would bring them together."""
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), F.coalesce("parts", F.lit(1))).cast("int")
    cut = materialize(owners.where("parts > 1").select("owner", "parts"), "cut-sources")
    if cut.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        return keyed.join(F.broadcast(cut), "owner", "left").withColumn("part", part).drop("parts")
    top = F.broadcast(cut.orderBy(F.desc("parts"), "owner").limit(MAX_BROADCAST // 100))
    hot = keyed.join(top, "owner")
    rest = keyed.join(top.select("owner"), "owner", "left_anti").join(cut, "owner", "left")
    return hot.unionByName(rest).withColumn("part", part).drop("parts")


def assign(
    docs: DataFrame, shard_bytes: int = SHARD_BYTES, min_shards: int = MIN_SHARDS, pool_shards: int = POOL_SHARDS, doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """doc_id, source, part, shard, bytes, tokens for every document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            column = text_array(batch.column(2))
            size, count = np.diff(buffers(column)[1]), np.diff(Tokens(column, SOLID_BYTES).first)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(count)], ["doc_id", "source", "bytes", "tokens"])

    sized = materialize(rows.mapInArrow(measure, f"doc_id {kind}, source string, bytes long, tokens long"), "sizes")
    keyed = sized.withColumn("owner", F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("="), "source")))
    sums = [F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    owners = materialize(keyed.groupBy("owner").agg(*sums), "sources")
    whole = owners.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in DIMENSIONS)).collect()[0]
    if not whole["rows"]:
        return sized.select("doc_id", "source", F.lit(0).alias("part"), F.lit(0).alias("shard"), "bytes", "tokens")
    n_shards = max(min_shards, math.ceil(whole["bytes"] / shard_bytes), math.ceil(whole["rows"] / SHARD_ROWS))
    share = F.greatest(*(F.col(c) / F.lit(max(whole[c], 1)) for c in DIMENSIONS))
    owners = owners.withColumn("parts", F.greatest(F.ceil(share * n_shards * FINE), F.lit(1)).cast("int"))
    cut = _in_parts(keyed, owners)
    n_pools = math.ceil(n_shards / pool_shards)
    groups = cut.groupBy("owner", "part").agg(*sums).withColumn("pool", F.pmod(F.xxhash64("owner", "part"), F.lit(n_pools)).cast("int"))
    groups = materialize(groups, "groups")
    load = groups.groupBy("pool").agg(F.sum(F.greatest(*(F.col(c) / F.lit(max(whole[c], 1)) for c in DIMENSIONS))).alias("load")).orderBy("pool").collect()
    reach = np.cumsum([r["load"] for r in load])
    ends = np.maximum(np.round(reach / reach[-1] * n_shards), np.arange(1, len(load) + 1)).astype(int)
    shards_of = {r["pool"]: (int(a), int(b - a)) for r, a, b in zip(load, np.append(0, ends[:-1]), ends)}

    def place(table: pa.Table) -> pa.Table:
        order = np.lexsort((np.asarray(table.column("part")), np.array(table.column("owner").to_pylist(), object)))
        table = table.take(pa.array(order))
        first, count = shards_of[table.column("pool")[0].as_py()]
        found = pack(np.stack([np.asarray(table.column(c)) for c in DIMENSIONS], 1).astype(float), count) + first
        return pa.table({"owner": table.column("owner"), "part": table.column("part"), "shard": pa.array(found.astype(np.int32))})

    placed = materialize(groups.groupBy("pool").applyInArrow(place, "owner string, part int, shard int"), "placed")
    return cut.join(_small(placed), ["owner", "part"]).select("doc_id", "source", "part", "shard", "bytes", "tokens")
