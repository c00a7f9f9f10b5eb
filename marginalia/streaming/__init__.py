"""Streaming: the same operators on unbounded tables, windows with late data, and state across batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marginalia.operators import duplicates


def read_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as they come, with the columns of `like`."""
    reader = spark.readStream.schema(like.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def tumbling(events: DataFrame, width: str, late: str | None = None, ts: str = "ts") -> DataFrame:
    """event_type, window_start, n, total; on a stream `late` bounds how long a window waits."""
    rows = events.withWatermark(ts, late) if late else events
    found = rows.groupBy("event_type", F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return found.select("event_type", F.col("w.start").alias("window_start"), "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str | None = None, ts: str = "ts") -> DataFrame:
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy("event_type", F.window(ts, width, step).alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str, late: str | None = None, ts: str = "ts", user: str = "user_id") -> DataFrame:
    """user, session_start, n: events of a user that follow each other within the gap."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("session_start"), "n")


def without_repeats(events: DataFrame, keys: list[str], late: str, ts: str = "ts") -> DataFrame:
    """The first of equal rows; the state forgets keys that are older than `late`."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


_FOUND = "collection_id string, doc_id string, n_start int, n_end int, source_doc_id string, source_start int, source_end int"


def find_duplicates(docs: DataFrame, forget_after_ms: int | None = None, **settings) -> DataFrame:
    """What each document shares with earlier ones of its collection, in the order of arrival.

    `docs` is a stream of (collection_id, doc_id, text); the state holds the texts of a collection
    and is dropped when nothing came for `forget_after_ms`.  A worker keeps the index of a collection
    that it has just seen; another one, or one after a batch that failed, builds it from the state.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = _FOUND.replace(",", "").split()[::2]
        if state.hasTimedOut:
            state.remove()
            return
        ids, texts = (list(x) for x in state.get) if state.exists else ([], [])
        index = duplicates.kept_index(key, ids, texts, settings)
        rows = []
        new = pd.concat(list(frames)).sort_values("doc_id", kind="stable")
        for doc, text in zip(new["doc_id"], new["text"]):
            text = text or ""
            ids.append(doc)
            texts.append(text)
            rows += [(key[0], doc, a, b, ids[source], sa, sb) for a, b, source, sa, sb in index.add(len(ids) - 1, text)]
        duplicates.keep_index(key, ids, index, settings)
        state.update((ids, texts))
        if forget_after_ms:
            state.setTimeoutDuration(forget_after_ms)
        yield pd.DataFrame(rows, columns=names)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget_after_ms else GroupStateTimeout.NoTimeout
    return docs.select("collection_id", "doc_id", "text").groupBy("collection_id").applyInPandasWithState(step, _FOUND, "ids array<string>, texts array<string>", "append", timeout)


def write_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append"):
    """Everything that is there now as Parquet, then stop; a later call goes on from there."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
