"""Substring dedup with suffix automata of reference shards.

A span of at least MIN_TOKENS white-space tokens that an earlier document (by id) holds is
removed.  Streaming every document through the automaton of every shard would be quadratic,
so the automata are sent only where they can match: winnowed K-gram fingerprints (window
MIN_TOKENS - K + 1) are selected alike wherever the same MIN_TOKENS tokens occur, hence any
two documents that share such a span share a selected fingerprint.  A fingerprint that two
documents hold names a reference shard; both send the stretch around it there.  A shard's
documents pass in order: each is streamed through the automaton of those before it for
matching statistics, and all spans where the statistic reaches MIN_TOKENS are marked; then
its unmatched stretches are added.  A shard that more than HOT fingerprint hits name (a licence,
say) isn't streamed through one automaton: every window of MIN_TOKENS tokens of its stretches
is hashed, and the first document of each window is found by an aggregate that combines before
it shuffles; later holders lose the window.  Both ways mark the same spans, up to collisions of
64-bit hashes.  No shard, document or span is capped.

Defined results: null, empty and shorter texts are untouched.  A span goes from its first
token to the token after it, so the text keeps the white space before the span; a text that
is covered wholly becomes empty.  Matches within one document don't count.  Rows that repeat
another (same id, same text) are one document and get the same result.  Of equal ids the
lower row key is earlier; null ids come last.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import SOLID_BYTES, Tokens, buffers, hash_strings, materialize, mix, row_key, sliced, text_array

MIN_TOKENS, K = 50, 16
#: Rows of keys (8 or 16 bytes each), or rows and spans together, up to which they are broadcast rather than shuffled.
MAX_BROADCAST = 500_000
#: Fingerprint hits of a shard over which its windows are hashed rather than passed through one automaton.
HOT = 5_000

_COEFFICIENTS = mix(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)


def hashed_tokens(column: pa.Array) -> tuple[np.ndarray, Tokens]:
    tokens = Tokens(column, SOLID_BYTES)
    codes, words = tokens.encode()
    return hash_strings(words)[codes], tokens


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over x[i : i + width] for each i; past the end only what is there."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[: len(x) - step] = pick(out[: len(x) - step], out[step:].copy())
        have += step
    return out


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k values from each place on; past the end of what is there."""
    out = np.zeros(len(h), np.uint64)
    for j in range(min(k, len(h))):
        out[: len(h) - j] += h[j:] * _COEFFICIENTS[j % len(_COEFFICIENTS)]
    return mix(out)


def winnow(h: np.ndarray, first: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and fingerprints that winnowing selects in each text of at least `least` tokens."""
    n = len(h)
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram = run_hashes(h, k) | np.uint64(1)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    low = _sliding(gram, least - k + 1, np.minimum)
    low[left < least] = 0
    high = _sliding(low[::-1], least - k + 1, np.maximum)[::-1]
    chosen = np.flatnonzero((high == gram) & (left >= k))
    return chosen, gram[chosen]


class Automaton:
    """Suffix automaton of token sequences; each is added with the initial state as its start."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, tokens: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in tokens:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is not None:
                copy = len(nxt)
                nxt.append(nxt[q].copy())
                link.append(link[q])
                length.append(length[last] + 1)
                link[q] = copy
                p = last
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                last = copy
                continue
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(nxt)
                    nxt.append(nxt[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[new] = copy
                    while p != -1 and nxt[p].get(c) == q:
                        nxt[p][c] = copy
                        p = link[p]
            last = new

    def statistics(self, tokens: list[int]) -> list[int]:
        """Length of the longest match that ends at each token."""
        nxt, link, length = self.next, self.link, self.length
        out, v, l = [], 0, 0
        for c in tokens:
            to = nxt[v].get(c)
            while to is None and v:
                v = link[v]
                l = length[v]
                to = nxt[v].get(c)
            if to is not None:
                v = to
                l += 1
            out.append(l)
        return out


def _merge(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open intervals with ascending starts."""
    if not len(starts):
        return []
    reach = np.maximum.accumulate(ends)
    cut = np.flatnonzero(np.append(True, starts[1:] > reach[:-1]))
    return list(zip(starts[cut].tolist(), reach[np.append(cut[1:], len(starts)) - 1].tolist()))


class Shard:
    """One reference shard while its documents pass in order."""

    def __init__(self, least: int):
        self.least, self.automaton, self.whole, self.fresh = least, Automaton(), set(), True

    def take(self, stretches: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
        """Spans of one document, given its stretches (start, tokens), that earlier documents hold; then adds it."""
        spans, news, least = [], [], self.least
        for start, raw in stretches:
            n = len(raw) // 8
            if raw in self.whole:
                spans.append((start, start + n))
                continue
            news.append(raw)
            tokens = np.frombuffer(raw, np.int64)
            if self.fresh:
                continue
            stat = np.array(self.automaton.statistics(tokens.tolist()))
            ends = np.flatnonzero(stat >= least) + 1
            spans += [(start + a, start + b) for a, b in _merge(np.minimum.accumulate((ends - stat[ends - 1])[::-1])[::-1], ends)]
            missing = np.flatnonzero(stat[least - 1 :] < least)
            news[-1] = [raw, [tokens[a:b].tolist() for a, b in _merge(missing, missing + least)]]
        for new in news:
            raw, parts = (new, [np.frombuffer(new, np.int64).tolist()]) if isinstance(new, bytes) else new
            self.whole.add(raw)
            for part in parts:
                self.automaton.add(part)
        self.fresh = False
        return spans


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df


def repeated_spans(docs: DataFrame, least: int = MIN_TOKENS, k: int = K, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """key, spans (first token, token after the last): what earlier documents hold of each document."""
    k = min(k, least)
    source = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("key"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            h, tokens = hashed_tokens(text_array(batch.column(1)))
            at, prints = winnow(h, tokens.first, k, least)
            owner = np.searchsorted(tokens.first, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), batch.column(0).take(pa.array(owner)), pa.array((at - tokens.first[owner]).astype(np.int32))], ["print", "key", "pos"])

    prints = materialize(source.select("key", "text").mapInArrow(fingerprints, "print long, key long, pos int"), "fingerprints")
    shared = prints.groupBy("print").agg(F.min("key").alias("shard"), F.max("key").alias("other")).where("shard <> other").select("print", "shard")
    hits = materialize(prints.join(shared, "print").select("key", "shard", "pos"), "hits")
    crowded = hits.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("shard")

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            h, tokens = hashed_tokens(text_array(batch.column(2)))
            h = h.view(np.int64)
            rows, shards, starts, parts = [], [], [], []
            lists = batch.column(3)
            offs, flat = np.asarray(lists.offsets), lists.values
            shard_of, pos_of = np.asarray(flat.field(0)), np.asarray(flat.field(1)).astype(np.int64)
            for row in range(batch.num_rows):
                a, b = offs[row], offs[row + 1]
                shard, pos = shard_of[a:b], pos_of[a:b]
                base, n = tokens.first[row], tokens.first[row + 1] - tokens.first[row]
                order = np.lexsort((pos, shard))
                shard, pos = shard[order], pos[order]
                cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
                for c, d in zip(cuts, np.append(cuts[1:], len(shard))):
                    for s, e in _merge(np.maximum(pos[c:d] - (least - k), 0), np.minimum(pos[c:d] + least, n)):
                        if e - s >= least:
                            rows.append(row)
                            shards.append(int(shard[c]))
                            starts.append(s)
                            parts.append(h[base + s : base + e].tobytes())
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards, pa.int64()), batch.column(0).take(take), batch.column(1).take(take), pa.array(starts, pa.int32()), pa.array(parts, pa.binary())], ["shard", "doc_id", "key", "start", "tokens"]
            )

    def sent(some: DataFrame) -> DataFrame:
        """The stretches of the documents around their hits."""
        routes = materialize(some.groupBy("key").agg(F.collect_set(F.struct("shard", "pos")).alias("routes")), "routes")
        concerned = source.join(_small(routes.select("key")), "key", "left_semi").dropDuplicates(["key"])
        return concerned.join(routes, "key").select("doc_id", "key", "text", "routes").mapInArrow(stretches, f"shard long, doc_id {kind}, key long, start int, tokens binary")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4):
            raw, offs = buffers(batch.column(4))
            first = offs // 8
            count = np.maximum(np.diff(first) - least + 1, 0)
            row = np.repeat(np.arange(batch.num_rows), count)
            at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            w = run_hashes(raw.view(np.uint64), least)[first[:-1][row] + at].view(np.int64)
            start = np.asarray(batch.column(3)).astype(np.int64)[row] + at
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(w), batch.column(1).take(take), batch.column(2).take(take), pa.array(start.astype(np.int32))], ["w", "doc_id", "key", "s"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows that touch, sorted, as one span. (One that a batch cuts comes as two, which are merged with the document's others.)"""
        for batch in batches:
            key, s = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (s[1:] > s[:-1] + least))[: len(key)])
            last = np.append(cut[1:], len(key)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(key[cut]), pa.array(s[cut]), pa.array((s[last] + least).astype(np.int32))] if len(key) else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int32())], ["key", "s", "e"])

    def repeated_windows(some: DataFrame) -> DataFrame:
        """key, s, e of the windows that an earlier document holds."""
        every = materialize(sent(some).mapInArrow(windows, f"w long, doc_id {kind}, key long, s int"), "windows")
        owner = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
        several = every.groupBy("w").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("w")
        several = materialize(every.join(_small(several), "w"), "shared-windows")
        owners = several.groupBy("w").agg(owner).select("w", F.col("first.key").alias("owner"))
        late = several.join(_small(owners), "w").where("key <> owner").select("key", "s")
        return late.repartition("key").sortWithinPartitions("key", "s").mapInArrow(runs, "key long, s int, e int")

    crowded = materialize(crowded, "crowded")
    some_crowded = bool(crowded.limit(1).count())
    cold = hits.join(_small(crowded), "shard", "left_anti") if some_crowded else hits
    ordered = sent(cold).repartition("shard").sortWithinPartitions("shard", F.col("doc_id").isNull(), "doc_id", "key", "start")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = key = state = None
        waiting: list[tuple[int, bytes]] = []
        out: list[tuple[int, int, int]] = []

        def flush() -> None:
            if waiting:
                out.extend((key, s, e) for s, e in state.take(waiting))
                waiting.clear()

        def batch_of() -> pa.RecordBatch:
            k_, s_, e_ = zip(*out) if out else ((), (), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(k_, pa.int64()), pa.array(s_, pa.int32()), pa.array(e_, pa.int32())], ["key", "s", "e"])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in (0, 2, 3, 4))
            for b, k_, s, t in zip(*columns):
                if b != shard or k_ != key:
                    flush()
                if b != shard:
                    shard, state = b, Shard(least)
                key = k_
                waiting.append((s, t))
            yield batch_of()
        flush()
        yield batch_of()

    found = ordered.mapInArrow(match, "key long, s int, e int")
    if some_crowded:
        found = found.unionByName(repeated_windows(hits.join(_small(crowded), "shard", "left_semi")))
    return found.groupBy("key").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def remove_repeats(docs: DataFrame, least: int = MIN_TOKENS, k: int = K, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, text without repeated spans, n_tokens before, removed tokens, for every document."""
    spans = materialize(repeated_spans(docs, least, k, doc_id, text, hot), "spans")
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), row_key(doc_id, text).alias("key"))
    kind = source.schema["doc_id"].dataType.simpleString()
    whole = spans.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("spans")).collect()[0]
    held = F.broadcast(spans) if whole["rows"] + whole["spans"] <= MAX_BROADCAST else spans
    joined = source.join(held, "key", "left").select("doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            column = text_array(batch.column(1))
            tokens = Tokens(column, SOLID_BYTES)
            count = np.diff(tokens.first)
            gone, texts = np.zeros(len(column), np.int64), None
            hit = np.flatnonzero(np.asarray(batch.column(2).is_valid()))
            if len(hit):
                texts = batch.column(1).to_pylist()
                raw = tokens.raw
                for row in hit:
                    pairs = sorted((p["s"], p["e"]) for p in batch.column(2)[int(row)].as_py())
                    base, end = tokens.first[row], tokens.offsets[row + 1]
                    parts, at = [], int(tokens.offsets[row])
                    for s, e in _merge(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])):
                        parts.append(raw[at : tokens.starts[base + s]].tobytes())
                        at = int(tokens.starts[base + e]) if e < count[row] else int(end)
                        gone[row] += e - s
                    parts.append(raw[at:end].tobytes())
                    texts[row] = b"".join(parts).decode()
                    if gone[row] == count[row]:
                        texts[row] = ""
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1) if texts is None else pa.array(texts, pa.string()), pa.array(count.astype(np.int32)), pa.array(gone.astype(np.int32))], ["doc_id", "text", "n_tokens", "removed"]
            )

    return joined.mapInArrow(cut, f"doc_id {kind}, text string, n_tokens int, removed int")
