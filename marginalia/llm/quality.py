"""Quality classifier: histogram gradient-boosted trees over document statistics.

Two models (quality, toxicity) are fitted on the same bounded sample of labelled rows
(MAX_LABELLED, lowest hash of the id first): features are cut into at most BINS quantile
bins, trees grow level by level from bincount histograms of gradients, and the fitted trees
are flattened into arrays that one vectorised numpy loop per level traverses for a whole
batch.  The statistics of a text are counts over its bytes and dictionary-coded words, plus
the hits of two lists that are learnt from the sample: words, and stems of STEMS letters (so
that inflected forms count), whose presence is significantly tied to a label.

Defined results: a null or empty text has all statistics 0 and is scored like any other
text without words, quality not above 0.5 (there is nothing to keep), so it is rejected.
Rows with a null label or id are not used for fitting; of labels of one id that contradict
each other the lower quality and the higher toxicity count.  Without labels of both classes a
model gives its prior.  Repeated rows get equal scores; equal gains take the first feature
and bin.  A score of exactly the threshold keeps.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import Tokens, buffers, lowered, materialize, segment_sum, sliced, text_array

MAX_LABELLED = 20_000
BINS, TREES, DEPTH, RATE, L2, MIN_LEAF = 64, 60, 4, 0.2, 1.0, 20
MIN_QUALITY, MAX_TOXICITY = 0.5, 0.5
#: Documents of the sample that must hold a word, and the z-score of its tie to a label, for the lists.
MIN_DOCS, MIN_Z, MIN_SHARE = 8, 5.0, 0.8
STEMS = (4, 5, 6, 7, 8)

_CLASS = np.full(256, 7, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[list(range(97, 123))] = 1
_CLASS[list(range(65, 91))] = 2
_CLASS[list(range(48, 58))] = 3
_CLASS[[46, 44, 59, 58, 33, 63, 39, 45]] = 4
_CLASS[[c for c in range(33, 127) if _CLASS[c] == 7]] = 5
_CLASS[128:] = 6
FEATURES = (
    "log_bytes", "log_words", "mean_word", "space", "lower", "upper", "digit", "stop", "symbol", "beyond_ascii", "control", "lines",
    "distinct", "top_word", "repeat_next", "long_words", "toxic_hits", "toxic_rate", "poor_hits", "poor_rate",
)


def word_stats(column: pa.Array):
    tokens = Tokens(lowered(column))
    codes, words = tokens.encode()
    return tokens, codes, words


def forms(word: str) -> list[str]:
    """The word and its stems, marked by a dash."""
    return [word, *(word[:k] + "-" for k in STEMS if len(word) > k)]


def listed(words: list[str], terms: set[str]) -> np.ndarray:
    """Whether each word or a stem of it is in the list."""
    out = np.zeros(len(words), bool)
    if terms:
        starts = {t[: STEMS[0]] for t in terms}
        out[:] = [w[: STEMS[0]] in starts and any(f in terms for f in forms(w)) for w in words]
    return out


def features(column: pa.Array, toxic: set[str], poor: set[str]) -> np.ndarray:
    """One row of FEATURES per text."""
    raw, offs = buffers(column)
    n = len(column)
    size = np.maximum(np.diff(offs), 1).astype(float)
    kinds = _CLASS[raw]
    shares = [segment_sum((kinds == k).view(np.uint8), offs, np.int64) / size for k in range(8)]
    lines = segment_sum((raw == 10).view(np.uint8), offs, np.int64)
    tokens, codes, words = word_stats(column)
    first, count = tokens.first, np.diff(tokens.first)
    many = np.maximum(count, 1).astype(float)
    length = (tokens.ends - tokens.starts).astype(np.int64)
    owner = tokens.texts()
    distinct, top = np.zeros(n), np.zeros(n)
    if len(codes):
        pair = np.sort(owner * (int(codes.max()) + 1) + codes)
        cut = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        times, whose = np.diff(np.append(cut, len(pair))), pair[cut] // (int(codes.max()) + 1)
        distinct = np.bincount(whose, minlength=n).astype(float)
        starts = np.searchsorted(whose, np.arange(n))
        full = np.flatnonzero(count > 0)
        top[full] = np.maximum.reduceat(times, starts[full])
    again = np.zeros(len(codes), np.int64)
    again[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    plain = words.to_pylist() if toxic or poor else [""] * len(words)
    bad, low = listed(plain, toxic), listed(plain, poor)
    bad_hits = segment_sum(bad[codes].astype(np.int64), first)
    low_hits = segment_sum(low[codes].astype(np.int64), first)
    return np.stack(
        [
            np.log1p(np.diff(offs)), np.log1p(count), segment_sum(length, first) / many, shares[0], shares[1], shares[2], shares[3], shares[4], shares[5], shares[6], shares[7], lines / size,
            distinct / many, top / many, segment_sum(again, first) / many, segment_sum((length > 20).astype(np.int64), first) / many, bad_hits, bad_hits / many, low_hits, low_hits / many,
        ],
        axis=1,
    )


class Forest:
    """Boosted trees for log loss. Flattened: feature, cut, left, right, value of all nodes, and each tree's root."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH):
        p = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.prior, self.depth = float(np.log(p / (1 - p))), depth
        self.nodes: list[tuple[int, float, int, int, float]] = []
        self.roots: list[int] = []
        if len(y) and 0 < y.mean() < 1:
            self._fit(x, y, trees)
        flat = list(zip(*self.nodes)) if self.nodes else [[], [], [], [], []]
        self.feature, self.left, self.right = (np.array(flat[i], np.int64) for i in (0, 2, 3))
        self.cut, self.value = (np.array(flat[i], float) for i in (1, 4))
        self.roots = np.array(self.roots, np.int64)

    def _fit(self, x: np.ndarray, y: np.ndarray, trees: int) -> None:
        n, width = x.shape
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
        margin = np.full(n, self.prior)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            tree: list[list] = [[-1, 0.0, 0, 0, 0.0]]
            open_ = [0]
            for level in range(self.depth + 1):
                place = np.full(len(tree), -1)
                place[open_] = np.arange(len(open_))
                slot = place[node]
                live = np.flatnonzero(slot >= 0)
                k = len(open_)
                g = np.bincount(slot[live], grad[live], k)
                h = np.bincount(slot[live], hess[live], k)
                for s, t in enumerate(open_):
                    tree[t][4] = -RATE * g[s] / (h[s] + L2)
                if level == self.depth:
                    break
                best = [(1e-6, -1, -1)] * k
                for f in range(width):
                    key = slot[live] * BINS + binned[live, f]
                    hg = np.bincount(key, grad[live], k * BINS).reshape(k, BINS).cumsum(1)
                    hh = np.bincount(key, hess[live], k * BINS).reshape(k, BINS).cumsum(1)
                    hn = np.bincount(key, minlength=k * BINS).reshape(k, BINS).cumsum(1)
                    rg, rh, rn = hg[:, -1:] - hg, hh[:, -1:] - hh, hn[:, -1:] - hn
                    gain = hg**2 / (hh + L2) + rg**2 / (rh + L2) - hg[:, -1:] ** 2 / (hh[:, -1:] + L2)
                    gain[(hn < MIN_LEAF) | (rn < MIN_LEAF)] = -1
                    for s, b in enumerate(gain.argmax(1)):
                        if gain[s, b] > best[s][0] and b < len(cuts[f]):
                            best[s] = (gain[s, b], f, int(b))
                next_open = []
                for s, (_, f, b) in enumerate(best):
                    if f < 0:
                        continue
                    t, l = open_[s], len(tree)
                    tree[t][:4] = [f, float(cuts[f][b]), l, l + 1]
                    tree += [[-1, 0.0, 0, 0, 0.0], [-1, 0.0, 0, 0, 0.0]]
                    rows = live[slot[live] == s]
                    node[rows] = np.where(binned[rows, f] <= b, l, l + 1)
                    next_open += [l, l + 1]
                open_ = next_open
                if not open_:
                    break
            base = len(self.nodes)
            self.roots.append(base)
            for i, (f, c, l, r, v) in enumerate(tree):
                self.nodes.append((max(f, 0), c if f >= 0 else np.inf, base + l if f >= 0 else base + i, base + r if f >= 0 else base + i, v))
            margin += np.array([t[4] for t in tree])[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        margin = np.full(len(x), self.prior)
        if len(self.roots) and len(x):
            rows = np.arange(len(x))[:, None]
            node = np.repeat(self.roots[None, :], len(x), 0)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            margin += self.value[node].sum(1)
        return 1 / (1 + np.exp(-margin))


def tied_words(found: list, n: np.ndarray) -> set[str]:
    """Words whose document frequency in class 1 is significantly above that in class 0. found: (word, in class 0, in class 1)."""
    out = set()
    for word, a, b in found:
        pool = (a + b) / n.sum()
        spread = np.sqrt(max(pool * (1 - pool) * (1 / max(n[0], 1) + 1 / max(n[1], 1)), 1e-12))
        z = (b / max(n[1], 1) - a / max(n[0], 1)) / spread
        if z >= MIN_Z and b >= MIN_SHARE * (a + b):
            out.add(word)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """text, quality, toxic of at most `limit` labelled documents."""
    spread = F.xxhash64(F.col("doc_id").cast("string"), F.lit(29))
    usable = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    one = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = one.orderBy(spread, "doc_id").limit(limit)
    return materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "quality", "toxic"), "labelled")


class Model:
    def __init__(self, quality: Forest, toxicity: Forest, toxic: set[str], poor: set[str]):
        self.quality, self.toxicity, self.toxic, self.poor = quality, toxicity, toxic, poor

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        x = features(column, self.toxic, self.poor)
        quality = self.quality.predict(x)
        quality[x[:, 1] == 0] *= 0.5
        return quality, self.toxicity.predict(x)


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model:
    sample = labelled_sample(docs, labels, limit)

    def holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0):
            tokens, codes, words = word_stats(text_array(batch.column(0)))
            term_of: dict[str, int] = {}
            each = [[term_of.setdefault(t, len(term_of)) for t in forms(w)] for w in words.to_pylist()]
            size, widths = max(len(term_of), 1), np.array([len(e) for e in each], np.int64)
            flat, at = np.array([t for e in each for t in e], np.int64), np.append(0, np.cumsum(widths))
            reach = widths[codes]
            spot = np.repeat(at[codes] - (np.cumsum(reach) - reach), reach) + np.arange(reach.sum())
            pair = np.unique(np.repeat(tokens.texts(), reach) * size + flat[spot])
            doc, term = pair // size, pair % size
            kinds = [np.asarray(batch.column(k)).astype(np.int64)[doc] for k in (1, 2)]
            table = [np.bincount(term, w, size).astype(np.int64)[: len(term_of)] for w in (np.ones(len(term)), kinds[1], 1 - kinds[0])]
            yield pa.RecordBatch.from_arrays([pa.array(list(term_of), pa.string()), *(pa.array(t) for t in table)], ["word", "n", "toxic", "poor"])

    counted = sample.mapInArrow(holds, "word string, n long, toxic long, poor long").groupBy("word")
    counted = counted.agg(*(F.sum(c).alias(c) for c in ("n", "toxic", "poor"))).where(F.col("n") >= MIN_DOCS).toArrow()
    counted = list(zip(*(counted[c].to_pylist() for c in ("word", "n", "toxic", "poor"))))
    totals = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.coalesce(F.sum(1 - F.col("quality")), F.lit(0)).alias("p")).collect()[0]
    toxic = tied_words([(w, n - t, t) for w, n, t, _ in counted], np.array([totals["n"] - totals["t"], totals["t"]]))
    poor = tied_words([(w, n - q, q) for w, n, _, q in counted], np.array([totals["n"] - totals["p"], totals["p"]]))
    names = [f"f{i}" for i in range(len(FEATURES))]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0):
            x = features(text_array(batch.column(0)), toxic, poor)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), batch.column(1).cast(pa.int64()), batch.column(2).cast(pa.int64())], [*names, "quality", "toxic"])

    table = sample.mapInArrow(describe, ", ".join(f"{c} double" for c in names) + ", quality long, toxic long").toPandas()
    table = table.sort_values(names + ["quality", "toxic"], kind="stable")
    x = table[names].to_numpy(float).reshape(-1, len(names))
    return Model(Forest(x, table["quality"].to_numpy(float)), Forest(x, table["toxic"].to_numpy(float)), toxic, poor)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, quality, toxicity, keep for every document."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            quality, toxicity = model.score(text_array(batch.column(1)))
            keep = (quality >= MIN_QUALITY) & (toxicity < MAX_TOXICITY)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(quality, 6)), pa.array(np.round(toxicity, 6)), pa.array(keep)], ["doc_id", "quality", "toxicity", "keep"])

    return source.mapInArrow(run, f"doc_id {kind}, quality double, toxicity double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    """doc_id, quality, toxicity of the documents that the classifier keeps."""
    return score(docs, train(docs, labels), **names).where("keep").drop("keep")
