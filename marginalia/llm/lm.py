"""Language-model scoring with a causal self-attention model trained in numpy on subword ids.

Texts are encoded once into piece ids, kept as a table in the shared folder.  Piece counts over
all documents give the output classes (frequent pieces have their own, the others share
classes of about equal mass) and the probability of a piece in its class.  The output is
factored: a softmax over GROUPS groups of classes times one over the MEMBERS classes of the
target's group, so a token costs GROUPS + MEMBERS exponentials for GROUPS * MEMBERS classes.
With one head of full width the projection of keys only multiplies that of queries, and that
of values the output's, so the products are single matrices (A and O) and keys and values are
the inputs themselves.

Every window of every document trains the model, once.  Documents are dealt by hash to ROUNDS
rounds and, in a round, to replicas; each replica goes through its windows with Adam from the
same weights, the replicas are averaged by their windows, and the next round starts from the
average.  Replicas and the steps of each grow with the square root of the input, so more text
means more fitting.

Scoring: a text is cut into windows that score STRIDE tokens each and see the OVERLAP inputs
before them as well (start symbols in front of a text), so every token is scored once, with at
least OVERLAP tokens of context where the text has them.  Windows of a batch go through
masked attention together.

Defined results: log_prob is the mean natural logarithm a token, perplexity its exponential.
A null or empty text has 0 tokens and null scores.  Repeated rows get equal scores (up to
rounding at ROUND decimals).  A table without tokens keeps the untrained weights, whose output
is the class frequencies.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import buffers, keep_heap, materialize, mix, row_key, sliced, text_array
from marginalia.llm.pieces import SLICE, BestSegmenter, Vocabulary, encode_batch, segmenter

WINDOW, OVERLAP, WIDTH, HIDDEN, GROUPS, MEMBERS, INPUTS = 32, 8, 16, 32, 16, 16, 8192
STRIDE, CLASSES = WINDOW - OVERLAP, GROUPS * MEMBERS
BATCH, RATES = 256, (2e-2, 8e-3, 2e-3)
#: Windows of one replica and round where there are no more; n times as many make sqrt(n) replicas.
WINDOWS_PER_REPLICA = 16_384
#: Bytes of piece ids whose windows are put in an order by hash together.
POOL = 1 << 20
ROUND = 4
SHAPES = {
    "P": (WINDOW, WIDTH), "A": (WIDTH, WIDTH), "O": (WIDTH, WIDTH), "W": (WIDTH, HIDDEN), "c": (HIDDEN,), "V": (HIDDEN, WIDTH),
    "G": (WIDTH + 1, GROUPS), "U": (GROUPS, WIDTH + 1, MEMBERS), "E": (INPUTS + 1, WIDTH),
}
#: Where each part lies in the vector of all weights; E is the last.
PLACES = dict(zip(SHAPES, np.cumsum([0, *(int(np.prod(s)) for s in SHAPES.values())])))
SIZE = PLACES["E"] + int(np.prod(SHAPES["E"]))
_MASK = (np.arange(WINDOW) <= np.arange(OVERLAP, WINDOW)[:, None]).astype(np.float32)


def fold(ids: np.ndarray) -> np.ndarray:
    """Input row of each piece: frequent pieces (low ids) have their own, the others share."""
    half = INPUTS // 2
    return np.where(ids < half, ids, half + ids % half)


def output_classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each piece, log probability of the piece in its class, log frequency of the classes."""
    counts = counts + 0.5
    order = np.lexsort((np.arange(len(counts)), -counts))
    own = CLASSES // 2
    cls = np.zeros(len(counts), np.int64)
    cls[order[:own]] = np.arange(own)
    rest = np.sort(order[own:])
    mass = np.cumsum(counts[rest])
    cls[rest] = own + np.minimum((mass - counts[rest] / 2) / mass[-1] * (CLASSES - own), CLASSES - own - 1).astype(np.int64)
    total = np.bincount(cls, counts, CLASSES)
    return cls.astype(np.int16), np.log(counts / total[cls]), np.log(np.maximum(total, 1e-9) / total.sum())


def parts(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The weights by name, as views of the vector of all."""
    return {k: flat[PLACES[k] : PLACES[k] + int(np.prod(s))].reshape(s) for k, s in SHAPES.items()}


def start(bias: np.ndarray) -> np.ndarray:
    """The vector of the untrained weights: nearly the class frequencies."""
    rng = np.random.default_rng(11)
    flat = np.zeros(SIZE, np.float32)
    m = parts(flat)
    for k in "EPAOWVGU":
        m[k][...] = rng.normal(size=SHAPES[k]) * (0.1 if k in "EP" else 1 / np.sqrt(SHAPES[k][0]) if k in "OWV" else 0.1 if k == "A" else 0.02)
    table = bias.reshape(GROUPS, MEMBERS)
    top = table.max(1, keepdims=True)
    groups = top[:, 0] + np.log(np.exp(table - top).sum(1))
    m["G"][-1] = groups
    m["U"][:, -1] = table - groups[:, None]
    return flat


def _apart(total: np.ndarray) -> bool:
    """Whether sums of exponentials are so far from 1 that their rows must be shifted by the largest logit first (or are no numbers)."""
    return total.size > 0 and not (total.min() > 1e-25 and total.max() < 1e25)


def attention(m: dict[str, np.ndarray], inputs: np.ndarray):
    """What the scored positions of windows of inputs (n, WINDOW) see, and what its gradient needs."""
    n = len(inputs)
    x = m["E"].take(inputs, axis=0)
    x += m["P"]
    xq = x[:, OVERLAP:].reshape(-1, WIDTH)
    q = (xq @ m["A"]).reshape(n, STRIDE, WIDTH)
    s = np.matmul(q, x.transpose(0, 2, 1))
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(s, out=s)
        s *= _MASK
        total = s.reshape(-1, WINDOW) @ np.ones((WINDOW, 1), s.dtype)
    if _apart(total):
        s = np.where(_MASK > 0, np.matmul(q, x.transpose(0, 2, 1)), -np.inf)
        s -= s.max(-1, keepdims=True)
        np.exp(s, out=s)
        total = s.sum(-1).reshape(-1, 1)
    a = np.matmul(s, x).reshape(-1, WIDTH)
    a /= total
    h = a @ m["O"]
    h += xq
    return h, (x, xq, q, s, total, a)


def output(m: dict[str, np.ndarray], h: np.ndarray, cls: np.ndarray):
    """Log probability of the class of each target for what its position sees, in the order of the targets' groups.

    A row of `both` has the logits over the groups and, after them, over the classes of the target's group (as many): one
    product a group.
    """
    groups = (cls // MEMBERS).astype(np.uint8)
    order = np.argsort(groups, kind="stable")
    groups, h = groups[order], h.take(order, axis=0)
    first = np.arange(len(h)) * (GROUPS + MEMBERS)
    aims = first + groups, first + GROUPS + cls.take(order) % MEMBERS
    cuts = [0, *np.searchsorted(groups, np.arange(1, GROUPS, dtype=np.uint8)).tolist(), len(h)]
    z = h @ m["W"]
    wide = z.reshape(-1, STRIDE * HIDDEN)
    wide += np.tile(m["c"], STRIDE)
    np.maximum(z, np.zeros_like(z), out=z)
    g = np.empty((len(h), WIDTH + 1), h.dtype)
    np.add(h, z @ m["V"], out=g[:, :WIDTH])
    g[:, WIDTH] = 1
    tables = np.concatenate([np.broadcast_to(m["G"], (GROUPS, WIDTH + 1, GROUPS)), m["U"]], axis=2)
    both = np.empty((len(h), GROUPS + MEMBERS), h.dtype)
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        np.matmul(g[a:b], tables[k], out=both[a:b])
    value = both.ravel().take(aims[0])
    value += both.ravel().take(aims[1])
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(both, out=both)
        sums = (both.reshape(-1, MEMBERS) @ np.ones(MEMBERS, h.dtype)).reshape(-1, 2)
    if _apart(sums):
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            np.matmul(g[a:b], tables[k], out=both[a:b])
        rows = both.reshape(-1, MEMBERS)
        top = rows.max(1, keepdims=True)
        rows -= top
        value -= top.reshape(-1, 2).sum(1)
        np.exp(both, out=both)
        sums = rows.sum(1).reshape(-1, 2)
    value -= np.log(sums[:, 0] * sums[:, 1])
    return value, order, (aims, h, cuts, z, g, tables, both, sums)


def log_classes(m: dict[str, np.ndarray], inputs: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Log probability of the classes (n, STRIDE) that follow in windows of inputs (n, WINDOW)."""
    value, order, _ = output(m, attention(m, inputs)[0], cls.ravel())
    out = np.empty(len(value), value.dtype)
    out[order] = value
    return out.reshape(cls.shape)


def gradient(m: dict[str, np.ndarray], inputs: np.ndarray, cls: np.ndarray, real: np.ndarray, d: dict[str, np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss over the real targets; its gradient goes to `d`, but for E: that is returned as rows and values."""
    h, (x, xq, q, s, total, a) = attention(m, inputs)
    value, order, (aims, h, cuts, z, g, tables, both, sums) = output(m, h, cls.ravel())
    n, kind = len(inputs), h.dtype
    w = real.ravel()[order].astype(kind)
    w /= max(w.sum(), 1)
    loss = -float(value @ w)
    rows = both.reshape(-1, MEMBERS)
    rows *= (w[:, None] / sums).reshape(-1, 1)
    for aim in aims:
        both.ravel()[aim] -= w
    dg, slopes = np.empty((len(h), WIDTH), kind), np.empty_like(tables)
    for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
        np.matmul(g[i:j].T, both[i:j], out=slopes[k])
        np.matmul(both[i:j], tables[k, :WIDTH].T, out=dg[i:j])
    slopes[:, :, :GROUPS].sum(0, out=d["G"])
    d["U"][...] = slopes[:, :, GROUPS:]
    np.matmul(z.T, dg, out=d["V"])
    dz = dg @ m["V"].T
    dz *= z > 0
    np.matmul(h.T, dz, out=d["W"])
    d["c"][...] = np.ones(len(dz), kind) @ dz
    dg += dz @ m["W"].T
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    dh = dg.take(back, axis=0)
    np.matmul(a.T, dh, out=d["O"])
    da = dh @ m["O"].T
    da /= total
    along = np.einsum("ij,ij->i", da, a).reshape(n, STRIDE, 1)
    da = da.reshape(n, STRIDE, WIDTH)
    ds = np.matmul(da, x.transpose(0, 2, 1))
    ds -= along
    ds *= s
    dx = np.matmul(s.transpose(0, 2, 1), da)
    dx += np.matmul(ds.transpose(0, 2, 1), q)
    dq = np.matmul(ds, x).reshape(-1, WIDTH)
    np.matmul(xq.T, dq, out=d["A"])
    dh += dq @ m["A"].T
    dx[:, OVERLAP:] += dh.reshape(n, STRIDE, WIDTH)
    d["P"][...] = dx.sum(0)
    used = np.zeros(INPUTS + 1, bool)
    used[inputs] = True
    rows = np.flatnonzero(used)
    pairs = WIDTH // 2  # two numbers move at a time, as one complex
    place = (np.cumsum(used) - 1)[inputs.ravel()] * pairs
    twice = np.result_type(kind, np.complex64)
    sums_e = np.zeros(len(rows) * pairs, twice)
    np.add.at(sums_e, (place[:, None] + np.arange(pairs)).ravel(), dx.view(twice).ravel())
    return loss, rows, sums_e.view(kind).reshape(-1, WIDTH)


class Trainer:
    """Adam on one replica; of E only the rows of a batch move."""

    def __init__(self, flat: np.ndarray, rate: float):
        self.flat, self.rate, self.steps = flat.astype(np.float32), np.float32(rate), 0
        self.m, self.slope = parts(self.flat), np.zeros(SIZE, np.float32)
        self.d = parts(self.slope)
        self.mean, self.square = np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32)
        self.mean_e, self.square_e = (parts(x)["E"] for x in (self.mean, self.square))

    def _move(self, mean: np.ndarray, square: np.ndarray, g: np.ndarray) -> np.ndarray:
        mean += np.float32(0.1) * (g - mean)
        g *= g
        square += np.float32(0.01) * (g - square)
        root = np.sqrt(square * np.float32(1 / (1 - 0.99**self.steps)))
        root += np.float32(1e-8)
        return mean * (self.rate / np.float32(1 - 0.9**self.steps)) / root

    def step(self, inputs: np.ndarray, cls: np.ndarray, real: np.ndarray) -> float:
        loss, rows, g = gradient(self.m, inputs, cls, real, self.d)
        self.steps += 1
        dense = slice(0, PLACES["E"])
        self.flat[dense] -= self._move(self.mean[dense], self.square[dense], self.slope[dense])
        mean, square = self.mean_e.take(rows, axis=0), self.square_e.take(rows, axis=0)
        self.m["E"][rows] = self.m["E"].take(rows, axis=0) - self._move(mean, square, g)
        self.mean_e[rows], self.square_e[rows] = mean, square
        return loss


class Windows:
    """All windows of the texts of a batch: STRIDE targets each, and the WINDOW inputs that end before the last of them."""

    def __init__(self, flat: np.ndarray, offs: np.ndarray):
        sizes = np.diff(offs)
        count = -(-sizes // STRIDE)
        self.text = np.repeat(np.arange(len(sizes)), count)
        self.begin = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
        self.left = sizes[self.text] - self.begin
        front = OVERLAP + 1  # start symbols before each text
        padded = np.full(len(flat) + front * len(sizes) + WINDOW, INPUTS, np.int64)
        padded[np.arange(len(flat)) + np.repeat((np.arange(len(sizes)) + 1) * front, sizes)] = fold(np.arange(1 << 16)).take(flat)
        self.inputs, self.input_at = sliding_window_view(padded, WINDOW), offs[:-1][self.text] + self.text * front + self.begin
        self.targets, self.target_at = sliding_window_view(np.append(flat, np.zeros(STRIDE, np.int64)), STRIDE), offs[:-1][self.text] + self.begin

    def __len__(self) -> int:
        return len(self.text)

    def take(self, rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, targets and which targets are real."""
        return self.inputs[self.input_at[rows]], self.targets[self.target_at[rows]], np.arange(STRIDE) < self.left[rows, None]


def score_texts(m: dict[str, np.ndarray], cls: np.ndarray, inside: np.ndarray, flat: np.ndarray, offs: np.ndarray, chunk: int = BATCH) -> np.ndarray:
    """Sum of the log probabilities of each text's tokens."""
    windows = Windows(flat, offs)
    out = np.zeros(len(offs) - 1)
    for a in range(0, len(windows), chunk):
        rows = slice(a, a + chunk)
        inputs, targets, real = windows.take(rows)
        value = log_classes(m, inputs, cls[targets]) + inside[targets]
        out += np.bincount(windows.text[rows], (value * real).sum(1), len(out))
    return out


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offs = buffers(column)
    return raw.view(np.uint16).astype(np.int64), offs // 2


def tokenise(docs: DataFrame, vocabulary: Vocabulary, doc_id: str, text: str) -> DataFrame:
    """doc_id, key, ids (16-bit piece ids in one binary)."""
    source = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("key"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()
        segments = segmenter(vocabulary, BestSegmenter)
        for batch in sliced(batches, 2, 4 * SLICE):
            flat, offs, _, _ = encode_batch(text_array(batch.column(2)), segments)
            raw = pa.py_buffer(flat.astype(np.uint16))
            ids = pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer((offs * 2).astype(np.int32)), raw])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], ["doc_id", "key", "ids"])

    return materialize(source.mapInArrow(run, f"doc_id {kind}, key long, ids binary"), "piece-ids")


def count_pieces(tokens: DataFrame, size: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_ids(batch.column(0))[0], minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["piece", "n"])

    out = np.zeros(size, np.int64)
    for r in tokens.select("ids").mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        out[r["piece"]] = r["n"]
    return out


def train(tokens: DataFrame, cls: np.ndarray, bias: np.ndarray, n_tokens: int, rates: tuple[float, ...] = RATES, per_replica: int = WINDOWS_PER_REPLICA) -> np.ndarray:
    """The weights after one pass over all windows, in as many rounds as there are rates."""
    model = start(bias)
    if not n_tokens or not rates:
        return model
    replicas = math.ceil(math.sqrt(n_tokens / STRIDE / len(rates) / per_replica))
    turn = F.pmod(F.xxhash64("key", F.lit("round")), F.lit(len(rates)))
    shape = "slot long, n long, weights binary"

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """BATCH windows at a time; a pool's windows in the order of their hashes."""
        for batch in sliced(batches, 1, POOL):
            windows = Windows(*_ids(batch.column(1)))
            key = np.asarray(batch.column(0)).view(np.uint64)[windows.text]
            order = np.argsort(mix(key + windows.begin.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
            for a in range(0, len(order), BATCH):
                yield windows.take(order[a : a + BATCH])

    def one(slot: int, n: int, weights: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([n], pa.int64()), pa.array([weights.astype(np.float32).tobytes()], pa.binary())], ["slot", "n", "weights"])

    def mean(batches: Iterator[tuple[int, int, bytes]]) -> tuple[int, int, np.ndarray] | None:
        """Slot of the first, number of windows and average of some replicas."""
        slot, seen, total = 0, 0, np.zeros(SIZE)
        for s, k, w in batches:
            slot = slot if seen else s
            total += np.frombuffer(w, np.float32).astype(np.float64) * k
            seen += k
        return (slot, seen, total / seen) if seen else None

    for number, rate in enumerate(rates):

        def fit(batches: Iterator[pa.RecordBatch], model=model, rate=rate) -> Iterator[pa.RecordBatch]:
            keep_heap()
            trainer, seen, slot = Trainer(model, rate), 0, None

            def noted() -> Iterator[pa.RecordBatch]:
                nonlocal slot
                for batch in batches:
                    slot = batch.column(0)[0].as_py() if slot is None and batch.num_rows else slot
                    yield batch

            for inputs, targets, real in batches_of(noted()):
                trainer.step(inputs, cls[targets], real)
                seen += len(inputs)
            if seen:
                yield one(slot, seen, trainer.flat)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if found := mean(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))):
                yield one(*found)

        dealt = tokens.where(turn == number).select("key", "ids").repartition(replicas, "key").sortWithinPartitions("key", "ids")
        found, left = dealt.mapInArrow(fit, shape), replicas
        while left > 32:  # averaged in a tree, so that neither a task nor the driver gets many replicas at once; always in the same order
            left = -(-left // 32)
            found = found.repartition(left, "slot").sortWithinPartitions("slot").mapInArrow(add, shape)
        rows = sorted((r["slot"], r["n"], r["weights"]) for r in found.collect())
        if rows:
            model = mean(iter(rows))[2].astype(np.float32)
    return model


def score(docs: DataFrame, model_file: str | None = None, rates: tuple[float, ...] = RATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_prob, perplexity of every document; without rates the weights stay untrained."""
    vocabulary = Vocabulary(model_file)
    tokens = tokenise(docs, vocabulary, doc_id, text)
    counts = count_pieces(tokens, len(vocabulary.pieces))
    cls, inside, bias = output_classes(counts)
    model = train(tokens, cls, bias, int(counts.sum()), rates)
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()
        m = parts(model)
        for batch in sliced(batches, 1, POOL):
            flat, offs = _ids(batch.column(1))
            n = np.diff(offs)
            mean = np.round(score_texts(m, cls, inside, flat, offs) / np.maximum(n, 1), ROUND)
            none = n == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(mean, mask=none), pa.array(np.round(np.exp(-mean), ROUND), mask=none)], ["doc_id", "n_tokens", "log_prob", "perplexity"]
            )

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens long, log_prob double, perplexity double")
