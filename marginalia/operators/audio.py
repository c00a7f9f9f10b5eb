"""Sound: mixing, levels, rates, voice activity, and transcripts.

A signal is an array of channels of floats; spans are in seconds.  What numbers alone can
express stays in the JVM; resampling and voice activity are numpy kernels on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import gcd
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.kernel import arrow_schema
from marginalia.schema import make_uid, op_id

SIGNAL = "array<array<float>>"
AUDIO_ANN = "doc_id string, uid string, parent_uid string, label string, start double, end double, speaker string, text string"
RATES = (8000, 16000, 32000, 48000)


def downmix(signal: Column, prevent_clipping: bool = True) -> Column:
    """One channel: the sum of all, divided by their number unless clipping is accepted; mono stays as it is."""
    total = F.aggregate(F.slice(signal, F.lit(2), F.greatest(F.size(signal) - 1, F.lit(0))), F.transform(signal[0], lambda x: x.cast("double")), lambda a, c: F.zip_with(a, c, lambda x, y: x + y))
    mixed = F.transform(total, lambda x: x / F.size(signal)) if prevent_clipping else total
    return F.when(F.size(signal) > 1, F.array(mixed)).otherwise(F.transform(signal, lambda c: F.transform(c, lambda x: x.cast("double"))))


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def _deviation(values: Column) -> Column:
    """Population standard deviation of an array, in two passes."""
    n = F.size(values).cast("double")
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"), lambda a: a / n)
    return _bind(mean, lambda m: F.aggregate(values, F.lit(0.0), lambda a, x: a + (x.cast("double") - m) * (x.cast("double") - m), lambda a: F.sqrt(a / n)))


def normalize_power(signal: Column, target: float = 1.0, channel_wise: bool = False) -> Column:
    """Every channel (or the whole) scaled to the target deviation."""
    factor = lambda values: F.lit(target) / (_deviation(values) + F.lit(1e-12))
    if channel_wise:
        return F.transform(signal, lambda c: _bind(factor(c), lambda k: F.transform(c, lambda x: x.cast("double") * k)))
    return _bind(factor(F.flatten(signal)), lambda k: F.transform(signal, lambda c: F.transform(c, lambda x: x.cast("double") * k)))


def sample_at(seconds: Column, rate: Column) -> Column:
    """Index of a time; halves go to the even neighbour."""
    return F.bround(seconds * rate).cast("int")


def trim(signal: Column, rate: Column, start: Column, end: Column) -> Column:
    """The samples between two times; what lies outside the signal is left out."""
    n = F.size(signal[0])
    a = F.least(F.greatest(sample_at(start, rate), F.lit(0)), n)
    b = F.least(F.greatest(sample_at(end, rate), a), n)
    return F.transform(signal, lambda c: F.slice(c, a + 1, b - a))


class Resampler:
    """Another sample rate by a windowed sinc filter in rational steps; `fast` takes a shorter filter."""

    def __init__(self, sample_rate: int, fast: bool = False):
        self.rate, self.width = sample_rate, 8 if fast else 32
        self.op_id = op_id("Resampler", {"rate": sample_rate, "fast": fast})

    def convert(self, x: np.ndarray, rate: int) -> np.ndarray:
        if rate == self.rate or not x.shape[-1]:
            return x
        n_out = -(-x.shape[-1] * self.rate // rate)
        cut = min(1.0, self.rate / rate)
        reach = int(np.ceil(self.width / cut))
        place = np.arange(n_out) * (rate / self.rate)
        base = np.floor(place).astype(int)
        at = base[:, None] + np.arange(-reach + 1, reach + 1)
        t = (place[:, None] - at) * cut
        weight = np.sinc(t) * np.where(np.abs(t) < self.width, 0.5 + 0.5 * np.cos(np.pi * t / self.width), 0) * cut
        inside = (at >= 0) & (at < x.shape[-1])
        return (x[:, np.clip(at, 0, x.shape[-1] - 1)] * (weight * inside)).sum(-1)

    def run(self, sounds: DataFrame) -> DataFrame:
        """The rows (uid, signal, sample_rate) at the new rate."""
        me = self
        kind = sounds.schema["uid"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [me.convert(np.asarray(s, float), r).astype(np.float32).tolist() for s, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.list_(pa.float32()))), pa.array([me.rate] * len(out), pa.int32())], ["uid", "signal", "sample_rate"])

        rate = F.col("sample_rate").cast("int")
        return sounds.select("uid", F.col("signal").cast(SIGNAL).alias("signal"), rate.alias("sample_rate")).mapInArrow(run, f"uid {kind}, signal {SIGNAL}, sample_rate int")

    @property
    def ratio(self) -> Callable[[int], tuple[int, int]]:
        return lambda rate: (self.rate // gcd(self.rate, rate), rate // gcd(self.rate, rate))


def loud(frame: np.ndarray, rate: int, level: float = 1.0) -> bool:
    """The default detector: the frame's power is over a level relative to full scale deviation."""
    return bool(np.sqrt(np.mean(frame * frame)) * 10 > level)


class VoiceDetector:
    """Stretches of speech: a frame detector smoothed by a window that must fill to switch.

    Speech begins when more than `ratio` of the window's frames are voiced, at the window's first
    frame, and ends when more than `ratio` of them aren't, at its last; a switch empties the window.
    """

    def __init__(self, output_label="speech", frame_seconds=0.03, window_frames=10, ratio=0.9, detect: Callable[[np.ndarray, int], bool] = loud, checked_rates: tuple[int, ...] | None = RATES):
        self.label, self.frame, self.window, self.ratio, self.detect, self.rates = output_label, frame_seconds, window_frames, ratio, detect, checked_rates
        self.op_id = op_id("VoiceDetector", {"label": output_label, "frame": frame_seconds, "window": window_frames, "ratio": ratio})

    def stretches(self, x: np.ndarray, rate: int) -> list[tuple[int, int]]:
        """Sample ranges of one channel."""
        size = int(self.frame * rate)
        # A whole number of frames gets one more that is silent; only the last boundary is clamped.
        voiced = [self.detect(np.pad(x[i : i + size], (0, max(0, size - len(x[i : i + size])))), rate) for i in range(0, len(x) + 1, size)]
        out, held, begin = [], [], None
        for i, v in enumerate(voiced):
            held = [*held, (i, v)][-self.window :]
            n = sum(v for _, v in held)
            if begin is None and n > self.ratio * self.window:
                begin, held = held[0][0], []
            elif begin is not None and len(held) - n > self.ratio * self.window:
                out.append((begin * size, (i + 1) * size))
                begin, held = None, []
        if begin is not None:
            out.append((begin * size, len(x)))
        return [(a, min(b, len(x))) for a, b in out]

    def run(self, sounds: DataFrame) -> DataFrame:
        """uid, start, end, label of each stretch of (uid, signal, sample_rate)."""
        me, kind = self, sounds.schema["uid"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, starts, ends = [], [], []
                for n, (signal, rate) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                    if len(signal) != 1 or (me.rates and rate not in me.rates):
                        raise ValueError(f"one channel at one of {me.rates} Hz is needed")
                    for a, b in me.stretches(np.asarray(signal[0], float), rate):
                        rows.append(n)
                        starts.append(a / rate)
                        ends.append(b / rate)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.float64()), pa.array(ends, pa.float64()), pa.array([me.label] * len(rows), pa.string())], ["uid", "start", "end", "label"])

        return sounds.select("uid", F.col("signal").cast(SIGNAL).alias("signal"), F.col("sample_rate").cast("int").alias("sample_rate")).mapInArrow(run, f"uid {kind}, start double, end double, label string")


class Diarizer(Protocol):
    """What a speaker model is called with: one channel and its rate; (start, end, speaker) in seconds."""

    def __call__(self, signal: np.ndarray, rate: int) -> list[tuple[float, float, str]]: ...


class SpeechModel(Protocol):
    """What a transcriber calls: sounds (channels and rate) in, a text of each out."""

    def __call__(self, sounds: list[tuple[np.ndarray, int]]) -> list[str]: ...


class SoundOperation(Protocol):
    """What a pipeline of sounds takes as a step: a name that depends on its settings, and rows to rows."""

    op_id: str

    def run(self, sounds: DataFrame) -> DataFrame: ...


class SpeakerDetector:
    """Speaker turns by a model: diarize(signal, rate) gives (start, end, speaker). The model is loaded once per worker."""

    def __init__(self, load: Callable[[], Diarizer], output_label="turn"):
        self.load, self.label = load, output_label
        self.op_id = op_id("SpeakerDetector", {"label": output_label})

    def run(self, sounds: DataFrame) -> DataFrame:
        load, label, me, schema = self.load, self.label, self.op_id, arrow_schema(AUDIO_ANN)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = load()
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    for n, (a, b, who) in enumerate(model(np.asarray(r["signal"], float), r["sample_rate"])):
                        out.append({"doc_id": r["doc_id"], "uid": make_uid(me, r["uid"], n), "parent_uid": r["uid"], "label": label, "start": r["start"] + a, "end": r["start"] + b, "speaker": who, "text": None})
                yield pa.RecordBatch.from_pylist(out, schema)

        return sounds.select("doc_id", "uid", "signal", "sample_rate", "start").mapInArrow(run, AUDIO_ANN)


class Transcriber:
    """Texts of sounds by a model: transcribe(list of (signal, rate)) gives texts, in batches of `batch_size`."""

    def __init__(self, load: Callable[[], SpeechModel], add_trailing_dot=True, capitalize=True, batch_size=8, sample_rate: int | None = None, mono: bool = False):
        self.load, self.dot, self.capital, self.batch, self.rate, self.mono = load, add_trailing_dot, capitalize, batch_size, sample_rate, mono
        self.op_id = op_id("Transcriber", {"dot": add_trailing_dot, "capitalize": capitalize, "batch": batch_size})

    def finish(self, text: str) -> str:
        text = text.capitalize() if self.capital else text
        return text + "." if self.dot and text and not text.endswith((".", "?", "!")) else text

    def run(self, sounds: DataFrame) -> DataFrame:
        """The rows (…, signal, sample_rate) with the column `text` and without the signal."""
        me = self
        kept = [c for c in sounds.columns if c not in ("signal", "sample_rate", "text")]
        rows = sounds.select(*kept, F.col("signal").cast(SIGNAL).alias("signal"), F.col("sample_rate").cast("int").alias("sample_rate"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = me.load()
            for batch in batches:
                sounds_ = [(np.asarray(s, float), r) for s, r in zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist())]
                if any((me.rate and r != me.rate) or (me.mono and len(s) != 1) for s, r in sounds_):
                    raise ValueError("the model needs another rate, or one channel")
                texts = [me.finish(t) for i in range(0, len(sounds_), me.batch) for t in model(sounds_[i : i + me.batch])]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], [*kept, "text"])

        ddl = ", ".join(f"`{c}` {sounds.schema[c].dataType.simpleString()}" for c in kept)
        return rows.mapInArrow(run, f"{ddl}, text string")


# Transcripts of documents.


def transcript_offsets(segments: DataFrame, doc: str, order: str, text: str = "text", joiner: str = "\n") -> DataFrame:
    """Segments with n_start and n_end, their place in the text that joins the document's segments in order."""
    before = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    body = F.coalesce(F.col(text), F.lit(""))
    start = F.coalesce(F.sum(F.length(body) + len(joiner)).over(before), F.lit(0)).cast("int")
    return segments.withColumn("n_start", start).withColumn("n_end", F.col("n_start") + F.length(body))


def join_transcripts(segments: DataFrame, doc: str, order: str, text: str = "text", joiner: str = "\n") -> DataFrame:
    """doc, text: the segments' texts in order."""
    ordered = F.array_sort(F.collect_list(F.struct(order, F.coalesce(F.col(text), F.lit("")).alias("t_"))))
    return segments.groupBy(doc).agg(F.array_join(F.transform(ordered, lambda x: x.t_), joiner).alias("text"))


def transcribe_documents(segments: DataFrame, doc: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs, text segments and text_audio_spans(doc, t_start, t_end, a_start, a_end) of transcribed segments (start, end, text)."""
    placed = transcript_offsets(segments, doc, "start")
    spans = placed.select(doc, F.col("n_start").alias("t_start"), F.col("n_end").alias("t_end"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    return join_transcripts(segments, doc, "start"), placed, spans


def audio_spans(text_spans: DataFrame, known: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The stretches of sound (a_start, a_end) that overlap each text span (t_start, t_end): an equi join on the document."""
    other = known.select(doc, F.col("t_start").alias("ks"), F.col("t_end").alias("ke"), "a_start", "a_end")
    return text_spans.join(other, doc).where((F.col("t_start") < F.col("ke")) & (F.col("t_end") > F.col("ks"))).drop("ks", "ke")
