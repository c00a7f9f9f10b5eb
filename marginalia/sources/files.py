"""Plain files: texts, and the headers of sound files."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.schema import uid_column


def read_texts(spark: SparkSession, path: str, pattern: str = "*.txt", encoding: str = "utf-8") -> DataFrame:
    """doc_id, text, metadata(path_to_text) of every file; the id depends on the path alone."""
    if encoding.lower().replace("-", "") == "utf8":
        # Bytes decoded in one piece keep every line end; files are read by the executors, one row each.
        rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", F.decode("content", "UTF-8").alias("text"))
    else:
        raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [c.decode(encoding) for c in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["path", "text"])

        rows = raw.mapInArrow(decode, "path string, text string")
    return rows.select(uid_column(F.lit("text-file"), F.col("path")).alias("doc_id"), "text", F.create_map(F.lit("path_to_text"), "path").alias("metadata"))


AUDIO = "path string, sample_rate int, nb_channels int, nb_samples long"


def wav_header(content: bytes) -> tuple[int, int, int] | None:
    """Rate, channels and samples of a RIFF file, or None for another format."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            return w.getframerate(), w.getnchannels(), w.getnframes()
    except (wave.Error, EOFError):
        return None


def read_sounds(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """doc_id, audio(path, sample_rate, nb_channels, nb_samples): headers only; samples stay in the files."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *(wav_header(c) or (None, None, None))) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            names = [f.split()[0] for f in AUDIO.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64()))], names)

    rows = raw.mapInArrow(heads, AUDIO)
    return rows.select(uid_column(F.lit("audio-file"), F.col("path")).alias("doc_id"), F.struct("path", "sample_rate", "nb_channels", "nb_samples").alias("audio"))


def read_samples(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """doc_id, sample_rate, signal (one array of floats per channel) of 16-bit files."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with wave.open(io.BytesIO(c)) as w:
                    x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()).T / 32768.0
                    yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([w.getframerate()], pa.int32()), pa.array([x.astype(np.float32).tolist()], pa.list_(pa.list_(pa.float32())))], ["path", "sample_rate", "signal"])

    rows = raw.mapInArrow(load, "path string, sample_rate int, signal array<array<float>>")
    return rows.select(uid_column(F.lit("audio-file"), F.col("path")).alias("doc_id"), "sample_rate", "signal")
