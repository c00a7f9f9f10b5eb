"""Language ID by word-first backoff.

A known word contributes its log frequency in each language; an unseen word is covered by
character n-grams, at every position the longest one that the training words hold (4 down
to 1).  The model is fitted on a bounded, documented sample of labelled rows (`per_language`
documents a language, lowest hash of the id first); every document is then scored in full.

Defined results: a null or empty text, or one without letters, gets language 'und',
score null, coverage 0 and keep false.  So does (with its confidence and coverage) a text whose
confidence is below MIN_CONFIDENCE, or of whose words less than MIN_COVERAGE are known or
covered by n-grams of two letters or more; exactly the threshold keeps.  Ties go to the
language that sorts first (and two equal languages are below the confidence that keeps).  Repeated
rows get equal results.  An empty table gives an empty result.  Rows with a null label are
scored but not used for fitting.  When no labelled row exists every document is 'und'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import Tokens, lowered, segment_sum, sliced, text_array

#: Labelled documents per language that the model is fitted on, at most.
PER_LANGUAGE = 1000
LONGEST = 4
#: Occurrences that a word or n-gram needs in the sample to be known.
MIN_WORD, MIN_GRAM = 2, 3
MIN_CONFIDENCE, MIN_COVERAGE = 0.6, 0.5
_OPEN, _CLOSE = "\x02", "\x03"


def _grams(words: list[str]):
    """For n = 4..1: packed key at each position of the padded words, and whether it fits; plus word starts."""
    text = "".join(_OPEN + w.replace(_OPEN, "").replace(_CLOSE, "") + _CLOSE for w in words)
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 0xFFFF).astype(np.uint64)
    starts = np.flatnonzero(codes == 2)
    ends = np.append(starts[1:], len(codes))
    room = np.repeat(ends, ends - starts) - np.arange(len(codes))
    for n in range(LONGEST, 0, -1):
        key = codes.copy()
        for k in range(1, n):
            key[: len(codes) - k] |= codes[k:] << np.uint64(16 * k)
        yield n, key, room >= n, starts


class Model:
    """Arrays of log frequencies: words (sorted, with one row of scores each) and n-grams by length."""

    def __init__(self, counts: dict[tuple[str, str], int] | pa.Table):
        if isinstance(counts, dict):
            rows = [(lang, word, n) for (lang, word), n in counts.items()]
            counts = pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate((("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())))})
        parts = []
        for name in ("lang", "word"):
            coded = counts[name].combine_chunks().dictionary_encode()
            values = coded.dictionary.to_pylist()
            order = sorted(range(len(values)), key=values.__getitem__)
            place = np.zeros(len(values), np.int64)
            place[order] = np.arange(len(order))
            parts += [[values[i] for i in order], place[np.asarray(coded.indices)] if len(values) else np.zeros(0, np.int64)]
        self.languages, lang_at, words, word_at = parts
        table = np.zeros((len(words), len(self.languages)))
        np.add.at(table, (word_at, lang_at), np.asarray(counts["n"]))
        self.grams = {}
        for n, keys, sums in self._count_grams(words, table):
            known = sums.sum(1) >= MIN_GRAM
            self.grams[n] = keys[known], self._log(sums[known], sums.sum(0))
        known = table.sum(1) >= MIN_WORD
        self.words = {w: i for i, w in enumerate(np.array(words, object)[known])}
        self.scores = self._log(table[known], table.sum(0))

    @staticmethod
    def _count_grams(words: list[str], table: np.ndarray, chunk: int = 20_000):
        """n, distinct keys and their counts by language; words in chunks, as the driver holds little memory."""
        found: dict[int, list] = {}
        for a in range(0, len(words), chunk):
            part, weights = words[a : a + chunk], table[a : a + chunk]
            for n, key, fits, starts in _grams(part):
                owner = np.repeat(np.arange(len(part), dtype=np.int32), np.diff(np.append(starts, len(key))))[fits]
                keys, at = np.unique(key[fits], return_inverse=True)
                found.setdefault(n, []).append((keys, np.stack([np.bincount(at, weights[owner, j], len(keys)) for j in range(table.shape[1])], 1)))
        for n, parts in found.items():
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            sums = np.zeros((len(keys), table.shape[1]))
            np.add.at(sums, at, np.concatenate([c for _, c in parts]))
            yield n, keys, sums

    @staticmethod
    def _log(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
        return np.log((counts + 0.1) / (totals + 1.0)).astype(np.float32)

    def score_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores by language, and whether a known word or an n-gram of 2 or more letters supports them."""
        width = len(self.languages)
        out, seen = np.zeros((len(words), width), np.float32), np.zeros(len(words), bool)
        if not width or not words:
            return out, seen
        index = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        known = index >= 0
        out[known], seen[known] = self.scores[index[known]], True
        rest = np.flatnonzero(~known)
        if len(rest):
            total = support = open_ = None
            for n, key, fits, starts in _grams([words[i] for i in rest]):
                if total is None:
                    total, support = np.zeros((len(key), width), np.float32), np.zeros(len(key), bool)
                    open_ = np.ones(len(key), bool)
                keys, table = self.grams.get(n, (np.zeros(0, np.uint64), None))
                todo = np.flatnonzero(open_ & fits)
                if not len(keys) or not len(todo):
                    continue
                spot = np.minimum(np.searchsorted(keys, key[todo]), len(keys) - 1)
                hit = keys[spot] == key[todo]
                total[todo[hit]] = table[spot[hit]]
                support[todo[hit]] = n > 1
                open_[todo[hit]] = False
            first = np.append(starts, len(total))
            size = np.maximum(np.diff(first), 1)
            out[rest] = segment_sum(total, first) / size[:, None]
            seen[rest] = segment_sum(support.astype(np.int32), first) * 2 >= size
        return out, seen


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on at most `per_language` documents of each label."""
    spread = F.xxhash64(F.col(doc_id).cast("string"), F.lit(17))
    rows = docs.select(F.col(lang).alias("lang"), spread.alias("h")).where("lang IS NOT NULL AND h IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    limits = rows.withColumn("r", rank).where(F.col("r") <= per_language).groupBy("lang").agg(F.max("h").alias("h")).collect()
    if not limits:
        return Model({})
    chosen = F.lit(False)
    for row in limits:
        chosen = chosen | ((F.col(lang) == row["lang"]) & (spread <= row["h"]))
    sample = docs.where(chosen).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            tokens = Tokens(lowered(text_array(batch.column(1))))
            codes, words = tokens.encode()
            langs = batch.column(0).dictionary_encode()
            size = max(len(words), 1)
            pair = np.asarray(langs.indices).astype(np.int64)[tokens.texts()] * size + codes
            keys, n = np.unique(pair, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pc.take(langs.dictionary, pa.array(keys // size)), pc.take(words, pa.array(keys % size)), pa.array(n, pa.int64())], ["lang", "word", "n"]
            )

    counted = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return Model(counted.toArrow())


def score_batch(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index of the best language (-1: none), its confidence, margin a word, coverage, for each text."""
    tokens = Tokens(lowered(column))
    codes, words = tokens.encode()
    scores, seen = model.score_words(words.to_pylist())
    n = np.diff(tokens.first)
    coverage = segment_sum(seen[codes].astype(np.int64), tokens.first) / np.maximum(n, 1)
    if not model.languages:
        none = np.zeros(len(n))
        return np.full(len(n), -1), none, none, none
    total = segment_sum(scores[codes], tokens.first, np.float64)
    best = total.argmax(1)
    top = total[np.arange(len(n)), best]
    confidence = 1 / np.exp(np.minimum(total - top[:, None], 0)).sum(1)
    rest = total.copy()
    rest[np.arange(len(n)), best] = -np.inf
    margin = (top - rest.max(1)) / np.maximum(n, 1) if len(model.languages) > 1 else np.zeros(len(n))
    return np.where(n > 0, best, -1), confidence, margin, coverage


def _decide(model: Model, column: pa.Array):
    best, confidence, margin, coverage = score_batch(model, column)
    keep = (best >= 0) & (confidence >= MIN_CONFIDENCE) & (coverage >= MIN_COVERAGE)
    names = np.array([*model.languages, "und"], object)
    return names[np.where(keep, best, -1)], np.where(best >= 0, confidence, np.nan), margin, coverage, keep


def identify(docs: DataFrame, model: Model | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, lang (predicted), confidence, coverage, keep for every document."""
    model = model or train(docs, doc_id=doc_id, text=text, lang=lang)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            names, confidence, margin, coverage, keep = _decide(model, text_array(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(np.round(confidence, 6), pa.float64(), from_pandas=True), pa.array(np.round(coverage, 6)), pa.array(keep)],
                ["doc_id", "lang", "confidence", "coverage", "keep"],
            )

    return source.mapInArrow(run, f"doc_id {id_type}, lang string, confidence double, coverage double, keep boolean")


def keep_identified(docs: DataFrame, model: Model | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents whose language was identified, all columns kept, `lang` set to the prediction."""
    model = model or train(docs, text=text, lang=lang)
    at, put = docs.columns.index(text), docs.columns.index(lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            names, _, _, _, keep = _decide(model, text_array(batch.column(at)))
            columns = list(batch.columns)
            columns[put] = pa.array(names, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
