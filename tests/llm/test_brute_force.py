"""Operators 1, 2, 3 and the pipeline against the naive versions of them, over whole tables."""

import corpus_pipeline
import naive
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.llm import language, pieces, private, quality, registry

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def test_language_against_brute_force(spark, documents):
    """All documents of the small table are fitted on and scored, fragments of them too."""
    model = naive.Backoff([(d["text"], d["lang"]) for d in documents])
    got = {r["doc_id"]: r for r in registry.op2_language_id(spark, SF).collect()}
    assert len(got) == len(documents)
    for d in documents:
        lang, confidence, coverage, keep = model.decide(d["text"])
        r = got[d["doc_id"]]
        assert (r["lang"], r["keep"]) == (lang, keep) and r["coverage"] == pytest.approx(coverage, abs=1e-6)
        assert (r["confidence"] is None) == (confidence is None) and (confidence is None or r["confidence"] == pytest.approx(confidence, abs=1e-3))


def test_language_of_ties_and_unsure_texts(spark):
    """Two labels with the same words tie below the confidence that keeps; words unlike any fall below the coverage."""
    rows = [(1, "alpha beta gamma", "aa"), (2, "alpha beta gamma", "bb"), (3, "alpha beta gamma", "aa"), (4, "alpha beta gamma", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert all(r["lang"] == "und" and not r["keep"] and r["confidence"] == 0.5 and r["coverage"] == 1 for r in found.values())
    model = language.train(docs.where("lang = 'aa'"))
    odd = spark.createDataFrame([(1, "ЖЖЖ ЙЙЙ alpha"), (2, "alpha ЖЖЖ")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in language.identify(odd.withColumn("lang", F.lit(None)), model).collect()}
    assert found[1]["lang"] == "und" and found[1]["coverage"] == pytest.approx(1 / 3, abs=1e-6) and found[2]["lang"] == "aa" and found[2]["coverage"] == 0.5


def test_statistics_against_brute_force(documents):
    toxic, poor = {"the", "ing-", "elec-"}, {"lorem", "stat-"}
    texts = [d["text"] for d in documents][:80] + ["", None, "a a a b", "\x01\x02 é—Ü 12,5", "word" * 30]
    got = quality.features(pa.array(texts).fill_null(""), toxic, poor)
    assert np.allclose(got, [naive.statistics(t, toxic, poor) for t in texts], atol=1e-9)


def test_boosting_against_brute_force():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(260, 3)), 2)
    y = ((x[:, 0] + rng.normal(size=260) * 0.4 > 0.2) ^ (x[:, 1] > 0.5)).astype(float)
    margin = naive.boosted(x, y, 4, 3)
    assert np.allclose(quality.Forest(x, y, 4, 3).predict(x), 1 / (1 + np.exp(-margin)), atol=1e-9)


def test_quality_against_brute_force(spark):
    """The registered query over a whole table: word lists, statistics and scores written out."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["doc_id"] in docs]
    toxic = naive.tied([(docs[r["doc_id"]], r["toxic"]) for r in labels])
    poor = naive.tied([(docs[r["doc_id"]], 1 - r["quality"]) for r in labels])
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert (model.toxic, model.poor) == (toxic, poor)
    x = np.array(sorted([*naive.statistics(docs[r["doc_id"]], toxic, poor), r["quality"], r["toxic"]] for r in labels))
    q, t = (quality.Forest(x[:, :-2], x[:, k]) for k in (-2, -1))
    want = {}
    for doc, text in docs.items():
        row = np.array([naive.statistics(text, toxic, poor)])
        good, bad = q.predict(row)[0] * (0.5 if row[0, 1] == 0 else 1), t.predict(row)[0]
        if good >= quality.MIN_QUALITY and bad < quality.MAX_TOXICITY:
            want[doc] = (good, bad)
    got = {r["doc_id"]: (r["quality"], r["toxicity"]) for r in registry.op1_quality_kept(spark, SF).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[d], want[d], atol=1e-5) for d in got)


def test_labels_that_contradict_each_other(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(3)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (0, 1, 0), (1, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = sorted((r["text"], r["quality"], r["toxic"]) for r in quality.labelled_sample(docs, labels).collect())
    assert got == [("text number 0", 0, 1), ("text number 1", 1, 0)]


@pytest.mark.parametrize("folder", [SF, SF2])
def test_privacy_against_brute_force(spark, folder):
    """PMI, information content and threshold over a whole table, and every text rewritten."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = naive.disclosing(texts.values())
    got = {(r["entity"], r["term"]) for r in private.disclosing_terms(docs).collect()}
    assert got == want and len(want) > 50
    pairs = {}
    for e, t in want:
        pairs.setdefault(e, set()).add((e, t))
    out = {r["doc_id"]: r for r in registry.op3_pii_sanitised(spark, folder).collect()}
    assert sum(r["n_terms"] for r in out.values()) > 0
    assert {d: r["text"] for d, r in out.items()} == {d: naive.sanitised(t, pairs) for d, t in texts.items()}


def test_privacy_counts_beside_columns_of_their_name(spark):
    docs = spark.createDataFrame([(1, "to ann@mail.org", 7, "x")], "doc_id long, text string, n_entities int, n_terms string")
    out = private.sanitise_documents(docs, counts=True)
    assert out.columns == ["doc_id", "text", "n_entities", "n_terms", "n_entities_", "n_terms_"]
    assert tuple(out.collect()[0])[2:5] == (7, "x", 1)


def test_pipeline_against_brute_force(spark, documents):
    """All five stages over the whole small table, none of them with the package's own computation."""
    model = naive.Backoff([(d["text"], d["lang"]) for d in documents])
    kept = []
    for d in documents:
        lang, _, _, keep = model.decide(d["text"])
        if keep:
            kept.append(d | {"lang": lang})
    group = naive.near_groups([d["text"] for d in kept])
    kept = [d for i, d in enumerate(kept) if group[i] == i]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [d for d in kept if not any(naive.holds_item(d["text"], i) for i in items)]
    pairs = {}
    for e, t in naive.disclosing([d["text"] for d in kept]):
        pairs.setdefault(e, set()).add((e, t))
    encoder = naive.Pieces(pieces.Vocabulary())
    want = {}
    for d in kept:
        text = naive.sanitised(d["text"], pairs)
        n = len(text) if private.entities(d["text"]) else d["n_chars"]
        want[d["doc_id"]] = (text, d["lang"], d["source"], n, encoder.encode(text))
    got = {r["doc_id"]: (r["text"], r["lang"], r["source"], r["n_chars"], r["piece_ids"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == want.keys() and 100 < len(got) < len(documents)
    for d in want:
        assert got[d] == want[d], d
