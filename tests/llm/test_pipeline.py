"""The corpus pipeline and its stages."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        out = spark.read.parquet(str(folder / name))
        found.append((name, docs, out))
        docs = out
    return found


def test_stages_keep_the_columns(run):
    assert [name for name, _, _ in run] == ["language_id", "near_dedup", "decontamination", "sanitisation", "tokenisation"]
    for name, before, after in run[:-1]:
        assert after.dtypes == before.dtypes, name
    assert run[-1][2].columns == [*run[-1][1].columns, "piece_ids"]


def test_exact_copies_and_benchmark_passages_are_gone(run, spark):
    after = run[2][2].toPandas()
    assert not after.text.duplicated().any()
    flat = lambda t: " " + " ".join(t.lower().split()) + " "
    items = [flat(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = run[2][1].toPandas()
    assert not any(i in flat(t) for t in after.text for i in items)
    gone = before[~before.doc_id.isin(after.doc_id)]
    assert 0 < len(gone) < 0.1 * len(before)


def test_sanitised_texts_hold_no_address(run):
    out = run[3][2]
    assert out.where(F.col("text").rlike(r"\w@\w|AKIA[0-9A-Z]{12}|\d{13}")).count() == 0 and out.count() == run[3][1].count()


def test_run_gives_the_last_stage(spark, run):
    out = corpus_pipeline.run(spark, SF)
    want = {r["doc_id"]: r["piece_ids"] for r in run[-1][2].collect()}
    assert {r["doc_id"]: r["piece_ids"] for r in out.collect()} == want


def test_every_stage_takes_odd_tables(spark):
    shape = "doc_id long, text string, lang string, source string, n_chars long, key string"
    odd = [(None, None, None, None, None, "k"), (1, "", "en", "s", 0, "k"), (2, "plain words of a text, and more of them", "en", None, 3, None), (2, "plain words of a text, and more of them", "en", None, 3, None)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, shape)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            assert docs.columns[:6] == ["doc_id", "text", "lang", "source", "n_chars", "key"], name
            docs.collect()
