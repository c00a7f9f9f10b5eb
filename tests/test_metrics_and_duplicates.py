import pytest
from pyspark.sql import functions as F

from marginalia.operators import duplicates, metrics


@pytest.mark.parametrize(
    "raters, want",
    [
        (["0100000010", "1110010000"], 0.095),
        (["aabbdcccedda", "babbbcccedd" + "d"], 0.692),
        (["123321412...", "1233224125.3", ".33323422" + "51.", "12332441251."], 0.743),
    ],
)
def test_alpha(spark, raters, want):
    rows = [(i, v) for r in raters for i, v in enumerate(r) if v != "."]
    assert metrics.krippendorff_alpha(spark.createDataFrame(rows, "unit int, value string")).first()["alpha"] == pytest.approx(want, abs=1e-3)


def test_alpha_needs_two_labels(spark):
    row = metrics.krippendorff_alpha(spark.createDataFrame([(0, "a"), (0, "a")], "unit int, value string")).first()
    assert row["alpha"] is None and row["n_labels"] == 1


def test_report_and_kappa(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "y"), (5, "z")], "doc_id int, label string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y"), (4, "y"), (6, "z")], "doc_id int, label string")
    pairs = metrics.join_annotators(a, b)
    rows = {r["label"]: r for r in metrics.classification_report(pairs).collect()}
    assert (rows["x"]["precision"], rows["x"]["recall"]) == (1.0, 0.5) and rows["overall"]["accuracy"] == 0.75
    assert rows["y"]["f1"] == 0.8
    weighted = metrics.classification_report(pairs, "weighted", by_label=False).collect()
    assert len(weighted) == 1 and weighted[0]["recall"] == 0.75
    assert metrics.cohen_kappa(pairs).first()["kappa"] == 0.5
    with pytest.raises(ValueError):
        metrics.classification_report(pairs, "other")


def test_entity_scores_and_accuracy(spark, ents):
    # 26 characters, of which two entities of 8 and 4; one of them isn't found.
    truth, found = ents(("d", "corp", 0, 8), ("d", "lang", 20, 24)), ents(("d", "corp", 0, 8))
    rows = {r["label"]: r for r in metrics.entity_scores(truth, found).collect()}
    assert (rows["overall"]["precision"], rows["overall"]["recall"], rows["overall"]["f1"], rows["overall"]["support"]) == (0.5, 0.5, 0.5, 2)
    assert metrics.entity_scores(truth, found, "micro", False).first()["recall"] == 0.5
    docs = spark.createDataFrame([("d", 26)], "doc_id string, length int")
    assert metrics.tag_accuracy(docs, truth, found).first()["accuracy"] == pytest.approx(22 / 26, abs=1e-6)


def test_tags(ents):
    tags = lambda scheme: [r["tag"] for r in metrics.character_tags(ents(("d", "a", 0, 3), ("d", "b", 5, 6)), scheme).orderBy("pos").collect()]
    assert tags("bilou") == ["B-a", "I-a", "L-a", "U-b"] and tags("iob2") == ["B-a", "I-a", "I-a", "B-b"]
    assert metrics.entity_tags(1, "x") == ["U-x"] and metrics.entity_tags(3, "x", "iob2") == ["B-x", "I-x", "I-x"]
    assert metrics.label_ids(["b", "a"], "iob2") == {"O": 0, "B-a": 1, "I-a": 2, "B-b": 3, "I-b": 4}
    ids = metrics.label_ids(["a"], "iob2")
    assert metrics.align_tags([None, (0, 2), (2, 3), (4, 5)], ["B-a", "I-a", "I-a", "O", "O"], ids) == [-100, 1, 2, 0]
    assert metrics.align_tags([(0, 2), (2, 3)], ["B-a", "I-a", "I-a"], ids, map_subtokens=False) == [1, -100]


def test_chunks_come_back(ents):
    rows = ents(("d", "a", 0, 3), ("d", "a", 3, 4), ("d", "b", 4, 6), ("e", "a", 1, 2))
    back = metrics.chunks_of_tags(metrics.character_tags(rows))
    want = {("d", 0, 3, "a"), ("d", 3, 4, "a"), ("d", 4, 6, "b"), ("e", 1, 2, "a")}
    assert {(r["doc_id"], r["n_start"], r["n_end"], r["label"]) for r in back.collect()} == want


def test_logits(spark):
    rows = spark.createDataFrame([("d", 0, [0.1, 0.9], 1), ("d", 1, [0.8, 0.2], 1), ("d", 2, [1.0, 0.0], -100)], "doc_id string, pos int, logits array<double>, label_id int")
    truth, guess = metrics.tags_of_logits(rows, ["O", "U-a"])
    assert [r["tag"] for r in truth.orderBy("pos").collect()] == ["U-a", "U-a"] and [r["tag"] for r in guess.orderBy("pos").collect()] == ["U-a", "O"]


LINES = ["The heart sounds are regular today", "Nothing else was seen by the team", "A cough persists since last winter", "New line of the second note here", "Unrelated closing of a third note"]


@pytest.fixture
def notes(spark):
    note = lambda *picked: "\n".join(LINES[i] for i in picked)
    rows = [("p", "d1", note(0, 1, 2), "2001"), ("p", "d2", note(0, 2, 3), "2002"), ("p", "d3", note(0, 2, 4), "2003"), ("q", "d4", note(0), "2009")]
    return spark.createDataFrame(rows, "collection_id string, doc_id string, text string, day string")


def test_duplicates(notes):
    rows = duplicates.DuplicateFinder(allow_multiline=False).run(notes).orderBy("doc_id", "n_start").collect()
    assert [(r["doc_id"], r["text"], r["attrs"][0]["metadata"]["source_doc_id"]) for r in rows] == [("d2", LINES[0], "d1"), ("d2", LINES[2], "d1"), ("d3", LINES[0], "d1"), ("d3", LINES[2], "d1")]


def test_rest_and_dates(notes):
    rows = duplicates.DuplicateFinder(segments_to_output="nondup", allow_multiline=False).run(notes, order_by="day").orderBy("doc_id").collect()
    assert [r["text"].strip("\n") for r in rows if r["doc_id"] != "d1"] == [LINES[3], LINES[4], LINES[0]]
    backwards = notes.withColumn("day", (F.lit(3000) - F.col("day").cast("int")).cast("string"))
    rows = duplicates.DuplicateFinder(allow_multiline=False).run(backwards, order_by="day").collect()
    assert {r["doc_id"] for r in rows} == {"d1", "d2"} and all(r["attrs"][0]["metadata"]["source_doc_id"] in ("d3", "d2") for r in rows)


def test_characters_and_case(spark):
    docs = spark.createDataFrame([("c", 1, "abcdefgh"), ("c", 2, "xxABCDEFyy")], "collection_id string, doc_id long, text string")
    op = lambda sense: duplicates.DuplicateFinder(fingerprint_type="char", fingerprint_length=5, case_sensitive=sense).run(docs).collect()
    assert op(True) == [] and [r["text"] for r in op(False)] == ["ABCDEF"]


def test_first_occurrences(spark):
    import random

    random.seed(5)
    words = [f"w{i}" for i in range(500)]
    shared = " ".join(random.sample(words, 20))
    docs = [(i, " ".join(random.sample(words, 15)) + (f" {shared} " if i % 2 else " ") + " ".join(random.sample(words, 15))) for i in range(8)] + [(9, None), (10, "")]
    rows = duplicates.first_occurrences(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    texts = dict(docs)
    assert sorted(r["doc_id"] for r in rows) == [3, 5, 7] and all(r["source_doc_id"] == 1 for r in rows)
    assert all(texts[r["doc_id"]][r["start"] : r["end"]] == shared == texts[1][r["source_start"] : r["source_end"]] for r in rows)
