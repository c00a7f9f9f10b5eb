"""Operations on whole batches: the same rows as segment by segment, without work in proportion to what isn't asked for."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.functions import spans as S
from marginalia.operators import cleaning, kernel, matching, segmentation
from marginalia.operators.kernel import TextOperation

NORM = matching.Norm("kb", "1")
OPERATIONS = [
    cleaning.CharReplacer("clean", {"ß": "ss", "-": "", "’": "'", "]": "^"}),
    cleaning.RegexpReplacer("clean", [("(a)(b)?", "<x>"), (r"[0-9]+", ""), (r"[ \t]+", " "), ("", "+")]),
    cleaning.RegexpReplacer("clean", [(r"[0-9]+", "<n>"), (r"[ \t]+", ""), ("", "+")]), cleaning.RegexpReplacer("clean", [("b|ß", " ")]),
    segmentation.SectionTokenizer({"a": ["Head", "Head of", "ß"], "b": ["b"]}, rules=[segmentation.RenameRule("a", "c", ("b",))], keep_empty=True),
    segmentation.SentenceTokenizer(attrs_to_copy=["section"]), segmentation.SentenceTokenizer(keep_punct=True, split_on_newlines=False),
    segmentation.SyntagmaTokenizer([r"\band\b", ", "], attrs_to_copy=["section"]), segmentation.RuleSentenceTokenizer(keep_newlines=False),
    matching.RegexpMatcher([matching.RegexpRule(r"\d+", "number", norms=(NORM,), term="n", id="r1"), matching.RegexpRule("(b)s", "B", index_extract=1, case_sensitive=False, exclusion="zz", id="r2")], attrs_to_copy=["section"]),
]


def shown(anns):
    return sorted((r.asDict(recursive=True) for r in anns.collect()), key=str)


def slow(operation, anns):
    """Segment by segment."""
    return TextOperation.run(operation, anns)


def test_equal_rows(raw):
    """Each operation on raw texts and on what a cleaner, sections and sentences have made of them."""
    rng = random.Random(5)
    texts = ["", " ", "ß", "Head of b", "-", *("".join(rng.choices(["Head", " of ", "b", "ß", "-", " and ", "12", ". ", "\n", "’", "ab", "bs", ", ", " ", "𝄞", "]"], k=rng.randrange(1, 30))) for _ in range(40))]
    start = raw(*texts)
    inputs = [start]
    for step in (OPERATIONS[0], OPERATIONS[4], OPERATIONS[1], OPERATIONS[5]):
        inputs.append(start.sparkSession.createDataFrame(slow(step, inputs[-1]).toArrow()))
    for operation in OPERATIONS:
        for anns in (inputs[0], inputs[1], inputs[-2], inputs[-1]):
            got, want = operation.run(anns), slow(operation, anns)
            assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
            assert shown(got) == shown(want), operation.name


def test_ids_are_made_when_asked_for(raw):
    """Ids, attributes and spans are expressions after the kernel, so a query without them doesn't have them made."""
    anns = matching.RegexpMatcher([matching.RegexpRule("a", "x", norms=(NORM,))]).run(raw("a b"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    assert "sha2" in plan(anns.select("uid")) and "sha2" not in plan(anns.select("doc_id", "n_start", "n_end", "text"))


def test_spans_do_not_count_as_objects(monkeypatch):
    """Parts of a text with many replacements: no walk along the spans for each part, and no object a span."""
    import pyarrow as pa

    n = 20_000
    text = "ß1. " * n
    monkeypatch.setattr(S, "cut", None)
    monkeypatch.setattr(S, "to_rows", None)
    make = OPERATIONS[0]._batch()
    table = lambda base, spans, t: kernel.SpanTable(pa.array([base], pa.int32()), spans, np.array([len(t)]))
    _, _, _, out, (spans, low, high), _ = make([text], lambda: table(7, pa.nulls(1, kernel.SPANS), text))
    assert out == ["ss1. " * n] and len(spans[0]) == 2 * n and (low[0].as_py(), high[0].as_py()) == (7, 7 + len(text))
    row, *_, (parts, low, high), _ = segmentation.SentenceTokenizer()._batch()(out, lambda: table(None, spans, out[0]))
    assert len(row) == n and low.to_pylist() == [7 + 4 * i for i in range(n)] and all(len(p) == 2 for p in parts[:50])


def test_sections_by_one_pattern():
    table = {w: w for w in ("ab", "ab cd", "_x", " y", "é", "a.b")}
    text = "ab cd ab cde xab ab. _x é éé  y a.b a.bc"
    assert segmentation.find_keywords(text, table, 5) == [("ab cd", 0, 5), ("ab", 6, 8), ("ab", 17, 19), ("_x", 21, 23), ("é", 24, 25), ("a.b", 32, 35)]


def test_spans_must_fit(raw):
    anns = raw("abc").withColumn("text", F.lit("ab"))
    with pytest.raises(Exception, match="as long as the text"):
        OPERATIONS[0].run(anns.withColumn("spans", F.transform("spans", lambda s: s.withField("length", F.lit(3)).withField("replaced", F.array().cast(f"array<{kernel.RANGE}>"))))).collect()


def test_edges_in_one_pass(raw):
    """The edges of annotations and of their attributes come from one pass over the operation."""
    from marginalia.plans import provenance

    rule = matching.RegexpRule("[ab]", "x", norms=(NORM,))
    anns = matching.RegexpMatcher([rule]).run(raw("a b", "c"))
    edges = provenance.edges_of(anns, "op")
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = sorted((r["kind"], r["item_uid"], r["source_uid"], r["op_id"]) for r in edges.collect())
    rows = anns.collect()
    assert got == sorted([("annotation", r["uid"], r["parent_uid"], "op") for r in rows] + [("attribute", r["attrs"][0]["uid"], r["uid"], "op") for r in rows]) and len(got) == 4


def test_roots_of_a_web(spark, monkeypatch):
    """Items of several origins, repeated edges and paths of all lengths, with the sources broadcast and shuffled."""
    from marginalia.plans import provenance

    pairs = [("c", "a"), ("c", "b"), ("d", "c"), ("d", "c"), ("d", "a"), ("e", "d"), ("f", "e"), ("x", None), ("b", None)]
    edges = spark.createDataFrame(pairs, "item_uid string, source_uid string")
    want = {(i, r) for i in "cdef" for r in "ab"}
    for bound in (100, 0):
        monkeypatch.setattr(provenance, "MAX_SOURCES", bound)
        assert sorted((r[0], r[1]) for r in provenance.roots(edges, 4).collect()) == sorted(want)
        assert sorted((r[0], r[1]) for r in provenance.roots(edges, 1).collect()) == sorted({p for p in pairs if p[1]})
    plan = provenance.roots(edges, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1  # all hops are among the sources


def test_gates():
    """A rule is left out only where its end can't occur; the sentences stay."""
    tails = {r"\b(?:a|b\.c)\.(?=\s*[a-z])": r"\.(?=\s*[a-z])", r"a\.+": None, r"a|b\.": None, r"[.]a": None, r"(?:a\.)b": None, r"(a)\.\1": None, r"[]\].|]x\.": r"\.", r"(?i)a\.": None}
    for pattern, tail in tails.items():
        got = segmentation.gate(pattern)
        assert (got and got.pattern) == tail, pattern
    rules = segmentation.RuleSentenceTokenizer.DEFAULT
    assert sum(segmentation.gate(p) is not None for p, _ in rules) >= 6
    text = "Dr. Who cf. that. 12.5 mg. e.g. so. J. Smith 10 min. later\n\nab. Cd... ef 1.2.3 sept. 4"
    for p, _ in rules:
        if (needed := segmentation.gate(p)) is not None:
            assert all(needed.search(text[: k + 9]) for k in (m.end() for m in __import__("re").finditer(p, text[:])))


def test_candidates_that_can_be_similar():
    """Few candidates stay, and all that are similar to a term are among them."""
    from marginalia.functions import text as T

    rng = random.Random(3)
    terms = ["hypertension", "diabete", "ab cd", "éa", "oo", "aaaa"]
    grams = [T.ngrams(T.to_ascii(t)) for t in terms]
    known, sizes = frozenset().union(*grams), list(map(len, grams))
    filters = [matching.TermFilter(list(map(list, grams)), None, 0, 0), matching.TermFilter(None, known, min(sizes), max(sizes)), matching.TermFilter(None, None, min(sizes), max(sizes))]
    texts = [" ".join(rng.choices(["hypertension", "hypertensions", "Diabète", "ab", "cd", "the", "oo", "aaaaaaaa", "x", "дa", "İab", "tension,", "word"], k=20)) for _ in range(60)]
    every = left = 0
    for text in texts:
        for t in (0.0, 0.3, 0.6, 0.8, 1.0):
            strict, some, loose = (set(matching.similar_ranges(text, 2, 50, f, t)) for f in filters)
            whole = T.candidate_ranges(text, 2, 50)
            alike = {(a, b) for a, b in whole if any(T.similarity(T.ngrams(T.to_ascii(text[a:b]).lower()), g) >= t for g in grams)}
            assert alike <= strict <= some <= loose <= set(whole)
            every, left = every + len(whole) * (t == 0.8), left + len(some) * (t == 0.8)
    assert left < every / 2
    plain = ["hypertension word " * 10, "the x word tension " * 10]
    assert [sum(len(list(matching.similar_ranges(p, 3, 50, f, 0.8))) for p in plain) for f in filters[:2]] == [10, 20]  # hypertension; tension has only known grams


@pytest.mark.parametrize("bound", [10**6, 0])
def test_candidates_written(raw, monkeypatch, bound):
    """The table of candidates has those that are similar, not all runs of tokens; what is found is the same without the filter."""
    tables = {}
    keep = matching.written
    monkeypatch.setattr(matching, "written", lambda df, name: tables.setdefault(name, keep(df, name)))
    segments = raw(*["a word hypertension of the Hypertensions, word " * 3, "nothing", "ÉHYPERTENSION"])
    entries = segments.sparkSession.createDataFrame([("C1", "hypertension", ["DISO"])], "cui string, term string, semgroups array<string>")
    monkeypatch.setattr(matching, "MAX_GRAMS", bound)
    got = sorted((r["doc_id"], r["n_start"], r["text"]) for r in matching.TerminologyJoin(0.8).run(segments, entries).collect())
    assert got[:2] == [("0", 7, "hypertension"), ("0", 27, "Hypertensions")] and len(got) == 7
    assert tables["candidates"].count() == 7 or bound == 0


@pytest.mark.parametrize("top", [1, 5, 40])
def test_best_products_by_tiles(monkeypatch, top):
    """Tiles give what a sort of all products gives, ties and all, and never hold all products."""
    monkeypatch.setattr(matching, "TERMS_AT_ONCE", 64)
    rng = np.random.default_rng(2)
    rows, data = rng.integers(-2, 3, (30, 3)) / 3, rng.integers(-2, 3, (1500, 3)) / 3
    rows[3], data[700], data[2] = np.nan, np.nan, np.nan
    for n in (1, 7, 600, 1500):
        s = np.round(rows @ data[:n].T, 4)
        want = np.argsort(-s, axis=1, kind="stable")[:, :top]
        score, place = matching.best_products(rows, data[:n], top)
        assert (place == want).all() and np.array_equal(score, np.take_along_axis(s, want, 1), equal_nan=True)
    import tracemalloc

    rows, data = rng.normal(size=(256, 8)), rng.normal(size=(60_000, 8))
    tracemalloc.start()
    matching.best_products(rows, data, top)
    assert tracemalloc.get_traced_memory()[1] < 256 * 60_000 * 2  # all products would take 8 bytes each, more than once
    tracemalloc.stop()


def test_shared_runs_in_one_shuffle(spark, monkeypatch):
    """Ids that are integers go packed through one shuffle of fingerprints; those of texts are joined: the same runs."""
    from marginalia.operators import duplicates

    rng = random.Random(9)
    words = ["a", "b", "c", "d,", "e"]
    stock = [" ".join(rng.choices(words, k=12)) for _ in range(6)]
    docs = [(n if n % 9 else None, None if n == 7 else " ".join(rng.choices([*stock, *words], k=rng.randrange(0, 9)))) for n in range(60)]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    got = duplicates.first_occurrences(df, 3)
    want = duplicates.first_occurrences(df.withColumn("doc_id", F.lpad(F.col("doc_id").cast("string"), 3, "0")), 3)
    show = lambda df: sorted(tuple(map(int, r)) for r in df.collect())
    assert show(got) == show(want) and len(show(got)) > 50 and got.schema["doc_id"].dataType.simpleString() == "int"
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    monkeypatch.setattr(duplicates, "PRINTS_AT_ONCE", 50)
    assert show(duplicates.first_occurrences(df, 3)) == show(want)
    assert duplicates.first_occurrences(df.limit(0), 3).count() == 0
