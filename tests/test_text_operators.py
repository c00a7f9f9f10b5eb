"""Segmenters, cleaners, context and matchers on small texts with known answers."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions.patterns import Untranslatable, to_java
from marginalia.operators import cleaning, context, intervals, matching, segmentation
from marginalia.operators.kernel import custom, Found

TEXT = "First phrase with a dot. Then a carriage return\rand a new line\n Any question ? Two;Three! Odd marks?!..."


def found(df, *cols):
    return [tuple(r) for r in df.orderBy("doc_id", "seq").select(*(cols or ("n_start", "n_end", "text"))).collect()]


@pytest.mark.parametrize(
    "settings, want",
    [
        ({}, ["First phrase with a dot", "Then a carriage return", "and a new line", "Any question ", "Two", "Three", "Odd marks"]),
        ({"keep_punct": True}, ["First phrase with a dot.", "Then a carriage return", "and a new line", "Any question ?", "Two;", "Three!", "Odd marks?!..."]),
        ({"split_on_newlines": False}, ["First phrase with a dot", "Then a carriage return\rand a new line\n Any question ", "Two", "Three", "Odd marks"]),
    ],
)
def test_sentences(raw, settings, want):
    rows = found(segmentation.SentenceTokenizer(**settings).run(raw(TEXT)))
    assert [r[2] for r in rows] == want
    assert all(TEXT[a:b] == t for a, b, t in rows)


def test_sentences_without_words_are_left_out(raw):
    assert [r[2] for r in found(segmentation.SentenceTokenizer(keep_punct=True).run(raw("One phrase.  !  ", "", "...")))] == ["One phrase."]


def test_native_sentences_agree(raw):
    docs = raw(TEXT, "é à. 😀 ok! ", "\n\n a;b")
    kernel = [r[0] for r in found(segmentation.SentenceTokenizer().run(docs), "text")]
    native = [r[0] for r in docs.orderBy("doc_id").select(F.explode(segmentation.sentence_texts(F.col("text")))).collect()]
    assert kernel == native


def test_code_points(raw):
    assert found(segmentation.SentenceTokenizer().run(raw("😀 ok. été 😀")))[1] == (6, 11, "été 😀")


def test_syntagmas(raw):
    text = "The patient is well, but he still coughs. No fever"
    rows = found(segmentation.SyntagmaTokenizer([r"\bbut\b", r"(?<=\.)\s"]).run(raw(text)))
    assert rows == [(0, 20, "The patient is well,"), (21, 41, "but he still coughs."), (42, 50, "No fever")]


def test_sections_and_renaming(raw):
    text = "Intro text. History: asthma. Exam: fine. History: again."
    rule = segmentation.RenameRule("history", "anamnesis", ("exam",), "BEFORE")
    op = segmentation.SectionTokenizer({"history": ["History"], "exam": ["Exam"]}, rules=[rule])
    rows = found(op.run(raw(text)), "n_start", "n_end", F.col("metadata")["name"], F.col("attrs")[0].value)
    assert rows == [(0, 11, "head", "head"), (12, 28, "anamnesis", "anamnesis"), (29, 40, "exam", "exam"), (41, 56, "history", "history")]
    assert segmentation.renamed(["a", "x", "a"], [segmentation.RenameRule("a", "b", ("x",), "AFTER")]) == ["a", "x", "b"]


def test_longest_whole_keyword():
    table = {"heart": "a", "heart failure": "b"}
    assert segmentation.find_keywords("heart failure heartily heart", table, 13) == [("b", 0, 13), ("a", 23, 28)]


def test_rule_sentences(raw):
    rows = found(segmentation.RuleSentenceTokenizer().run(raw("Dr. House came at 3.5 h. He left.")), "text")
    assert [r[0] for r in rows] == ["Dr. House came at 3.5 h.", "He left."]


def test_char_and_regexp_replacer(raw):
    row = cleaning.CharReplacer("c", {"œ": "oe", "x": ""}).run(raw("cœurx!")).first()
    assert row["text"] == "coeur!" and (row["n_start"], row["n_end"]) == (0, 6)
    assert [(s["start"], s["length"]) for s in row["spans"]] == [(0, None), (None, 2), (2, None), (5, None)]
    with pytest.raises(ValueError):
        cleaning.CharReplacer("c", {"ab": "c"})
    row = cleaning.RegexpReplacer("c", [(r"(\d)(\d)", "N"), (r"\d", "D")]).run(raw("12 3")).first()
    assert row["text"] == "N D"
    assert cleaning.RegexpReplacer("c", []).run(raw("same")).first()["text"] == "same"


@pytest.mark.parametrize(
    "settings, text, want",
    [
        ({}, "Le patient\nva bien", "Le patient va bien"),
        ({}, "un  deux", "un deux"),
        ({}, "poids 3.5 kg", "poids 3,5 kg"),
        ({}, "A.B", "A B"),
        ({}, "Dr. Paul", "Dr  Paul"),
        ({"keep_endlines": True}, "Fini\nOui", "Fini.\nOui"),
        ({"handle_parentheses_eds": False}, "douleur (forte)", "douleur (forte)"),
        ({}, "douleur (forte)", "douleur ,forte,"),
        ({}, "test (-)", "test  negatif "),
    ],
)
def test_eds_cleaner(raw, settings, text, want):
    row = cleaning.EDSCleaner(**settings).run(raw(text)).first()
    assert row["text"] == want
    at = 0
    for s in row["spans"]:
        n = s["length"] if s["length"] is not None else s["end"] - s["start"]
        if s["length"] is None:
            assert want[at : at + n] == text[s["start"] : s["end"]]
        at += n
    assert at == len(want)


def test_long_parentheses_follow_their_sentence():
    from marginalia.functions.spans import Span

    inner = "with a very long remark that goes on and on"
    text, spans = T.clean_parentheses(f"Start ({inner}) rest.", [Span(0, len(inner) + 14)])
    assert "(" not in text and text.index("rest") < text.index(inner)


def test_context(spark):
    rows = ["No fever", "not only pain", "all is well", "12 !", "PAS DE FIÈVRE", "sa mère tousse", "it is possibly flu"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, text string")
    flags = lambda d: {r["text"]: r["reason"] for r in d.flags(df).collect()}
    neg = flags(context.NegationDetector())
    assert neg["No fever"] == "en_no" and neg["PAS DE FIÈVRE"] == "fr_pas_de" and not neg["not only pain"] and not neg["12 !"]
    assert flags(context.FamilyDetector())["sa mère tousse"] == "fr_mere"
    assert flags(context.HypothesisDetector())["it is possibly flu"] == "en_possible"
    verbs = {"pouvoir": {"conditionnel": {"présent": ["tousse"]}, "indicatif": {"présent": ["est"]}}}
    hyp = context.HypothesisDetector(rules=(), verbs=verbs, modes_and_tenses=[("conditionnel", "présent")])
    assert flags(hyp)["sa mère tousse"] == "pouvoir"
    assert flags(context.HypothesisDetector(max_length=5))["it is possibly flu"] is None
    with pytest.raises(ValueError):
        context.Rule("é")
    with pytest.raises(ValueError):
        context.NegationDetector(rules=[context.Rule("a", id="1"), context.Rule("b")])
    with pytest.raises(ValueError):
        context.NegationDetector(rules=[context.Rule("a", id="1"), context.Rule("b", id="1")])


def test_context_attributes(raw):
    row = context.NegationDetector().run(raw("no pain")).first()
    assert [(a["label"], a["value"], a["metadata"]) for a in row["attrs"]] == [("negation", "true", {"rule_id": "en_no"})]
    row = context.NegationDetector().run(raw("pain")).first()
    assert [(a["value"], a["metadata"]) for a in row["attrs"]] == [("false", None)]


def test_regexp_matcher(raw):
    rules = [
        matching.RegexpRule(r"grade (\d)", "grade", index_extract=1, id="g", term="grade", version="1"),
        matching.RegexpRule("fievre", "sign", case_sensitive=False, unicode_sensitive=False, id="f", norms=(matching.Norm("umls", "C0015967"),)),
        matching.RegexpRule("asthma", "problem", exclusion="family", id="a"),
    ]
    text = "grade 3, Fièvre and asthma"
    rows = found(matching.RegexpMatcher(rules).run(raw(text, text + " in the family")), "doc_id", "label", "n_start", "n_end", F.transform("attrs", lambda a: a.value))
    assert rows == [("0", "grade", 6, 7, ["rules:g"]), ("0", "sign", 9, 15, ["umls:C0015967"]), ("0", "problem", 20, 26, None), ("1", "grade", 6, 7, ["rules:g"]), ("1", "sign", 9, 15, ["umls:C0015967"])]
    with pytest.raises(ValueError):
        matching.RegexpRule("é", "l", unicode_sensitive=False)


def test_similarity_matcher(raw):
    rules = [matching.TermRule("diabète", "problem", norms=(matching.Norm("umls", "C1"),)), matching.TermRule("asthme", "problem")]
    rows = found(matching.SimilarityMatcher(rules, threshold=0.7).run(raw("Le patient souffre de diabete et asthmes")))
    assert rows == [(22, 29, "diabete"), (33, 40, "asthmes")]
    assert found(matching.SimilarityMatcher(rules, threshold=0.95).run(raw("asthmes"))) == []


def test_fuzzy_join_finds_all_pairs(spark):
    import itertools
    import random

    random.seed(1)
    words = sorted({"".join(random.choice("ab") for _ in range(random.randint(1, 7))) for _ in range(60)})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {(r["text"], r["term"]): r["score"] for r in matching.fuzzy_join(df.withColumnRenamed("w", "text"), df.withColumnRenamed("w", "term"), 0.6).collect()}
    want = {(a, b): s for a, b in itertools.product(words, words) if (s := round(T.similarity(T.ngrams(a), T.ngrams(b)), 6)) >= 0.6}
    assert got == want


def test_greedy_choice():
    m = [(0.9, 0, 5, "a"), (1.0, 5, 8, "b"), (1.0, 10, 12, "c"), (1.0, 9, 13, "d")]
    assert [x[3] for x in matching.best_matches(m)] == ["b", "d"]
    assert [x[3] for x in matching.best_matches(m, touching=False)] == ["a", "b", "d"]


def test_terms():
    assert T.acronym_of("ECG (ElectroCardioGramme)") == "ECG" and T.acronym_of("ECG (heart)") is None
    assert T.clean_term("Asthma, NOS", lower=False) == "Asthma," and T.clean_term("ÉTAT (x) a-b", True, True, brackets=True, dashes=True) == "etat a b"
    assert T.guess_version("/data/2021AB/META") == "2021AB"
    rules = matching.terminology_rules([{"cui": "C1", "term": "asthma", "semgroups": ["DISO"]}, {"cui": "C2", "term": "AIDS", "semgroups": ["DISO"]}, {"cui": "C3", "term": "x", "semgroups": []}])
    assert [(r.label, r.case_sensitive) for r in rules] == [("disorder", False), ("disorder", True)]


def test_ascii():
    assert T.to_ascii("œdème") == "œdeme" and T.to_ascii("œdème", keep_length=False) == "oedeme"


def test_keywords_with_gaps(raw):
    op = matching.KeywordMatcher([("heart failure", "problem", "K1")], window=2)
    row = op.run(raw("heart acute failure")).first()
    assert row["text"] == "heart failure" and [(s["start"], s["length"]) for s in row["spans"]] == [(0, None), (None, 1), (12, None)]


def test_dates_and_stagings(raw):
    rows = found(matching.DateMatcher().run(raw("Seen 2021-03-04, 5 mai 2020, il y a 3 jours")), "text", F.col("attrs")[0].value)
    assert rows == [("2021-03-04", "2021-03-04"), ("5 mai 2020", "2020-05-05"), ("il y a 3 jours", "- 3 days")]
    rows = found(matching.TNMMatcher().run(raw("stage pT2N1M0 found")), "text", F.col("attrs")[0].value)
    assert rows == [("pT2N1M0", "pT2N1M0")]


def test_patterns():
    assert to_java(r"(?P<a>x)[[]\Z") == r"(?U)(?<a>x)[\[]\z"
    with pytest.raises(Untranslatable):
        to_java(r"(a)?(?(1)b|c)")


def test_custom_operations(raw):
    def halves(seg):
        n = len(seg.text) // 2
        return [Found("half", (0, n)), Found("half", (n, len(seg.text)))]

    assert [r[2] for r in found(custom("halves", "create", halves).run(raw("abcd")))] == ["ab", "cd"]
    long = custom("long", "filter", lambda seg, n: len(seg.text) > n, n=2)
    assert long.run(raw("a", "abc")).count() == 1
    with pytest.raises(ValueError):
        custom("x", "other", halves)


def test_overlap_filter(ents):
    rows = ents(("d", "a", 0, 12), ("d", "a", 0, 24), ("d", "a", 16, 24), ("d", "a", 30, 34), ("d", "a", 26, 30))
    assert [(r["n_start"], r["n_end"]) for r in intervals.keep_longest(rows).collect()] == [(0, 24), (26, 30), (30, 34)]
    assert [(r["n_start"], r["n_end"]) for r in intervals.keep_longest(rows, compat=True).collect()] == [(0, 24), (30, 34)]


def test_overlap_filter_against_brute_force(ents):
    import random

    random.seed(3)
    rows = [("d", "x", a := random.randint(0, 300), a + random.randint(1, 20)) for _ in range(120)]
    got = [(r["n_start"], r["n_end"]) for r in intervals.keep_longest(ents(*rows)).collect()]
    kept = []
    for a, b in sorted(((r[2], r[3]) for r in rows), key=lambda x: (x[1] - x[0], x[0]), reverse=True):
        if all(b <= s or e <= a for s, e in kept):
            kept.append((a, b))
    assert got == sorted(kept)


def test_relations(ents):
    rows = ents(("d", "a", 0, 2), ("d", "b", 3, 5), ("d", "c", 6, 8)).withColumn("parent_uid", F.lit("s"))
    pairs = intervals.adjacent_pairs(rows)
    assert sorted((r["source_id"], r["target_id"]) for r in pairs.collect()) == [("e0", "e1"), ("e1", "e2")]
    links = intervals.relations_of(pairs, "next")
    good, bad = intervals.sound_relations(links, rows.where("uid <> 'e2'"))
    assert good.count() == 1 and bad.count() == 1
    sentence = rows.limit(1).withColumn("uid", F.lit("s")).withColumn("n_start", F.lit(0))
    made = intervals.SyntacticRelationExtractor(lambda text, spans: [None, 0, 0], "dep").run(sentence, rows)
    assert [(r["source_id"], r["target_id"]) for r in made.collect()] == [("e0", "e1")]


def test_five_kernels_in_a_row(raw):
    """Orders stay within 64 bits however long the chain, and follow the document."""
    text = "\n".join(f"Part{i}: there’s {i} mg, but also {i + 100} mg. And {i} ml" for i in range(12))
    anns = cleaning.CharReplacer("clean", {"’": "'"}).run(raw(text))
    steps = [
        segmentation.SectionTokenizer({f"s{i}": [f"Part{i}"] for i in range(12)}), segmentation.SentenceTokenizer(), segmentation.SyntagmaTokenizer([r"\bbut\b"]),
        matching.RegexpMatcher([matching.RegexpRule(r"\d+ m[gl]", "dose")]), matching.RegexpMatcher([matching.RegexpRule(r"\d+", "n")]),
    ]
    for step in steps:
        anns = step.run(anns)
    rows = anns.orderBy("seq", "uid").select("text", "n_start", "n_end").collect()
    assert [r["text"] for r in rows] == [str(n) for i in range(12) for n in (i, i + 100, i)]
    assert all(text[r["n_start"] : r["n_end"]] == r["text"] for r in rows)


@pytest.mark.parametrize(
    ("detector", "yes", "no"),
    [
        (context.NegationDetector, ["Absence de lésion", "Le patient n'a pas de fièvre", "Aucune anomalie", "Il nie tout antécédent", "Indemne de toute lésion", "no evidence of disease", "She denies chest pain", "never smoked", "The test was negative"], ["Fièvre à 39", "sans doute une grippe", "On ne peut pas l'exclure : pas exclu", "not only the lung", "Pression négative"]),
        (context.FamilyDetector, ["Sa mère est diabétique", "Un frère asthmatique", "Antécédents familiaux de cancer", "Her grandmother had a stroke", "family history of asthma"], ["Le patient est diabétique", "nom de famille", "école maternelle", "twin pregnancy"]),
        (context.HypothesisDetector, ["Possible pneumopathie", "On suspecte une embolie", "Cela évoquerait une grippe", "Il pourrait s'agir d'un abcès", "à confirmer", "consistent with pneumonia", "rule out infarction", "This may be a fracture"], ["Pneumopathie franche", "as soon as possible", "facteurs de risque vasculaire"]),
    ],
)
def test_default_rules(spark, detector, yes, no):
    df = spark.createDataFrame([(t,) for t in yes + no], "text string")
    got = {r["text"]: r["flag"] for r in detector().flags(df).collect()}
    assert [t for t in yes if not got[t]] == [] and [t for t in no if got[t]] == []


def test_default_sets_of_segmenters_and_matcher(raw):
    text = "Antécédents : asthme, mais pas de tabac.\nExamen clinique : TA 120/80, température 38,5 °C.\nConclusion : pneumopathie. Paracétamol 1 g x3/j"
    names = [r["metadata"]["name"] for r in segmentation.SectionTokenizer().run(raw(text)).orderBy("seq").collect()]
    assert names == ["antecedents", "examen_clinique_entree", "conclusion"]
    assert "mais pas de tabac." in [r["text"] for r in segmentation.SyntagmaTokenizer().run(raw(text)).collect()]
    found = {(r["label"], r["text"]) for r in matching.RegexpMatcher().run(raw(text)).collect()}
    assert {("disorder", "asthme"), ("vital_sign", "120/80"), ("disorder", "pneumopathie"), ("drug", "Paracétamol"), ("dose", "1 g")} <= found


def test_conjugation():
    from marginalia import data

    assert {"suspecte", "suspectait", "suspecterait", "suspectée"} <= set(data.conjugated("suspecter")) and "suggèrent" in data.conjugated("suggérer") and "suggérerait" in data.conjugated("suggérer")
    assert data.conjugated("envisager", ("imparfait",))[0] == "envisageais" and len(data.hypothesis_verbs()) > 40
    assert sum(map(len, data.hypothesis_verbs().values())) > 400


def test_sentences_at_abbreviations_lists_and_headings(raw):
    text = "Vu par le Dr. Martin le 3 janv. 2020. TA 12.5 cmHg\n- toux\n- fièvre\n\nEVOLUTION FAVORABLE\nSortie à J5. cf. lettre"
    rows = [r["text"] for r in segmentation.RuleSentenceTokenizer().run(raw(text)).orderBy("seq").collect()]
    assert rows == ["Vu par le Dr. Martin le 3 janv. 2020.", "TA 12.5 cmHg", "- toux", "- fièvre", "EVOLUTION FAVORABLE\nSortie à J5.", "cf. lettre"]


def test_terminology_as_a_table_finds_what_the_kernel_finds(spark, raw):
    entries = [{"cui": "C1", "term": "diabetes mellitus", "semgroups": ["DISO"]}, {"cui": "C2", "term": "asthma", "semgroups": ["XXXX", "DISO"]}, {"cui": "C3", "term": "aspirin", "semgroups": ["CHEM"]}, {"cui": "C4", "term": "nothing", "semgroups": []}]
    texts = ["He has diabetes melitus and asthma.", "Asthmas, aspirine; nothing more", "", "Diabètes mellitus"]
    shown = lambda df: sorted((r["doc_id"], r["n_start"], r["n_end"], r["text"], r["label"], r["attrs"][0]["norm"]["kb_id"], round(r["attrs"][0]["norm"]["score"], 4)) for r in df.collect())
    kernel = matching.TerminologyMatcher(entries, 0.6)
    table = spark.createDataFrame(entries, "cui string, term string, semgroups array<string>")
    joined = matching.TerminologyJoin(0.6).run(raw(*texts), table)
    got, want = shown(joined), shown(kernel.run(raw(*texts)))
    assert [g[:6] for g in got if g[0] != "3"] == [w[:6] for w in want if w[0] != "3"] and len(got) == 5


@pytest.mark.parametrize("limit", [1 << 20, 300])
def test_links_in_one_group_and_in_several(spark, limit):
    import numpy as np

    rng = np.random.default_rng(2)
    e, t = rng.normal(size=(40, 4)), rng.normal(size=(60, 4))
    t[7] = t[3]
    tables = [spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>") for v in (e, t)]
    got = [tuple(r) for r in matching.link_embeddings(*tables, 3, max_bytes=limit).orderBy("entity_id", "rank").select("entity_id", "term_id", "rank").collect()]
    s = np.round((e / np.linalg.norm(e, axis=1)[:, None]) @ (t / np.linalg.norm(t, axis=1)[:, None]).T, 4)
    assert got == [(i, int(j), k + 1) for i in range(40) for k, j in enumerate(np.argsort(-s[i], kind="stable")[:3])]
    assert matching.link_embeddings(tables[0], tables[1].limit(0)).count() == 0


def test_codes_of_pathology(raw):
    text = "Codes BHGS0040, ABCDEFGH et BHXX0040."
    rows = matching.AdicapMatcher({"organ": {"GS": "breast"}}).run(raw(text)).collect()
    assert [r["text"] for r in rows] == ["BHGS0040"]
    attr = rows[0]["attrs"][0]
    assert (attr["value"], attr["attr_class"], attr["metadata"]["organ"], attr["metadata"]["sampling_mode"], attr["metadata"]["pathology"]) == ("adicap:BHGS0040", "ADICAPNormAttribute", "breast", "B", "0040")
    assert [r["text"] for r in matching.AdicapMatcher().run(raw(text)).orderBy("seq").collect()] == ["BHGS0040", "BHXX0040"]


def test_entities_normalised_by_embeddings(spark, raw):
    from marginalia.operators import models

    def load():
        import numpy as np

        return lambda texts: np.array([[t.count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], float)

    terms = spark.createDataFrame([("C1", "diabetes"), ("C2", "asthma"), ("C3", "asthma")], "cui string, term string")
    ents = matching.RegexpMatcher([matching.RegexpRule(r"diabets|asthmaa|zzz", "d")]).run(raw("diabets asthmaa diabets zzz"))
    out = models.EmbeddingNormaliser(load, threshold=0.9).run(ents, terms).orderBy("n_start").collect()
    assert [sorted(a["norm"]["kb_id"] for a in r["attrs"]) for r in out] == [["C1"], ["C2", "C3"], ["C1"], []]
    assert len({a["uid"] for r in out for a in r["attrs"]}) == 4 and out[0]["attrs"][0]["value"] == "umls:C1"
