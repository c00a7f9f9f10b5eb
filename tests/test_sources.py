import json
import wave
import zipfile

import pytest
from pyspark.sql import functions as F

from marginalia.operators.context import Rule
from marginalia.operators.matching import Norm, RegexpRule
from marginalia.operators.segmentation import RenameRule
from marginalia.schema import ANN, RELATION
from marginalia.sources import brat, corpora, display, documents, exchange, files, rules, terminologies


def test_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("été\r\nligne\n")
    (tmp_path / "b.txt").write_bytes("été".encode("latin-1"))
    (tmp_path / "c.md").write_text("no")
    rows = {r["metadata"]["path_to_text"][-5:]: r["text"] for r in files.read_texts(spark, str(tmp_path), "[ac].*").collect()}
    assert rows["a.txt"] == "été\r\nligne\n" and len(rows) == 2
    with pytest.raises(Exception):
        files.read_texts(spark, str(tmp_path), "b.txt").collect()
    rows = {r["metadata"]["path_to_text"][-5:]: r["text"] for r in files.read_texts(spark, str(tmp_path), "b.txt", "latin-1").collect()}
    assert rows == {"b.txt": "été"}
    first, again = (files.read_texts(spark, str(tmp_path), encoding="latin-1").orderBy("doc_id").select("doc_id").collect() for _ in range(2))
    assert first == again and len(first) == 2


def test_sounds(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\x00\x40\x00\xc0" * 100)
    row = files.read_sounds(spark, str(tmp_path)).first()["audio"]
    assert (row["sample_rate"], row["nb_channels"], row["nb_samples"]) == (8000, 2, 100)
    row = files.read_samples(spark, str(tmp_path)).first()
    assert row["signal"][0][:2] == [0.5, 0.5] and row["signal"][1][0] == -0.5


def test_documents_round_trip(spark, ents, tmp_path):
    text = "Asthma and cough"
    docs = spark.createDataFrame([("d", text, {"k": "v"}), ("e", "", None)], "doc_id string, text string, metadata map<string, string>")
    anns = ents(("d", "problem", 11, 16), ("d", "problem", 0, 6), text=text)
    links = spark.createDataFrame([("d", "r", "with", "e1", "e0", None, 0)], RELATION)
    documents.save_documents(docs, str(tmp_path / "whole"), anns, links)
    back = documents.load_documents(spark, str(tmp_path / "whole"))
    assert {(r["doc_id"], r["text"]) for r in back.collect()} == {("d", text), ("e", "")}
    assert sorted(map(str, documents.annotations_of(back).collect())) == sorted(map(str, anns.collect()))
    assert [r["source_id"] for r in documents.relations_of(back).collect()] == ["e1"]
    documents.save_documents(docs, str(tmp_path / "split"), anns, split_anns=True)
    assert documents.load_annotations(spark, str(tmp_path / "split_anns")).count() == 2
    with pytest.raises(documents.HeaderError):
        documents.load_documents(spark, str(tmp_path / "split_anns"))
    file = str(tmp_path / "one.json")
    documents.save_document_file(back, "d", file, split_anns=True)
    again = documents.load_document_file(spark, file, str(tmp_path / "one_anns.jsonl")).first()
    assert again["text"] == text and [a["uid"] for a in again["anns"]] == ["e0", "e1"]
    whole = json.loads((tmp_path / "one.json").read_text())
    (tmp_path / "one.json").write_text(json.dumps(whole | {"version": "9"}))
    with pytest.raises(documents.HeaderError):
        documents.load_document_file(spark, file)
    with pytest.raises(KeyError):
        documents.save_document_file(back, "zz", file)


ANN_FILE = "T1\tproblem 0 6\tAsthma\nT2\tproblem 11 16;17 22\tcough acute\nR1\twith Arg1:T1 Arg2:T2\nA1\tsevere T1\nA2\tgrade T2 high\n#1\tAnnotatorNotes T1\tC0004096 seen\n#2\tAnnotatorNotes T2\tto check\nE1\tx y\n\n"


def test_brat(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.txt").write_text("Asthma and cough acute")
    (src / "a.ann").write_text(ANN_FILE)
    (src / "b.txt").write_text("Nothing")
    docs, anns, links = brat.load(spark, str(src))
    rows = anns.orderBy("seq").collect()
    assert docs.count() == 2 and [(r["text"], r["n_start"], r["n_end"]) for r in rows] == [("Asthma", 0, 6), ("cough acute", 11, 22)]
    assert [(a["label"], a["value"]) for a in rows[0]["attrs"]] == [("severe", "true"), ("NORMALIZATION", "umls:C0004096")]
    assert [(a["label"], a["value"]) for a in rows[1]["attrs"]] == [("grade", "high"), ("brat_note", "to check")]
    assert [s["length"] for s in rows[1]["spans"]] == [None, 1, None]
    out = tmp_path / "out"
    brat.save(docs, anns, str(out), links)
    made = [p for p in out.glob("*.ann") if p.read_text()][0]
    assert made.read_text().splitlines() == [
        "T1\tproblem 0 6\tAsthma", "A1\tsevere T1", "#1\tAnnotatorNotes T1\tC0004096", "T2\tproblem 11 16;17 22\tcough acute", "A2\tgrade T2 high", "#2\tAnnotatorNotes T2\tto check", "R1\twith Arg1:T1 Arg2:T2"]
    conf = (out / "annotation.conf").read_text()
    assert "with\tArg1:problem, Arg2:problem" in conf and "grade\tArg:<ENTITY>, Value:high" in conf and "severe\tArg:<ENTITY>\n" in conf
    _, anns2, links2 = brat.load(spark, str(out))
    assert anns2.count() == 2 and links2.count() == 1
    assert [r["relations_from"] is not None for r in brat.augmented_entities(anns, links).orderBy("text").collect()] == [True, False]
    group = anns.withColumn("label", F.when(F.col("seq") == 0, "Or-Group").otherwise(F.col("label")))
    assert brat.grouped_entities(group, links).first()["group_type"] == "Or-Group"


def test_brat_details():
    from marginalia.functions.spans import Span

    assert brat.line_fragments("one \n two", [Span(0, 9)]) == [(0, 3), (6, 9)]
    assert brat.brat_value("false", "bool") is None and brat.brat_value("true", "bool") == "" and brat.brat_value(None, "null") == ""
    with pytest.raises(KeyError):
        parts = brat.parse_lines("R1\tx Arg1:T9 Arg2:T8\n")
        assert parts[1] == {"R1": ("x", "T9", "T8")}
        raise KeyError


def test_doccano(spark, tmp_path):
    line = json.dumps({"text": "Asthma and cough", "entities": [{"id": 1, "start_offset": 0, "end_offset": 6, "label": "p"}, {"id": 2, "start_offset": 11, "end_offset": 16, "label": "p"}], "relations": [{"id": 5, "from_id": 1, "to_id": 2, "type": "with"}], "extra": 3})
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("all.jsonl", line + "\n")
    (tmp_path / "x.jsonl").write_text(line + "\n")
    for lines in (exchange.read_json_lines(spark, str(tmp_path)), exchange.read_zipped_lines(spark, str(tmp_path))):
        docs, anns, links = exchange.load_doccano(lines, "relation_extraction")
        assert docs.first()["metadata"] == {"extra": "3"} and anns.count() == 2 and links.count() == 1
    out = json.loads(exchange.doccano_lines(docs, anns, links).first()["line"])
    assert [(e["start_offset"], e["label"]) for e in out["entities"]] == [(0, "p"), (11, "p")] and out["relations"][0]["from_id"] == out["entities"][0]["id"]
    assert json.loads(exchange.doccano_lines(docs, anns.limit(1), links).first()["line"])["relations"] == []
    labels = spark.createDataFrame([("f", '{"text": "a\\" b", "label": [[0, 1, "x"]]}')], "file string, line string")
    docs, anns, _ = exchange.load_doccano(labels, "sequence_labeling")
    assert json.loads(exchange.doccano_lines(docs, anns, task="sequence_labeling").first()["line"]) == {"text": 'a" b', "label": [[0, 1, "x"]]}
    kind = spark.createDataFrame([("f", '{"text": "a", "label": ["good"]}')], "file string, line string")
    docs, anns, _ = exchange.load_doccano(kind, "text_classification")
    assert json.loads(exchange.doccano_lines(docs, anns, task="text_classification").first()["line"]) == {"text": "a", "label": ["good"]}
    assert exchange.wrong_line_ends(spark.createDataFrame([("a\r\nb",), ("a",)], "text string")).count() == 1
    with pytest.raises(ValueError):
        exchange.parse_doccano("{}", "other")


def test_turns_and_subtitles(spark, tmp_path):
    (tmp_path / "a.rttm").write_text("SPEAKER rec 1 1.000 2.500 <NA> <NA> ann <NA> <NA>\nSPEAKER rec 1 4.000 1.000 <NA> <NA> bob <NA> <NA>\n")
    turns = exchange.read_turns(spark, str(tmp_path))
    assert [(r["start"], r["end"], r["speaker"]) for r in turns.orderBy("start").collect()] == [(1.0, 3.5, "ann"), (4.0, 5.0, "bob")]
    exchange.save_lines(exchange.turn_lines(turns), str(tmp_path / "out"), "file_id", "start", "line", ".rttm")
    assert (tmp_path / "out/rec.rttm").read_text() == (tmp_path / "a.rttm").read_text()
    assert exchange.mixed_turn_files(turns).count() == 0
    with pytest.raises(Exception):
        exchange.turn_lines(turns.withColumn("speaker", F.lit(None).cast("string"))).collect()
    body = "0\n00:00:01,500 --> 00:00:02,000\nHello\nthere\n\n1\n01:00:00,000 --> 01:00:01,250\nBye\n"
    (tmp_path / "a.srt").write_text(body)
    subs = exchange.read_subtitles(spark, str(tmp_path))
    assert [(r["idx"], r["start"], r["end"], r["text"]) for r in subs.orderBy("idx").collect()] == [(0, 1.5, 2.0, "Hello\nthere"), (1, 3600.0, 3601.25, "Bye")]
    blocks = exchange.subtitle_blocks(subs.withColumn("doc_id", F.lit("d")))
    assert "\n".join(r["block"] for r in blocks.orderBy("idx").collect()) == body


def test_cases(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"id": "X1", "text": "A case", "authors": [{"author": "n"}], "language": "fr"}))
    row = corpora.read_cases(spark, str(tmp_path)).first()
    assert row["text"] == "A case" and row["metadata"] == {"language": "fr"}
    (tmp_path / "l.xml").write_text('<x:XMI xmlns:x="u" xmlns:c="v"><c:Sofa sofaString="Fever today. Ok"/><c:Sentence begin="0" end="12"/><c:CLINENTITY begin="0" end="5" entityID="C1"/></x:XMI>')
    docs, anns = corpora.read_annotated_cases(spark, str(tmp_path), keep_sentences=True)
    assert docs.first()["text"] == "Fever today. Ok" and sorted((r["label"], r["text"]) for r in anns.collect()) == [("disorder", "Fever"), ("sentence", "Fever today.")]
    corpora.convert_annotated_cases(spark, str(tmp_path), str(tmp_path / "out"))
    assert documents.annotations_of(documents.load_documents(spark, str(tmp_path / "out"))).count() == 1
    (tmp_path / "s.json").write_text(json.dumps([{"id": i, "description": "d", "medical_specialty": "m", "sample_name": "s", "transcription": f"t{i}", "keywords": None} for i in range(3)]))
    assert [r["text"] for r in corpora.read_samples(spark, str(tmp_path / "s.json"), nb_max=2).collect()] == ["t0", "t1"]


def test_terminology(spark, tmp_path):
    row = lambda cui, lang, lui, source, term: "|".join([cui, lang, "P", lui, *"efghijk", source, "m", "n", term, ""])
    (tmp_path / "CONSO").write_text("\n".join([row("C1", "ENG", "L1", "S", "asthma"), row("C1", "ENG", "L1", "S", "ASTHMA"), row("C2", "FRE", "L2", "S", "toux"), row("C3", "ENG", "L3", "T", "x")]) + "\n")
    (tmp_path / "STY").write_text("C1|T047|\nC1|T033|\nC2|T184|\n")
    (tmp_path / "GROUPS").write_text("DISO|Disorders|T047|Disease\nDISO|Disorders|T184|Sign\nCONC|Concepts|T033|Finding\n")
    entries = terminologies.load_entries(spark, str(tmp_path / "CONSO"), str(tmp_path / "STY"), sources=["S"])
    assert sorted((r["lui"], r["term"], r["semtypes"]) for r in entries.collect()) == [("L1", "asthma", ["T047", "T033"]), ("L2", "toux", ["T184"])]
    assert terminologies.load_entries(spark, str(tmp_path / "CONSO"), languages=["FRE"]).count() == 1
    both = terminologies.with_groups(entries, terminologies.load_groups(spark, str(tmp_path / "GROUPS")))
    assert {r["lui"]: r["semgroups"] for r in both.collect()} == {"L1": ["DISO", "CONC"], "L2": ["DISO"]}
    assert terminologies.with_groups(entries, terminologies.load_groups(spark, str(tmp_path / "GROUPS")), ["CONC"]).count() == 1


def test_rule_files(tmp_path):
    file = str(tmp_path / "r.yml")
    own = [RegexpRule("a", "l", id="1", norms=(Norm("kb", "K"),)), RegexpRule("b", "l", id="2", exclusion="c")]
    rules.save_rules(own, file)
    assert rules.load_regexp_rules(file) == own
    (tmp_path / "c.yml").write_text("- regexp: 'no'\n  exclusion_regexps: [not only]\n  id: n\n")
    assert rules.load_context_rules(str(tmp_path / "c.yml")) == [Rule("no", ("not only",), "n")]
    rules.save_sections({"s": ["A"]}, [RenameRule("s", "t", ("u",))], file)
    assert rules.load_sections(file) == ({"s": ["A"]}, [RenameRule("s", "t", ("u",))])
    rules.save_separators(["x", "y"], file)
    assert rules.load_separators(file) == ("x", "y")
    (tmp_path / "bad.yml").write_text("- unknown: 1\n")
    with pytest.raises(ValueError):
        rules.load_regexp_rules(str(tmp_path / "bad.yml"))


def test_display(spark, ents):
    docs = spark.createDataFrame([("d", "heart  failure"), ("e", "x")], "doc_id string, text string")
    rows = {r["doc_id"]: r["ents"] for r in display.display_rows(docs, ents(("d", "p", 7, 14), ("d", "p", 0, 5))).collect()}
    assert [(e["start"], e["end"]) for e in rows["d"]] == [(0, 5), (7, 14)] and rows["e"] == []
    segments, entities = display.by_kind(ents(("d", "p", 0, 1), ("d", "q", 0, 1)), ["p"])
    assert segments.count() == 0 and entities.count() == 1
    assert ANN


def test_artefacts(spark, tmp_path):
    from marginalia.sources.artefacts import Registry, cached, describe

    made = []

    def build():
        made.append(1)
        return spark.range(3)

    for p in ({"v": 1}, {"v": 1}, {"v": 2}):
        assert cached(spark, str(tmp_path), "terms", p, build).count() == 3
    assert len(made) == 2 and len(describe(str(tmp_path))) == 2
    r = Registry()
    r.add("/x", version="2021AB", lowercase=True)
    assert r.get(lowercase=True, version="2021AB") == "/x"
    with pytest.raises(KeyError):
        r.get(version="2021AB", lowercase=False)
    r.clear()
    with pytest.raises(KeyError):
        r.get(version="2021AB", lowercase=True)


def test_one_file_of_documents(spark, tmp_path):
    from marginalia.sources import interchange

    span = {"start": 7, "end": 15, "_class_name": "x.Span"}
    attr = {"uid": "a1", "label": "neg", "value": False, "metadata": {"by": "rule"}, "_class_name": "x.Attribute"}
    norm = {"uid": "a2", "label": "NORMALIZATION", "value": "umls:C1", "kb_name": "umls", "kb_id": "C1", "kb_version": None, "term": "diabetes", "score": 0.5, "extra": 3, "metadata": {}, "_class_name": "x.EntityNormAttribute"}
    mod = {"length": 4, "replaced_spans": [{"start": 0, "end": 1}, {"start": 2, "end": 6}], "_class_name": "x.ModifiedSpan"}
    doc = {
        "uid": "d1", "text": "I have diabetes.", "metadata": {"n": 1}, "_class_name": "x.TextDocument",
        "anns": [
            {"uid": "e1", "label": "disease", "text": "diabetes", "spans": [span], "attrs": [attr, norm], "metadata": {}, "_class_name": "x.Entity"},
            {"uid": "s1", "label": "part", "text": "we'd", "spans": [mod], "attrs": [], "metadata": {"k": "v"}, "_class_name": "x.Segment"},
            {"uid": "r1", "label": "of", "source_id": "e1", "target_id": "s1", "attrs": [], "metadata": {}, "_class_name": "x.Relation"},
        ],
    }
    file = tmp_path / "docs.jsonl"
    head = {"version": "0.2", "content_type": "text_document_list"}
    file.write_text("\n".join(json.dumps(x) for x in (head, doc, {"uid": "d2", "text": "Nothing", "metadata": {}, "anns": []})) + "\n")

    def shown(path):
        docs, anns, relations = interchange.load_documents(spark, str(path))
        return [sorted(map(str, df.orderBy(df.columns[1]).collect())) for df in (docs, anns, relations)]

    docs, anns, relations = interchange.load_documents(spark, str(file))
    e1 = anns.where("uid = 'e1'").first()
    assert (e1["kind"], e1["n_start"], e1["n_end"]) == ("entity", 7, 15) and docs.count() == 2 and relations.first()["target_id"] == "s1"
    assert [(a["value"], a["value_type"]) for a in e1["attrs"]] == [("false", "bool"), ("umls:C1", "string")] and e1["attrs"][1]["norm"]["score"] == 0.5 and e1["attrs"][1]["metadata"] == {"extra": "3"}
    assert anns.where("uid = 's1'").first()["spans"][0]["replaced"][1]["end"] == 6
    again = tmp_path / "again.jsonl"
    interchange.save_documents(docs, anns, str(again), relations, "x.")
    assert json.loads(again.read_text().splitlines()[0]) == head and shown(again) == shown(file)
    interchange.save_annotations(anns, str(tmp_path / "anns.jsonl"), "x.")
    loaded, _ = interchange.load_annotations(spark, str(tmp_path / "anns.jsonl"), "d1")
    assert sorted(r["uid"] for r in loaded.collect()) == ["e1", "s1"]
    with pytest.raises(documents.HeaderError):
        interchange.load_annotations(spark, str(file), "d1")
