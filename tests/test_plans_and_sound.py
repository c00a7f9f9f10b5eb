import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marginalia import streaming
from marginalia.functions import dates
from marginalia.operators import audio, intervals, kernel, matching, models, segmentation, training
from marginalia.plans import pipeline, provenance
from marginalia.plans.pipeline import DocPipeline, Pipeline, PipelineStep, WiringError
from marginalia.schema import attach_attrs, attrs_of, by_id, collect_modalities, duplicate_uids, norm_value, select_anns


def numbers(label="number"):
    return matching.RegexpMatcher([matching.RegexpRule(r"\d+", label)])


def test_pipeline(raw):
    from marginalia.operators.context import NegationDetector, Rule

    steps = [
        PipelineStep(segmentation.SentenceTokenizer(), ["raw"], ["s"]),
        PipelineStep(NegationDetector(rules=[Rule("no", id="n")]), ["s"]),
        PipelineStep(matching.RegexpMatcher([matching.RegexpRule(r"\d+", "number")], attrs_to_copy=["negation"]), ["s"], ["e"]),
    ]
    made = Pipeline(steps, ["raw"], ["e", "s"])
    made.check_sanity()
    e, s = made.run(raw("no 12. yes 3"))
    assert [(r["text"], r["attrs"][0]["value"], r["keys"]) for r in e.orderBy("seq").collect()] == [("12", "true", ["e"]), ("3", "false", ["e"])]
    assert s.count() == 2
    _, edges = made.trace(raw("no 12. yes 3"))
    table = provenance.edge_table(edges)
    assert provenance.faults(table).count() == 0
    root = raw("no 12. yes 3").first()["uid"]
    anns = table.where("kind = 'annotation'")
    assert {r["root_uid"] for r in provenance.roots(anns, 2).collect()} == {root}
    nodes = {r["item_uid"]: r for r in provenance.nodes(anns).collect()}
    assert nodes[root]["op_id"] is None and len(nodes[root]["derived"]) == 2 and len(nodes) == 5
    flat = provenance.flattened(anns, anns.join(e.select(F.col("uid").alias("item_uid")), "item_uid"), 2)
    assert {r["source_uid"] for r in flat.collect()} == {root}
    dot = provenance.to_dot(table, {steps[0].operation.op_id: "sentences"}, e, max_depth=0, show_attrs=False)
    assert dot.startswith("digraph") and "sentences" in dot and "dashed" not in dot and provenance.merge(anns, anns).count() == anns.count()


def test_nested_and_shared_keys(raw):
    inner = Pipeline([PipelineStep(numbers(), ["x"], ["y"])], ["x"], ["y"])
    made = Pipeline([PipelineStep(inner, ["a"], ["out"]), PipelineStep(numbers("other"), ["a", "b"], ["out"], aggregate_input_keys=True)], ["a", "b"], ["out"])
    rows = made.run(raw("1 2"), raw("3")).collect()
    assert sorted(r["label"] for r in rows) == ["number", "number", "other", "other", "other"] and all(r["keys"] == ["out"] for r in rows)
    scopes = provenance.edge_table(made.trace(raw("1 2"), raw("3"))[1])
    assert {r[0] for r in scopes.select("scope").distinct().collect()} == {0, 1}


@pytest.mark.parametrize(
    "steps, inputs, outputs",
    [([("a", "b")], ["a", "z"], ["b"]), ([("a", "b")], ["a"], ["z"]), ([("x", "b")], ["x", "a"][:1] and ["a"], ["b"]), ([("b", "c"), ("a", "b")], ["a"], ["c"])],
)
def test_wiring(steps, inputs, outputs):
    with pytest.raises(WiringError):
        Pipeline([PipelineStep(numbers(), [i], [o]) for i, o in steps], inputs, outputs).check_sanity()


def test_arity(raw):
    with pytest.raises(WiringError):
        Pipeline([PipelineStep(numbers(), ["a"], ["b"])], ["a"], ["b"]).run()
    with pytest.raises(WiringError):
        Pipeline([PipelineStep(numbers(), ["a"], ["b", "c"])], ["a"], ["b"]).run(raw("1"))
    with pytest.raises(WiringError):
        DocPipeline(Pipeline([], ["a", "b"], []))


def test_doc_pipeline(spark):
    docs = spark.createDataFrame([(1, "a 1. b 22"), (2, "3")], "doc_id long, text string")
    sentences = DocPipeline(Pipeline([PipelineStep(segmentation.SentenceTokenizer(), ["raw"], ["s"])], ["raw"], ["s"])).run(docs)
    both = DocPipeline(Pipeline([PipelineStep(numbers(), ["s"], ["n"])], ["s"], ["n"]), {"s": ["sentence"]}).run(docs, sentences)
    assert sorted(r["label"] for r in both.collect()) == ["number"] * 3 + ["sentence"] * 3
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_schema_helpers(spark, ents):
    rows = ents(("d", "b", 0, 1), ("d", "a", 1, 2), ("d", "c", 2, 3))
    assert [r["label"] for r in select_anns(rows, ["a", "b"]).collect()] == ["a", "b"] and select_anns(rows, "c", kind="segment").count() == 0
    assert by_id(rows, "e1").count() == 1 and duplicate_uids(rows.union(rows)).count() == 3
    attrs = rows.select(F.col("uid").alias("owner_id"), F.concat(F.lit("x"), "uid").alias("uid"), F.lit("Attribute").alias("attr_class"), F.lit("k").alias("label"), F.lit("v").alias("value"), F.lit("string").alias("value_type"), F.expr("cast(null as struct<kb_name: string, kb_id: string, kb_version: string, term: string, score: double>)").alias("norm"))
    more = attach_attrs(rows, attrs)
    assert more.count() == 3 and attrs_of(more).where("value = 'v'").count() == 3
    norm = spark.sql("select named_struct('kb_name', 'u', 'kb_id', 'c', 'term', 't') n union all select named_struct('kb_name', null, 'kb_id', null, 'term', 't')")
    assert sorted(r[0] for r in norm.select(norm_value(F.col("n"))).collect()) == ["t", "u:c"]
    assert collect_modalities(rows.select("doc_id"), rows.select("uid")).count() == 6
    assert intervals.nested_segments(rows, rows).count() == 3 and kernel.copy_attrs(rows, rows, ["k"]).count() == 0


def test_dates():
    assert dates.format_date(2020, 3) == "2020-03-??" and dates.format_date(hour=5) == "05:??:??" and dates.format_date(hour=5, minute=1, second=2, compat=True) == "05:0102"
    assert dates.format_duration(years=1, days=2) == "1 year 2 days" and dates.format_relative("past", weeks=1) == "- 1 week"


def sounds(spark, *signals, rate=8000):
    return spark.createDataFrame([(i, [list(map(float, c)) for c in s], rate) for i, s in enumerate(signals)], "uid long, signal array<array<float>>, sample_rate int")


def test_levels_and_channels(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 3, (2, 50)).astype(np.float32)
    df = sounds(spark, x)
    assert np.allclose(df.select(audio.downmix(df.signal)).first()[0][0], x.mean(0), atol=1e-5)
    assert np.allclose(df.select(audio.downmix(df.signal, False)).first()[0][0], x.sum(0), atol=1e-5)
    assert np.allclose(df.select(audio.normalize_power(df.signal, 2.0)).first()[0], 2 * x / x.astype(float).std(), atol=1e-4)
    each = np.array(df.select(audio.normalize_power(df.signal, 1.0, True)).first()[0])
    assert np.allclose(each.std(1), 1)
    cut = df.select(audio.trim(df.signal, F.lit(10), F.lit(0.25), F.lit(99.0))).first()[0]
    assert np.allclose(cut, x[:, 2:])


def test_resampling_keeps_a_tone(spark):
    t = np.arange(1600) / 1600
    df = sounds(spark, [np.sin(2 * np.pi * 50 * t)], rate=1600)
    y = np.array(audio.Resampler(800).run(df).first()["signal"][0])
    assert len(y) == 800 and np.abs(y - np.sin(2 * np.pi * 50 * np.arange(800) / 800))[50:-50].max() < 0.01
    assert audio.Resampler(1600).run(df).first()["signal"][0] == df.first()["signal"][0]


def test_voice(spark):
    x = np.zeros(8000 * 3)
    x[8000:16000] = 0.9
    row = audio.VoiceDetector().run(sounds(spark, [x])).collect()
    assert len(row) == 1 and abs(row[0]["start"] - 1) < 0.34 and abs(row[0]["end"] - 2) < 0.34
    with pytest.raises(Exception):
        audio.VoiceDetector().run(sounds(spark, [x], rate=11025)).collect()
    assert audio.VoiceDetector().run(sounds(spark, [np.zeros(0)])).count() == 0


def test_transcripts(spark):
    df = spark.createDataFrame([("d", "u2", [[0.0, 0.0]], 8000, 2.0, 3.0), ("d", "u1", [[1.0, 1.0]], 8000, 0.0, 1.0)], "doc_id string, uid string, signal array<array<float>>, sample_rate int, start double, end double")
    model = lambda: lambda batch: ["HELLO YOU" if s.max() > 0 else "bye!" for s, _ in batch]
    said = audio.Transcriber(model, batch_size=1).run(df)
    docs, _, spans = audio.transcribe_documents(said)
    assert docs.first()["text"] == "Hello you.\nBye!"
    wanted = spark.createDataFrame([("d", 11, 14)], "doc_id string, t_start int, t_end int")
    assert [(r["a_start"], r["a_end"]) for r in audio.audio_spans(wanted, spans).collect()] == [(2.0, 3.0)]
    turns = audio.SpeakerDetector(lambda: lambda x, rate: [(0.0, 0.5, "ann")]).run(df)
    assert sorted((r["start"], r["speaker"]) for r in turns.collect()) == [(0.0, "ann"), (2.0, "ann")]


def test_models(raw, spark):
    ner = models.ModelEntityMatcher(lambda: lambda texts: [[("p", 0, 3, 0.5)] if t else [] for t in texts], batch_size=1)
    rows = ner.run(raw("abcdef", "")).collect()
    assert [(r["text"], r["attrs"][0]["value"]) for r in rows] == [("abc", "0.5")]
    moved = models.Translator(lambda: lambda texts: [("the dog", [((4, 7), [(3, 8)])]) for _ in texts]).run(raw("un chien")).first()
    assert moved["text"] == "the dog" and (moved["n_start"], moved["n_end"]) == (3, 8) and sum(s["length"] for s in moved["spans"]) == 7
    service = models.ServiceMatcher("time", "http://none", dims=["time"], send=lambda text, about: [{"dim": "time", "start": 0, "end": 2, "value": {"v": 1}}, {"dim": "other", "start": 0, "end": 1, "value": 0}])
    assert [r["text"] for r in service.run(raw("5h later")).collect()] == ["5h"]
    parser = models.ParserPipeline(lambda: lambda texts: texts, lambda t: [("x", 0, 4, {"k": 1}), ("y", 2, 6, {}), ("z", 4, 6, {})], no_overlap=True)
    assert [r["label"] for r in parser.run(raw("abcdef")).orderBy("seq").collect()] == ["x", "z"]
    vectors = models.embed(spark.createDataFrame([(1, "ab"), (2, None)], "uid long, text string"), lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]), batch_size=1)
    assert np.allclose([r["embedding"] for r in vectors.orderBy("uid").collect()], [[2 / 5**0.5, 1 / 5**0.5], [0, 1]])
    states = np.arange(12.0).reshape(1, 3, 4)
    assert models.pool(states, np.array([[1, 1, 0]]), "mean").tolist() == [[2, 3, 4, 5]] and models.pool(states, None).tolist() == [[0, 1, 2, 3]]
    assert models.align_words(np.eye(2) * 50, np.eye(2) * 50) == [(0, 0), (1, 1)]
    assert models.hulls(raw("a")).count() == 1


def test_links(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(9, 4)), rng.normal(size=(7, 4))
    frame = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    got = {(r["entity_id"], r["rank"]): r["term_id"] for r in matching.link_embeddings(frame(x), frame(y), 3, max_bytes=100).collect()}
    cos = np.round((x / np.linalg.norm(x, axis=1)[:, None]) @ (y / np.linalg.norm(y, axis=1)[:, None]).T, 4)
    want = {(i, k + 1): int(j) for i, row in enumerate(cos) for k, j in enumerate(np.lexsort((np.arange(7), -row))[:3])}
    assert got == want
    assert matching.norm_rows(matching.link_embeddings(frame(x), frame(y), 1, threshold=2.0), "kb").count() == 0


def test_streams(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    events = pd.DataFrame({"event_id": range(6), "ts": pd.to_datetime(["2024-01-01 00:05", "2024-01-01 00:50", "2024-01-01 01:10", "2024-01-01 01:10", "2024-01-01 05:00", "2024-01-02 00:00"]), "user_id": [1, 1, 1, 1, 2, 2], "event_type": "a", "value": 1.5})
    batch = spark.createDataFrame(events)
    batch.write.parquet(str(src))
    stream = streaming.read_stream(spark, str(src), batch)
    streaming.write_once(streaming.tumbling(stream, "1 hour", "10 minutes"), str(out / "t"), str(out / "ct")).awaitTermination()
    got = {(str(r["window_start"]), r["n"]) for r in spark.read.parquet(str(out / "t")).collect()}
    assert got == {("2024-01-01 00:00:00", 2), ("2024-01-01 01:00:00", 2), ("2024-01-01 05:00:00", 1)}
    once = streaming.without_repeats(stream, ["user_id", "ts"], "1 day")
    streaming.write_once(once, str(out / "o"), str(out / "co")).awaitTermination()
    assert spark.read.parquet(str(out / "o")).count() == 5
    assert streaming.sliding(batch, "2 hours", "1 hour").agg(F.sum("n")).first()[0] == 12
    # Stateless operators run on a stream as they are.
    docs = spark.createDataFrame([("c", "d1", "one shared line of words"), ("c", "d2", "xx one shared line of words")], "collection_id string, doc_id string, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    live = streaming.read_stream(spark, str(tmp_path / "docs"), docs)
    from marginalia.schema import raw_segments

    streaming.write_once(segmentation.SentenceTokenizer().run(raw_segments(live)), str(out / "s"), str(out / "cs")).awaitTermination()
    assert spark.read.parquet(str(out / "s")).count() == 2
    streaming.write_once(streaming.find_duplicates(live), str(out / "d"), str(out / "cd")).awaitTermination()
    assert [(r["doc_id"], r["n_start"], r["source_doc_id"]) for r in spark.read.parquet(str(out / "d")).collect()] == [("d2", 3, "d1")]


def test_training(spark, tmp_path):
    class Mean:
        def __init__(self):
            self.w, self.g, self.saved = 0.0, [], []

        def preprocess(self, row):
            return {"y": row["y"]}

        def forward(self, batch, train):
            assert batch[0] == {"y": batch["y"][0]}
            loss = float(np.mean([(y - self.w) ** 2 for y in batch["y"]]))
            if train:
                self.g += [self.w - y for y in batch["y"]]
            return {"p": [self.w] * len(batch["y"])}, loss

        def step(self, rate):
            self.w -= rate * float(np.mean(self.g))
            self.g = []

        def save(self, path):
            self.saved.append(path)

    df = spark.createDataFrame([(2.0,), (4.0,)], "y double")
    model = Mean()
    seen = []

    class Watch(training.Callback):
        def on_epoch_end(self, metrics, epoch):
            seen.append(epoch)

    config = training.TrainerConfig(str(tmp_path), learning_rate=0.5, epochs=5, batch_size=1, accumulation=2)
    history = training.Trainer(model, config, df, df, lambda outputs: {"n": float(len(outputs))}, [Watch()]).train()
    assert abs(model.w - 3) < 0.2 and history[-1]["eval"]["loss"] < history[0]["eval"]["loss"] and seen == [1, 2, 3, 4, 5] and history[0]["eval"]["n"] == 2
    assert model.saved[-1].endswith("last") and any(p.endswith("best") for p in model.saved)


def test_annotations_in_the_order_of_their_labels(spark):
    rows = [("d", "b", 0, "1"), ("d", "a", 5, "2"), ("d", "b", 3, "3"), ("c", "b", 9, "4"), ("d", "a", 1, "5")]
    anns = spark.createDataFrame(rows, "doc_id string, label string, seq long, uid string")
    got = anns.orderBy(*pipeline.in_label_order(anns, ["b", "a"])).collect()
    assert [r["uid"] for r in got] == ["4", "1", "3", "5", "2"]


def test_written_tables_can_be_dropped(spark):
    from marginalia.plans import tables

    tables.drop_written(spark)
    table = tables.written(spark.range(3), "numbers")
    assert table.count() == 3 and tables.drop_written(spark) == 1 and tables.drop_written(spark) == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from marginalia.plans import tables

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            class _jsc:  # noqa: N801
                sc = staticmethod(lambda: type("Sc", (), {"getCheckpointDir": staticmethod(lambda: type("None_", (), {"isDefined": staticmethod(lambda: False)}))}))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_folder(Session)


def test_a_tagger_learns_entities(spark, tmp_path, raw):
    import random

    from marginalia.operators import tagger

    rng = random.Random(1)
    rows = []
    for _ in range(120):
        drug, dose = rng.choice(["aspirin", "ibuprofen", "morphine"]), f"{rng.randrange(1, 900)} mg"
        text = f"{rng.choice(['He takes', 'We gave', 'Start'])} {drug} {dose} {rng.choice(['daily', 'at night', 'now'])}."
        rows.append((text, [("drug", text.index(drug), text.index(drug) + len(drug)), ("dose", text.index(dose), text.index(dose) + len(dose))]))
    df = spark.createDataFrame(rows, "text string, entities array<struct<label: string, start: int, end: int>>")
    model = tagger.TrainableTagger(["drug", "dose"])
    config = training.TrainerConfig(str(tmp_path), learning_rate=0.5, epochs=6, batch_size=10)
    history = training.Trainer(model, config, df.limit(100), df).train()
    assert history[-1]["eval"]["loss"] < 0.1 < history[0]["train"]["loss"]
    found = tagger.TaggerMatcher(str(tmp_path / "best")).run(raw("Then we gave morphine 75 mg now.", "", "Nothing here")).orderBy("n_start").collect()
    assert [(r["label"], r["text"]) for r in found] == [("drug", "morphine"), ("dose", "75 mg")] and float(found[0]["attrs"][0]["value"]) > 0.5
    with pytest.raises(ValueError, match="token-classification"):
        tagger.check_task(str(tmp_path / "best"), "translation")


def test_parsed_documents_in_and_out(spark):
    from marginalia.sources import parsers

    def reader():
        import json
        from types import SimpleNamespace as N

        span = lambda s: N(label_=s[0], start_char=s[1], end_char=s[2], _=N(**s[3]))
        return lambda raw_: (lambda d: N(text=d["text"], ents=[span(s) for s in d["ents"]], spans={k: [span(s) for s in v] for k, v in d["spans"].items()}))(json.loads(raw_))

    def builder():
        import json

        return lambda text, found: json.dumps({"text": text, "ents": [list(f) for f in found], "spans": {}}).encode()

    stored = b'{"text": "no pain today", "ents": [["sign", 3, 7, {"negated": true}], ["time", 8, 13, {}]], "spans": {"all": [["", 0, 13, {}]]}}'
    docs, anns = parsers.load(spark.createDataFrame([("d", stored)], "doc_id string, content binary"), reader, attrs=["negated"])
    rows = {r["label"]: r for r in anns.collect()}
    assert docs.first()["text"] == "no pain today" and {k: r["text"] for k, r in rows.items()} == {"sign": "pain", "time": "today", "all": "no pain today"}
    assert [(a["label"], a["value"]) for a in rows["sign"]["attrs"]] == [("negated", "true")]
    import json

    back = json.loads(parsers.save(docs, anns, builder, ["sign", "time"]).first()["content"])
    assert back["ents"] == [["sign", 3, 7, {"negated": "true"}], ["time", 8, 13, {}]]
    _, few = parsers.load(parsers.save(docs, anns, builder), reader, entities=["time"], groups=[])
    assert [r["label"] for r in few.collect()] == ["time"]
