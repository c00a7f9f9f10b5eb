"""The operators and the pipeline as DataFrame jobs: odd rows, and brute force over whole fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, language, lm, nearest, neardup, pieces, private, quality, registry, shards, substrings

SF = "/root/testdata/sf0.001"
CLASHING = ["key", "row_key", "sig", "print", "shard", "label", "h", "term", "spans", "ids", "n", "node", "bucket", "part", "rows", "keep", "terms_", "c0_", "h_", "entity", "piece_ids"]
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows):
    """Documents with a column for every name that the operators use inside."""
    df = spark.createDataFrame([(*r, *[f"x{i}"] * 0) for i, r in enumerate(rows)], SHAPE)
    for c in CLASHING:
        df = df.withColumn(c, F.lit("mine"))
    return df


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    long = words(rng, 40_000)
    rows = [
        (1, words(rng, 120), "en", "a", 5), (2, "", "en", "a", 0), (3, None, "en", "b", None), (None, words(rng, 60), None, None, 1),
        (4, long, "fr", "a", 9), (5, "twice the same row " * 5, "fr", "a", 2), (5, "twice the same row " * 5, "fr", "a", 2), (6, "word", None, "a", 4), (7, " \n\t ", "en", "a", 4),
    ]
    return make(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return make(spark, [])


def ids(df, column="doc_id"):
    return sorted((r[column] for r in df.select(column).collect()), key=lambda v: (v is None, v))


ALL = [1, 2, 3, 4, 5, 5, 6, 7, None]


def test_language_on_odd_rows(spark, odd, none):
    got = {r["doc_id"]: r for r in language.identify(odd).collect()}
    assert ids(language.identify(odd)) == ALL
    assert [got[i]["lang"] for i in (2, 3, 7)] == ["und"] * 3 and got[3]["confidence"] is None and not got[7]["keep"]
    assert language.identify(none).count() == 0
    kept = language.keep_identified(odd)
    assert kept.columns == odd.columns and not {2, 3, 7} & set(ids(kept))
    assert {r["lang"] for r in language.identify(odd, language.Model({})).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1")
    found = language.identify(held, model).select("doc_id", F.col("lang").alias("got")).join(held, "doc_id")
    assert found.select(F.avg((F.col("got") == F.col("lang")).cast("double"))).collect()[0][0] > 0.97


def test_quality_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (4, None, 0), (5, 0, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(odd, labels)
    scored = quality.score(odd, model)
    assert ids(scored) == ALL
    assert not any(r["keep"] for r in scored.where("doc_id IN (2, 3, 7)").collect())
    assert quality.score(none, model).count() == 0
    assert ids(quality.score(odd, quality.train(odd, labels.limit(0)))) == ALL


def test_quality_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    held = quality.score(docs, model).select("doc_id", F.col("quality").alias("q"), "toxicity").join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert ((held.q >= 0.5) == (held.quality == 1)).mean() > 0.98
    assert ((held.toxicity >= 0.5) == (held.toxic == 1)).mean() > 0.97


def test_privacy_on_odd_rows(spark, odd, none):
    out = private.sanitise_documents(odd)
    assert out.columns == odd.columns and ids(out) == ALL
    assert sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    assert private.sanitise_documents(none).count() == 0


def test_terms_that_reveal_an_entity(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, f"{words(rng, 12)} Zorblax {words(rng, 2)} ann@mail.org {words(rng, 2)} the {words(rng, 9)}", "en", "a", 1) for i in range(6)]
    rows += [(100 + i, f"the {words(rng, 20)}", "en", "a", 1) for i in range(30)] + [(200, "once bob@mail.org here", "en", "a", 22)]
    docs = make(spark, rows)
    assert {(r["entity"], r["term"]) for r in private.disclosing_terms(docs).collect()} == {("EMAIL:ann@mail.org", "zorblax")}
    out = private.sanitise_documents(docs, counts=True).toPandas().set_index("doc_id")
    assert all("Zorblax" not in t and "[NAME]" in t and "@" not in t and " the " in t for t in out.text[:6])
    assert out.n_chars[200] == len(out.text[200]) and out.n_chars[105] == 1 and (out.n_terms[:6] == 1).all()
    brute = {}
    for _, t, *_ in rows:
        for e, c, near in private.contexts(t):
            for w in set(near):
                brute.setdefault((e, w), set()).add(c)
    assert [k for k, c in brute.items() if len(c) >= 3 and k[1] != "the"] == [("EMAIL:ann@mail.org", "zorblax")]
    monkeypatch.setattr(private, "MAX_PAIRS", 0)
    joined = private.sanitise_documents(docs, counts=True).toPandas().set_index("doc_id")
    assert joined.text.to_dict() == out.text.to_dict()


def test_terms_beside_an_entity_with_one_mention(spark):
    rng = random.Random(6)
    rows = [(i, f"the {words(rng, 20)}", "en", "a", 1) for i in range(300)]
    rows += [(500, "the parcel of Zorblax went to ann@mail.org on the day", "en", "a", 1), (501, f"{words(rng, 20)} the Zorblax {words(rng, 20)}", "en", "a", 1)]
    out = private.sanitise_documents(make(spark, rows + rows[:50]), counts=True).toPandas().set_index("doc_id")
    assert "Zorblax" not in out.text[500] and "[NAME]" in out.text[500] and out.text[500].count("the ") == 2
    assert out.text[501] == rows[-1][1] and out.n_terms[500] == 7


def test_repeats_on_odd_rows(spark, odd, none):
    out = substrings.remove_repeats(odd)
    assert ids(out) == ALL and out.agg(F.sum("removed")).collect()[0][0] == 0
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {r["doc_id"]: r["text"] for r in odd.collect()}
    assert substrings.remove_repeats(none).count() == 0


def test_repeats_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    least, pool = 12, [words(rng, n).split() for n in (14, 30, 11, 12)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(4)):
            text += [f"u{rng.randrange(10**9)}" for _ in range(rng.randrange(8))]
            p = rng.choice(pool)
            a = rng.randrange(3)
            text += p[a : len(p) - rng.randrange(3)]
        rows.append((rng.choice([i, i, 7]), " ".join(text) + rng.choice(["", "  ", "\n"]), "en", "a", 1))
    docs = make(spark, rows)
    for limit, hot in ((500_000, substrings.HOT), (0, substrings.HOT), (500_000, 0), (0, 3)):
        monkeypatch.setattr(substrings, "MAX_BROADCAST", limit)
        got = substrings.remove_repeats(docs, least, 5, hot=hot).collect()
        keyed = sorted({(r["doc_id"], r["k"], r["text"]) for r in docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k")).collect()})
        seen, want = set(), {}
        for i, _, text in keyed:
            w = text.split()
            grams = [tuple(w[a : a + least]) for a in range(len(w) - least + 1)]
            gone = {b for a, g in enumerate(grams) if g in seen for b in range(a, a + least)}
            seen |= set(grams)
            want.setdefault((i, len(w), len(gone)), []).append([x for b, x in enumerate(w) if b not in gone])
        assert len(got) == 60
        for r in got:
            assert r["text"].split() in want[r["doc_id"], r["n_tokens"], r["removed"]]


def test_shards_on_odd_rows(spark, odd, none):
    out = shards.assign(odd, shard_bytes=1000)
    assert ids(out) == ALL and shards.assign(none).count() == 0
    assert len({r["shard"] for r in out.where("doc_id = 5").collect()}) == 1
    assert out.where("doc_id = 3").collect()[0]["bytes"] == 0


def test_shards_in_pools_and_without_broadcast(spark, monkeypatch):
    """Every document is placed once, its group in one shard, and pools are as even as one pool."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for limit in (500_000, 0, 200):
        monkeypatch.setattr(shards, "MAX_BROADCAST", limit)
        out = shards.assign(docs, shard_bytes=1 << 17, pool_shards=6).toPandas()
        load = out.assign(rows=1).groupby("shard")[["bytes", "tokens", "rows"]].sum()
        assert sorted(out.doc_id) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
        assert (out.groupby(["source", "part"]).shard.nunique() == 1).all() and 12 < len(load) <= out.shard.max() + 1
        assert load.bytes.max() < 2.5 * load.bytes.mean()


def test_packing_is_largest_first_by_dot_product(spark):
    """The placement of whole groups, against the rule written out for one pool."""
    rng = random.Random(8)
    docs = make(spark, [(i, words(rng, rng.randrange(1, 60)), "en", f"s{rng.randrange(40)}", 1) for i in range(300)])
    out = shards.assign(docs, min_shards=4).toPandas().assign(rows=1)
    groups = out.groupby([out.source.map("=".__add__), "part"])[["bytes", "tokens", "rows"]].sum().sort_index()
    share = (groups / groups.sum()).to_numpy()
    left = [[1.02 / 4] * 3 for _ in range(4)]
    want = {}
    for g in sorted(range(len(share)), key=lambda g: -max(share[g])):
        fits = [s for s in range(4) if all(left[s][d] - share[g][d] >= -1e-12 for d in range(3))]
        best = max(fits, key=lambda s: (sum(left[s][d] * share[g][d] for d in range(3)), -s)) if fits else max(range(4), key=lambda s: (min(left[s][d] - share[g][d] for d in range(3)), -s))
        left[best] = [left[best][d] - share[g][d] for d in range(3)]
        want[groups.index[g]] = best
    got = {("=" + r.source, r.part): r.shard for r in out.itertuples()}
    assert got == want


def test_shards_balance_the_whole_table(spark):
    out = registry.op5_packed_shards(spark, "/root/testdata/sf0.01").toPandas()
    load = out.assign(rows=1).groupby("shard")[["bytes", "tokens", "rows"]].sum()
    assert len(out) == 1000 and (load.max() / load.mean() < 1.1).all()


def test_scores_on_odd_rows(spark, odd, none):
    out = lm.score(odd)
    assert ids(out) == ALL and lm.score(none).count() == 0
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[2]["n_tokens"] == 0 and got[3]["log_prob"] is None and got[4]["log_prob"] < 0
    assert len({(r["log_prob"], r["perplexity"]) for r in out.where("doc_id = 5").collect()}) == 1


def test_model_beats_piece_frequencies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mean = F.sum(F.col("log_prob") * F.col("n_tokens")) / F.sum("n_tokens")
    trained, plain = (lm.score(docs, rates=rates).agg(mean).collect()[0][0] for rates in (lm.RATES, ()))
    assert trained > -4.7 and plain < -5.5


def test_replicas_are_averaged_in_one_order(spark):
    tokens = lm.tokenise(spark.read.parquet(f"{SF}/documents.parquet"), lm.Vocabulary(None), "doc_id", "text")
    counts = lm.count_pieces(tokens, 32000)
    cls, _, bias = lm.output_classes(counts)
    many = [lm.train(tokens, cls, bias, int(counts.sum()), rates=(4e-3, 2e-3), per_replica=2) for _ in range(2)]
    assert math.ceil(math.sqrt(counts.sum() / lm.STRIDE / 2 / 2)) > 32 and np.array_equal(*many)
    assert not np.array_equal(many[0], lm.start(bias))


def slow_gradient(m, seen, aims):
    """Loss and gradient of one window, written out position by position in double precision."""
    w, d, loss = lm.WIDTH, {k: np.zeros(v.shape) for k, v in m.items()}, 0.0
    x = m["E"][seen] + m["P"]
    dx = np.zeros_like(x)
    for i, aim in enumerate(aims):
        at = lm.OVERLAP + i
        keys = x[: at + 1]
        q = x[at] @ m["A"]
        p = np.exp(keys @ q)
        p /= p.sum()
        a = p @ keys
        h = x[at] + a @ m["O"]
        pre = h @ m["W"] + m["c"]
        g = np.append(h + np.maximum(pre, 0) @ m["V"], 1.0)
        group, member = divmod(aim, lm.MEMBERS)
        dg = np.zeros(w + 1)
        for table, slope, k_ in ((m["G"], d["G"], group), (m["U"][group], d["U"][group], member)):
            soft = np.exp(g @ table)
            soft /= soft.sum()
            loss -= np.log(soft[k_])
            soft[k_] -= 1
            slope += np.outer(g, soft)
            dg += table @ soft
        dg = dg[:w]
        d["V"] += np.outer(np.maximum(pre, 0), dg)
        dpre = (m["V"] @ dg) * (pre > 0)
        d["W"] += np.outer(h, dpre)
        d["c"] += dpre
        dh = dg + m["W"] @ dpre
        d["O"] += np.outer(a, dh)
        da = m["O"] @ dh
        dp = keys @ da
        dl = p * (dp - p @ dp)
        dq = keys.T @ dl
        d["A"] += np.outer(x[at], dq)
        dx[: at + 1] += np.outer(dl, q) + np.outer(p, da)
        dx[at] += dh + m["A"] @ dq
    d["P"] += dx
    np.add.at(d["E"], seen, dx)
    return loss, d


def test_training_matches_an_independent_slow_trainer(spark):
    """With the registered rates, batch and replicas: every window of every document once, in the stated order."""
    rng = random.Random(5)
    docs = make(spark, [(i, words(rng, 40 + 30 * i), "en", "a", 1) for i in range(12)])
    tokens = lm.tokenise(docs, lm.Vocabulary(None), "doc_id", "text")
    counts = lm.count_pieces(tokens, 32000)
    cls, _, bias = lm.output_classes(counts)
    got = lm.parts(lm.train(tokens, cls, bias, int(counts.sum())))
    rows = tokens.select("key", "ids", F.pmod(F.xxhash64("key", F.lit("round")), F.lit(len(lm.RATES))).alias("turn")).orderBy("key", "ids").collect()
    m = {k: v.astype(float) for k, v in lm.parts(lm.start(bias)).items()}
    top, seen_windows = 1 << 64, 0
    for turn, rate in enumerate(lm.RATES):
        todo = []
        for r in rows:
            if r["turn"] == turn:
                pieces_of = np.frombuffer(r["ids"], np.uint16).astype(int)
                for b in range(0, len(pieces_of), lm.STRIDE):
                    x = (r["key"] + b * 0x9E3779B97F4A7C15) % top
                    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % top
                    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % top
                    line = [lm.INPUTS if t <= 0 else int(lm.fold(pieces_of[t - 1 : t])[0]) for t in range(b - lm.OVERLAP, b + lm.STRIDE) if t <= len(pieces_of)]
                    line += [0] * (lm.WINDOW - len(line))
                    todo.append((x ^ (x >> 31), line, [int(cls[t]) for t in pieces_of[b : b + lm.STRIDE]]))
        todo.sort(key=lambda w: w[0])
        seen_windows += len(todo)
        mean, square = ({k: np.zeros(v.shape) for k, v in m.items()} for _ in range(2))
        for step, a in enumerate(range(0, len(todo), lm.BATCH), 1):
            batch, total = todo[a : a + lm.BATCH], {k: np.zeros(v.shape) for k, v in m.items()}
            for _, line, aims in batch:
                for k, v in slow_gradient(m, np.array(line), aims)[1].items():
                    total[k] += v / sum(len(w[2]) for w in batch)
            touched = np.unique([i for w in batch for i in w[1]])
            for k, g in total.items():
                part = touched if k == "E" else slice(None)
                mean[k][part] += 0.1 * (g[part] - mean[k][part])
                square[k][part] += 0.01 * (g[part] ** 2 - square[k][part])
                m[k][part] -= rate * (mean[k][part] / (1 - 0.9**step)) / (np.sqrt(square[k][part] / (1 - 0.99**step)) + 1e-8)
    assert seen_windows == sum(-(-len(r["ids"]) // 2 // lm.STRIDE) for r in rows) > 100
    for k in m:
        off = np.abs(got[k] - m[k])
        assert off.mean() < 1e-4 and (off < 5e-3).mean() > 0.995, k


def test_groups_on_odd_rows(spark, odd, none):
    out = neardup.groups(odd)
    got = {r["doc_id"]: r for r in out.collect()}
    assert sorted(map(str, got)) == sorted({str(i) for i in ALL}) and all(r["keep"] for r in got.values()) and got[5]["rows"] == 2
    kept = neardup.keep_first(odd)
    assert kept.columns == odd.columns and ids(kept) == [1, 2, 3, 4, 5, 6, 7, None]
    assert neardup.groups(none).count() == 0 and neardup.keep_first(none).count() == 0


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_groups_against_brute_force(spark, limit, monkeypatch):
    import pyarrow as pa

    found = neardup.components
    monkeypatch.setattr(neardup, "components", lambda links: found(links, limit))
    rng = random.Random(8)
    rows = []
    for g in range(12):
        base = words(rng, 80).split()
        for _ in range(rng.choice([1, 2, 5, 12])):
            rate = rng.choice([0, 0.02, 0.08, 0.2])
            rows.append((len(rows), " ".join(words(rng, 1) if rng.random() < rate else w for w in base), "en", "a", 1))
    got = {r["doc_id"]: (r["rep_id"], r["group_size"]) for r in neardup.groups(make(spark, rows)).collect()}
    sig, _ = neardup.signatures(pa.array([r[1] for r in rows]))
    label = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in np.flatnonzero((sig != sig[a]).sum(1) <= neardup.RADIUS):
                label[a] = label[b] = min(label[a], label[b])
    assert got == {i: (low, label.count(low)) for i, low in enumerate(label)}


def test_tables_with_one_header_stay_apart(spark):
    """Texts that share long words and differ in short ones are no near duplicates."""
    rng = random.Random(4)
    header = "quarterly production figures for the northern plant in tonnes"
    rows = [(i, f"{header} {' '.join(str(rng.randrange(10, 100)) for _ in range(500))}", "en", "a", 1) for i in range(8)]
    assert all(r["keep"] and r["group_size"] == 1 for r in neardup.groups(make(spark, rows)).collect())


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(0, 40)] + [(100, 101), (101, 102)], "a long, b long")
    for limit in (10**6, 0):
        got = {r["node"]: r["label"] for r in neardup.components(links, limit).collect()}
        assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_pieces_on_odd_rows(spark, odd, none):
    out = pieces.encode(odd)
    got = {r["doc_id"]: r for r in out.collect()}
    assert ids(out) == ALL and got[3]["ids"] is None and got[2]["ids"] == [] and all(r["exact"] in (True, None) for r in got.values())
    back = {r["doc_id"]: r["text"] for r in pieces.decode(out).collect()}
    assert back == {r["doc_id"]: r["text"] for r in odd.collect()}
    assert pieces.encode(none).count() == 0
    more = pieces.add_ids(odd)
    assert more.columns == [*odd.columns, "piece_ids_"] and more.count() == 9


def test_pieces_round_trip_over_the_whole_table(spark):
    out = registry.op8_sentencepiece(spark, "/root/testdata/sf0.01")
    assert out.agg(F.count("*"), F.sum(F.col("exact").cast("int"))).collect()[0][:] == (1000, 1000)


@pytest.mark.parametrize(("every", "settings"), [(1, {}), (7, {"group_bytes": 1200}), (50, {"buckets": 3})])
def test_top_products_against_brute_force(spark, every, settings):
    """One group of queries and several, few buckets and many; with ties, a zero vector and rows that don't count."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8))
    x[:150] = x[0] + rng.normal(size=(150, 8)) * 0.05
    x *= rng.lognormal(0, 0.7, (600, 1))
    x[300] = 0
    x[301] = x[302]
    rows = [(i, v.tolist(), "z") for i, v in enumerate(x)] + [(None, [1.0] * 8, "q"), (900, None, "q"), (901, [float("nan")] * 8, "q"), (902, [1.0], "q"), (903, [], "q"), (5, x[5].tolist(), "again")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string")
    got = nearest.top_products(df, 10, every, 40, **settings).orderBy("vec_id", "rank").collect()
    s = np.round(x @ x.T, 8)
    np.fill_diagonal(s, -np.inf)
    want = [(i, int(j), k + 1) for i in range(0, 600, every) for k, j in enumerate(np.lexsort((np.arange(600), -s[i]))[:10])]
    assert [(r["vec_id"], r["neighbor_id"], r["rank"]) for r in got] == want
    assert nearest.top_products(df.limit(0)).count() == 0


def test_top_products_of_odd_ids_ties_and_few_rows(spark):
    rows = [("0", [1.0, 0.0]), ("none", [9.0, 9.0]), ("3", [2.0, 0.0]), ("4", [2.0, 0.0]), ("7", [1.0, 0.0]), ("7", [0.5, 0.0]), ("50", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>").withColumn("id", F.lit("mine")).withColumn("rank", F.lit(1))
    got = [tuple(r) for r in nearest.top_products(df, 4).orderBy("vec_id", "rank").collect()]
    assert got == [(0, 3, 2.0, 1), (0, 4, 2.0, 2), (0, 7, 1.0, 3), (0, 7, 0.5, 4), (50, 0, 0.0, 1), (50, 3, 0.0, 2), (50, 4, 0.0, 3), (50, 7, 0.0, 4)]
    assert nearest.top_products(df.where("vec_id = '3'")).count() == 0 and nearest.top_products(df.where("vec_id = '50'")).count() == 0


def test_top_products_of_vectors_near_the_axes(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(400, 4)) * 0.15
    v[np.arange(400), rng.integers(0, 4, 400)] += rng.choice([-1.0, 1.0], 400)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.top_products(df, 3, 1, 40).collect():
        got.setdefault(r["vec_id"], {})[r["rank"]] = r["neighbor_id"]
    product = v @ v.T
    np.fill_diagonal(product, -np.inf)
    assert got == {i: dict(enumerate(np.argsort(-product[i])[:3].tolist(), 1)) for i in range(400)}


def test_top_products_has_no_cartesian_product(spark):
    plan = registry.op9_top_products(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_matches_on_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "never there at all, not once"), (2, None), (3, ""), (None, "word"), (4, "twice the same row twice the same row twice")], "item_id long, text string")
    got = decontaminate.matches(odd, items)
    assert sorted((str(r["doc_id"]), str(r["item_id"]), r["kind"]) for r in got.collect()) == [("5", "4", "phrase"), ("6", "None", "phrase")]
    kept = decontaminate.drop_contaminated(odd, items)
    assert kept.columns == odd.columns and ids(kept) == [1, 2, 3, 4, 7, None]
    assert decontaminate.matches(none, items).count() == 0 and decontaminate.matches(odd, items.limit(0)).count() == 0


def test_matches_against_brute_force(spark):
    rng = random.Random(11)
    common = words(rng, 12).split()
    items = [(i, " ".join(rng.choice([rng.choice(common), words(rng, 1)]) for _ in range(n))) for i, n in enumerate([4, 9, 10, 14, 25, 40])]
    rows = []
    for i in range(50):
        text = [rng.choice([rng.choice(common), words(rng, 1)]) for _ in range(30)]
        if rng.random() < 0.8:
            inside = rng.choice(items)[1].split()
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(inside))
                inside[at : at + rng.randrange(2)] = [words(rng, 1)]
            at = rng.randrange(30)
            text[at:at] = inside
        rows.append((i, " ".join(text), "en", "a", 1))
    want = set()
    for i, text, *_ in rows:
        doc = text.split()
        for j, item in items:
            terms = item.split()
            votes = [(a, p) for a, t in enumerate(terms) for p, w in enumerate(doc) if w == t]
            if votes and (best := decontaminate.best_alignment(*map(np.array, zip(*votes)), len(terms), 0.8, 3, 10)):
                want.add((i, j, *best))
    frame = spark.createDataFrame(items, "item_id long, text string")
    for limit in (2_000_000, 3):
        got = decontaminate.matches(make(spark, rows), frame, max_vocabulary=limit).collect()
        assert {(r["doc_id"], r["item_id"], r["kind"], r["position"], r["matched"]) for r in got} == want and len(got) == len(want)
