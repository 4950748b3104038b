"""Recorded calls, faults, states in bytes, training hooks, and the tokenizer's, phrases' and vectors' further operators."""

import json
import random
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.__main__ import main
from tessera.functions import vector as v
from tessera.functions import wordpiece as wp
from tessera.functions.layers import PhraseScorer
from tessera.operators import interests as it
from tessera.operators import keyphrase as kp
from tessera.operators import listnet as ln
from tessera.operators import phrase_state as ps
from tessera.plans import derived
from tessera.plans.ranker import Ranker, mapped
from tessera.plans.rerank import Mode, Reranker, Systems, feedback_faults, outcomes, rerank
from tessera.sources import scratch, tables

from .test_models_and_plans import piece

NOW = "2024-06-01 00:00:00"


def first_request(spark, sf_dir):
    docs = derived.requests(spark, sf_dir).filter("request_id = 0").withColumn("id", F.col("id").cast("string"))
    history = docs.select("user_id", "id", F.col("doc_pos").cast("long").alias("hist_pos"), (F.col("doc_pos") % 3).alias("relevance"), F.lit(2).alias("user_feedback"))
    return docs, history


# --- the service ----------------------------------------------------------------------------------


def test_faults_of_feedback(spark, sf_dir):
    docs, history = first_request(spark, sf_dir)
    service, now = Reranker(derived.interests(spark, sf_dir)), F.lit(NOW).cast("timestamp")
    service.rerank(Mode.PERSONALIZED_NEWS, history, docs, now)
    assert service.faults.count() == 0 and service.analytics is None
    service.rerank(Mode.PERSONALIZED_NEWS, history.withColumn("id", F.lit("unknown")), docs, now)
    assert [(r["stage"], r["code"]) for r in service.faults.orderBy("stage").collect()] == [("analytics", "NoRelevantHistoricInfo"), ("coi", "NoMatchingDocuments")]
    assert service.analytics.count() == 0
    service.rerank(Mode.STANDARD_NEWS, history, docs, now)
    assert service.previous is None
    service.rerank(Mode.PERSONALIZED_NEWS, history.limit(0), docs, now)
    assert service.faults.count() == 0
    bare = docs.select("user_id", "request_id", "id", "doc_pos")
    assert [r["code"] for r in feedback_faults(bare, history.limit(0)).collect()] == ["NoMatchingDocuments"]


def test_network_failure_is_a_fault(spark, sf_dir):
    now, past = derived.current_and_past(spark, sf_dir)
    users = [r[0] for r in now.select("user_id").distinct().orderBy("user_id").limit(2).collect()]
    docs = now.filter(F.col("user_id").isin(users)).select("user_id", F.lit(0).cast("long").alias("request_id"), F.col("rank").cast("int").alias("doc_pos"), F.col("rank").cast("int").alias("rank"), "session", "query_id", "query_words", "url", "domain", F.col("id").cast("string").alias("id"), F.array(F.lit(1.0), F.col("rank").cast("double")).alias("embedding"))
    interests = spark.createDataFrame([(u, p, 0, f"{u}{p}", [1.0, x], 1, 1.0, None) for u in users for p, x in (("pos", 1.0), ("neg", -1.0))], it.INTERESTS)
    net = ln.ListNet.random(1)
    fine = rerank(Mode.PERSONALIZED_NEWS, docs, interests, past, net=net)
    assert fine.faults.count() == 0 and fine.ranked.filter("ltr_score = 0.5").count() == 0
    broken = ln.ListNet(net.params | {"dense1/weights": net.params["dense1/weights"] * 1e200, "dense2/weights": net.params["dense2/weights"] * 1e200})
    with np.errstate(all="ignore"):
        done = rerank(Mode.PERSONALIZED_NEWS, docs, interests, past, net=broken)
    assert {(r["user_id"], r["stage"], r["code"]) for r in done.faults.collect()} == {(u, "ltr", "LtrFailed") for u in users}
    assert {r[0] for r in done.ranked.select("ltr_score").collect()} == {0.5}


def test_systems_can_be_exchanged(spark, sf_dir):
    docs, history = first_request(spark, sf_dir)
    bare = docs.drop("embedding").withColumns({"title": F.col("id"), "snippet": F.lit(""), "query_words": F.lit("q")})
    systems = Systems(
        embed=lambda d: d.join(docs.select("id", "embedding"), "id"), similarity=lambda d, e: d.withColumn("similarity", F.lit(0.25)),
        ltr=lambda d, h, n, s: d.withColumn("ltr_score", F.col("rank") / 20.0), context=lambda d: d.withColumn("context", F.col("ltr_score") + F.col("similarity")),
    )
    done = rerank(Mode.PERSONALIZED_SEARCH, bare, derived.interests(spark, sf_dir), systems=systems)
    assert [(r["rank"], r["context"]) for r in done.ranked.orderBy("final_rank").collect()] == [(k, pytest.approx(k / 20 + 0.25)) for k in range(19, -1, -1)]
    told = []
    service = Reranker(derived.interests(spark, sf_dir), systems=Systems(learn=lambda i, e, c: told.append(e.count()) or i, analytics=lambda p, h: p.limit(1)))
    for _ in range(2):
        service.rerank(Mode.PERSONALIZED_NEWS, history, docs, F.lit(NOW).cast("timestamp"))
    assert told == [20] and service.analytics.count() == 1


def test_outcomes_are_aligned_with_documents(spark, sf_dir):
    docs, _ = first_request(spark, sf_dir)
    ranked = rerank(Mode.PERSONALIZED_NEWS, docs, derived.interests(spark, sf_dir)).ranked
    twice = docs.unionByName(docs.filter("doc_pos = 3"))
    assert outcomes(ranked, Mode.PERSONALIZED_NEWS, twice).count() == 21
    with pytest.raises(Exception, match="no outcome for document nowhere"):
        outcomes(ranked, Mode.PERSONALIZED_NEWS, docs.withColumn("id", F.lit("nowhere"))).collect()
    doubled = ranked.unionByName(ranked.filter("doc_pos = 3").withColumns({"doc_pos": F.lit(99), "final_rank": F.lit(77)}))
    got = {r["id"]: r["final_rank"] for r in outcomes(doubled, Mode.PERSONALIZED_NEWS, docs).collect()}
    assert got["3"] == 77 and len(got) == 20


def test_states_in_bytes(spark, sf_dir, tmp_path):
    docs, history = first_request(spark, sf_dir)
    now = F.lit(NOW).cast("timestamp")
    one = Reranker(derived.interests(spark, sf_dir))
    one.rerank(Mode.PERSONALIZED_NEWS, history, docs, now)
    two = Reranker.from_bytes(one.serialize())
    one.save(f"{tmp_path}/s")
    three = Reranker.restore(spark, f"{tmp_path}/s")
    shown = lambda f: sorted((r["id"], r["final_rank"], round(r["context_score"], 9)) for r in f.collect())
    want = shown(one.rerank(Mode.PERSONALIZED_NEWS, history, docs, now))
    kept = lambda s: sorted((r["polarity"], r["coi_pos"], r["coi_id"], r["view_count"], r["view_time"], r["last_view"], tuple(np.round(r["point"], 9))) for r in s.interests.collect())
    for other in (two, three):
        assert shown(other.rerank(Mode.PERSONALIZED_NEWS, history, docs, now)) == want and kept(other) == kept(one)
    other = Reranker(derived.interests(spark, sf_dir).filter("coi_pos < 2"))
    other.synchronize_bytes(one.syncdata())
    local = derived.interests(spark, sf_dir).filter("coi_pos < 2")
    count = lambda f: sorted((r["polarity"], r["coi_id"], r["view_count"]) for r in f.collect())
    assert count(other.interests) == count(it.synchronize(local, one.interests))
    empty = spark.createDataFrame([(1, b""), (2, None)], "user_id long, state binary")
    assert tables.state_from_bytes(empty)[0].count() == 0
    for bad, needed in ((empty, True), (spark.createDataFrame([(1, b"x")], "user_id long, state binary"), False), (spark.createDataFrame([(1, b'{"schema_version": 9}')], "user_id long, state binary"), False)):
        with pytest.raises(Exception, match="no state of this version"):
            tables.state_from_bytes(bad, needed)[0].collect()


def call(mode, history, state=None):
    docs = [{"id": f"d{k}", "rank": k, "title": f"title {k}" * (k + 1), "snippet": "", "session": "s", "query_count": 0, "query_id": "q", "query_words": "title", "url": f"u{k}", "domain": "d"} for k in range(4)]
    past = [{"id": i, "relevance": r, "user_feedback": 2, "session": "s", "query_count": 0, "query_id": "q", "query_words": "title", "day": 0, "url": "u", "domain": "d", "rank": 0, "user_action": 2} for i, r in history]
    return json.dumps({"rerank_mode": mode, "histories": past, "documents": docs, "serialized_state": state})


def test_run_of_recorded_calls(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    (folder / "a.json").write_text(call(0, []))
    (folder / "b.json").write_text(call(1, [("d0", 2), ("d1", 0)]))
    (folder / "c.json").write_text(call(2, []))
    assert main(["run", str(folder), f"{tmp_path}/once", "--as-of", NOW]) == 2
    rows = spark.read.json(f"{tmp_path}/once/outcomes").collect()
    by = lambda n: sorted((r["final_rank"], r["id"]) for r in rows if r["file"].endswith(n))
    assert [len(by(n)) for n in ("a.json", "b.json", "c.json")] == [4, 4, 4] and by("a.json") == [(k, f"d{k}") for k in range(4)]
    assert {r["code"] for r in spark.read.json(f"{tmp_path}/once/faults").collect()} == {"NoCoi"}
    # run before, the service has learned from the history, its state can be given to the next call
    assert main(["run", str(folder / "b.json"), f"{tmp_path}/again", "--as-of", NOW, "--pre-run", "1", "--return-state"]) == 0
    assert spark.read.json(f"{tmp_path}/again/analytics").count() == 1
    state = spark.read.json(f"{tmp_path}/again/states").first()["serialized_state"]
    (folder / "d.json").write_text(call(1, [("d0", 2), ("d1", 0)], state))
    assert main(["run", str(folder / "d.json"), f"{tmp_path}/next", "--as-of", NOW]) == 0
    assert spark.read.json(f"{tmp_path}/next/outcomes").count() == 4


def test_histories_go_by_their_files_order(spark, tmp_path):
    head = "session_id,user_id,query_id,day,query_words,url,domain,relevance,position,query_counter\n"
    rows = [(9, 1), (9, 2), (2, 1), (2, 1001), (2, 2)]
    (tmp_path / "u.csv").write_text(head + "".join(f"{s},7,3,0,a,u,d,1,{p},0\n" for s, p in rows))
    got = tables.read_history_csv(spark, str(tmp_path)).orderBy("hist_pos").collect()
    assert [(r["session"], r["rank"] + 1) for r in got] == rows and [r["hist_pos"] for r in got] == list(range(5))


def test_generated_histories(spark):
    rows = tables.synthetic_calls(spark, 40, seed=5).collect()
    assert rows == tables.synthetic_calls(spark, 40, seed=5).collect() and len(rows) == 2000
    by = {}
    for r in rows:
        by.setdefault((r["user_id"], r["hist_pos"] // 10), []).append(r)
    for own in by.values():
        clicks = [r["rank"] for r in own if r["user_action"] == 2]
        assert all(r["user_action"] == (2 if r["rank"] in clicks else 1 if r["rank"] < max(clicks, default=-1) else 0) and (r["relevance"] > 0) == (r["rank"] in clicks) for r in own)
        assert not clicks or next(r for r in own if r["rank"] == min(clicks))["relevance"] == 2
    share = [sum(r["user_feedback"] == k for r in rows) / 2000 for k in (2, 1, 0)]
    assert np.allclose(share, [0.5, 0.3, 0.2], atol=0.04)


def test_intermediate_tables_are_plain_files(spark):
    """No markers and no checksum files beside them; narrow tables are a few files, whatever the shuffle's partitions."""
    rows = spark.range(1_000).repartition(40)
    files = lambda t: list(Path(t.inputFiles()[0].removeprefix("file://")).parent.iterdir())
    wide, narrow = scratch.materialize(rows), scratch.materialize(rows, narrow=True)
    assert len(files(wide)) == 40 and len(files(narrow)) == 2 * spark.sparkContext.defaultParallelism
    assert all(f.name.startswith("part-") for t in (wide, narrow) for f in files(t))
    assert sorted(r[0] for r in narrow.collect()) == list(range(1_000)) == sorted(r[0] for r in wide.collect())


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    own = scratch.materialize(spark.range(3))
    assert own.count() == 3 and spark.sparkContext.applicationId in own.inputFiles()[0]

    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_root(Cluster)


# --- learning, by plain twins -----------------------------------------------------------------------


def test_merging_by_the_nearest_pair():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 12, 40):
        cois = [it.Coi(f"c{k:02}", rng.standard_normal(4) * 4, int(k + 1), float(k), None if k % 3 else pd.Timestamp(k, unit="s")) for k in rng.permutation(n)]
        left = [(c.id, c.point.copy(), c.count, c.time, c.last_view) for c in cois]
        while True:
            near = [(np.linalg.norm(a[1] - b[1]), *sorted((a[0], b[0]))) for i, a in enumerate(left) for b in left[:i]]
            if not near or min(near)[0] >= it.MERGE_DISTANCE:
                break
            _, x, y = min(near)
            a, b = (next(c for c in left if c[0] == i) for i in (x, y))
            views = [t for t in (a[4], b[4]) if t is not None]
            left = [c for c in left if c[0] not in (x, y)] + [(x, (a[1] + b[1]) / 2, a[2] + b[2], a[3] + b[3], max(views) if views else None)]
        got = it.merge_closest(cois)
        assert [(c.id, c.count, c.time, c.last_view) for c in got] == [(c[0], c[2], c[3], c[4]) for c in left]
        assert all(np.allclose(c.point, w[1]) for c, w in zip(got, left, strict=True))


def test_learning_by_plain_loops(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((3, 4))
    events = [(u, k, k, ["like", "dislike", "view"][rng.integers(3)], (base[rng.integers(3)] + rng.standard_normal(4) * 0.4).tolist(), float(k), pd.Timestamp(k, unit="s")) for u in range(2) for k in range(40)]
    frame = spark.createDataFrame(pd.DataFrame(events, columns=["user_id", "seq", "event_id", "kind", "embedding", "seconds", "at"]))
    got = it.learn(spark.createDataFrame([], it.INTERESTS), frame).collect()
    cosine = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    for u in range(2):
        known = {"pos": [], "neg": []}
        for _, _, _, kind, x, seconds, at in (e for e in events if e[0] == u):
            side = known["neg" if kind == "dislike" else "pos"]
            best = max(range(len(side)), key=lambda k: cosine(side[k][0], x), default=None)
            if kind == "view":
                if best is not None:
                    side[best][2] += seconds
            elif best is not None and cosine(side[best][0], x) >= 0.67:
                side[best][0] = 0.9 * np.array(side[best][0]) + 0.1 * np.array(x)
                side[best][1] += 1
                side[best][3] = at
            else:
                side.append([x, 1, 0.0, at])
        for p, side in known.items():
            own = sorted((r for r in got if r["user_id"] == u and r["polarity"] == p), key=lambda r: r["coi_pos"])
            assert [(r["view_count"], r["view_time"]) for r in own] == [(c[1], c[2]) for c in side] and len({r["coi_id"] for r in own}) == len(own)
            assert all(np.allclose(r["point"], c[0]) for r, c in zip(own, side, strict=True))


def test_phrase_selection_by_plain_loops():
    rng = np.random.default_rng(4)
    for n, most in ((1, 3), (3, 3), (9, 4)):
        names = [f"p{k}" for k in range(n)]
        points, coi = rng.standard_normal((n, 5)), rng.standard_normal(5)
        cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
        s = [[cos(points[i], points[j]) for j in range(n)] + [cos(points[i], coi)] for i in range(n)]

        def normal(j):
            others = [i for i in range(n) if i != j]
            if not others or n < 2:
                return [0.5] * n
            low, high = min(s[i][j] for i in others), max(s[i][j] for i in others)
            x = [(s[i][j] - low) / (high - low) if high > low else float("nan") for i in range(n)]
            mean = sum(x[i] for i in others) / (n - 1)
            gap = [y - mean for y in x]
            inner = gap[others[0]] + sum(gap[i] ** 2 for i in others[1:])
            deviation = (inner / (n - 1)) ** 0.5 if inner >= 0 else float("nan")
            z = [g / deviation + 0.5 if deviation else float("nan") for g in gap]
            return [y if np.isfinite(y) else 0.5 for y in z]

        z = [normal(j) for j in range(n + 1)]
        chosen = list(range(n))
        if n > most:
            chosen = [max(range(n), key=lambda i: z[n][i])]
            while len(chosen) < most:
                left = [i for i in range(n) if i not in chosen]
                chosen.append(max(left, key=lambda i: 0.9 * z[n][i] - 0.1 * max(z[j][i] for j in chosen)))
        high = max(s[i][n] for i in chosen)
        want = {names[i]: min(1, max(0, s[i][n] / high)) if s[i][n] > 0 else 0.0 for i in chosen}
        got = dict(kp.select_phrases(dict(zip(names, points, strict=True)), coi, most, 0.9))
        assert got == pytest.approx(want)


def test_training_hooks(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(k, rng.random((10, 50)).tolist(), ln.softmax(rng.random(10)).tolist()) for k in range(23)]
    data = spark.createDataFrame(rows, "sample_id long, inputs array<array<double>>, target array<double>")
    source = ln.SampleSource(data, 5, seed=3)
    first, again, other = ([[r[0] for r in b.select("sample_id").collect()] for b in source.batches(e)] for e in (0, 0, 1))
    flat = [i for b in first for i in b]
    assert [len(b) for b in first] == [5] * 4 and len(set(flat)) == 20 and [sorted(b) for b in first] == [sorted(b) for b in again] != [sorted(b) for b in other]
    assert [b.count() for b in ln.SampleSource(data, 0).batches(0)] == [23] and not list(ln.SampleSource(data, 24).batches(0))
    dumped, told = [], []

    class Once(ln.Controller):
        def epoch_done(self, epoch, net, evaluation):
            return False

    net, costs = ln.train(data, 3, 10, 0.05, evaluation=data, controller=Once(dump=lambda name, n: dumped.append(name), every=2, tell=told.append))
    assert dumped == ["initial", "0-1"] and len(told) == 2 and len(costs) == 1
    assert np.allclose(ln.MiniBatchSgd(0.5).apply(net, np.ones_like(net.flat())).flat(), net.flat() - 0.5)


# --- texts ------------------------------------------------------------------------------------------


def test_joined_encodings():
    a, b = piece(max_length=4, padding=False).encode("a a a"), piece(max_length=3, padding=False).encode("foo a")
    assert (len(a.overflowing), len(b.overflowing)) == (1, 1)
    both = a.joined(b, True)
    assert both.ids == a.ids + b.ids and both.ranges == [(0, 4), (4, 7)]
    assert both.offsets == a.offsets + [(s + a.offsets[-1][1], e + a.offsets[-1][1]) for s, e in b.offsets]
    assert [o.ids for o in both.overflowing] == [a.overflowing[0].ids + b.ids, a.overflowing[0].ids + b.overflowing[0].ids, a.ids + b.overflowing[0].ids]
    three = wp.Encoding.merge([a, b, b])
    assert three.ids == a.ids + b.ids + b.ids and three.ranges == [(0, 0), (0, 4), (4, 7), (7, 10)] and three.offsets[4:7] == b.offsets
    assert wp.Encoding.merge([]).ids == []


def test_patterns():
    is_b = lambda c: c == "b"
    assert wp.find_matches(is_b, "aba") == [((0, 1), False), ((1, 2), True), ((2, 3), False)]
    assert wp.find_matches(is_b, "bbaaa") == [((0, 1), True), ((1, 2), True), ((2, 5), False)]
    assert wp.find_matches("b", "") == [((0, 0), False)] == wp.find_matches(is_b, "") and wp.find_matches("", "aé") == [((0, 3), False)]
    import re

    assert wp.find_matches(re.compile("b+"), "éabbb") == [((0, 3), False), ((3, 6), True)] and wp.find_matches("ab", "aabbb") == [((0, 1), False), ((1, 3), True), ((3, 5), False)]


def test_ranges():
    aligned = piece().normalise("  Né\0o")
    text = "".join(c for c, _, _ in aligned)
    assert text == "  neo"
    assert wp.to_original(aligned, 2, 4) == (2, 5) and wp.to_original(aligned, 0, 5) == (0, 7) and wp.to_original(aligned, 4, 5) == (6, 7)
    assert wp.to_original(aligned, 3, 3) == (3, 3) and wp.to_original(aligned, 3, 2) is None and wp.to_original(aligned, 3, 9) is None
    assert wp.to_normalised(aligned, 2, 5) == (2, 4) and wp.to_normalised(aligned, 0, 7) == (0, 5) and wp.to_normalised(aligned, 5, 4) is None
    assert wp.to_normalised(aligned, 6, 7) == (4, 5) and wp.to_normalised([], 0, 1) is None


def test_phrases_in_context(spark):
    w = piece(max_length=12)
    e = w.encode("Foobar a. né foo, a")
    assert wp.spoken_words("Foobar a. né foo, a", e)[:3] == ["foobar", "a.", "né"]
    cut = piece(max_length=4).encode("a foobar. a")
    assert cut.overflowing and wp.spoken_words("a foobar. a", cut) == ["a", "foobar."]
    valid, phrases, active = kp.phrase_masks(w.encode("a foo a"), "a foo a", (1, 2))
    assert valid.tolist()[:4] == [False, True, True, True] and phrases == ["a", "foo", "a foo", "foo a"]
    assert active.tolist() == [[True, False, True, False, False], [False, True, False, False, False], [False, False, False, True, False], [False, False, False, False, True]]
    docs = spark.createDataFrame([(1, "a foo né a foobar a foo"), (2, "a foo"), (3, None)], "id long, text string")
    encoder, scorer = wp.ContextEncoder(piece(max_length=64), 8), PhraseScorer.random(8)
    got = kp.extract(docs, "id", "text", encoder, scorer).collect()
    encoding, tokens = encoder.tokens(["a foo né a foobar a foo"])[0]
    valid, phrases, active = kp.phrase_masks(encoding, "a foo né a foobar a foo", scorer.lengths)
    scores = scorer.scores(tokens[valid])
    assert {r["phrase"]: r["score"] for r in got} == pytest.approx({p: max(s for s, on in zip(scores, row, strict=True) if on) for p, row in zip(phrases, active, strict=True)}) and {r["id"] for r in got} == {1}
    with pytest.raises(ValueError):
        kp.extract(docs, "id", "text", wp.ContextEncoder(piece(max_length=600), 8), scorer)


def test_transformer_takes_batches():
    class Session:
        calls = []

        def get_inputs(self):
            return [type("I", (), {"name": n}) for n in ("ids", "mask", "types")]

        def run(self, _, feed):
            self.calls.append(feed["ids"].shape)
            return [np.stack([feed["ids"], feed["mask"]], axis=2).astype(float)]

    w = piece(padding=False)
    texts = ["a foo", "a", "foobar a a", ""]
    for pooler, size in ((wp.pool_average, 2), (wp.pool_first, 2)):
        own = wp.OnnxEncoder("none", w, size, pooler, batch=3)
        own._session = Session()
        Session.calls = []
        want = [pooler(np.stack([e.ids, e.attention_mask], axis=1).astype(float), np.array(e.attention_mask)) for e in map(w.encode, texts)]
        assert np.allclose(own.encode(texts), want) and Session.calls == [(3, 6), (1, 2)]
    assert wp.pool_none(np.ones((2, 3)), np.ones(2)).shape == (2, 3)


# --- small operators --------------------------------------------------------------------------------


def test_vector_helpers(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([(1.0,), (nan,), (None,), (-2.0,), (inf,)], "x double")
    assert [r[0] for r in rows.orderBy(*v.nan_highest(F.col("x"))).limit(3).collect()] == [-2.0, 1.0, inf]
    assert rows.filter("x < 2 and not isnan(x)").select(v.finite(F.col("x")).alias("y")).count() == 2
    for bad in (nan, inf, None):
        with pytest.raises(Exception, match="relevance is not finite"):
            spark.createDataFrame([(bad,)], "x double").select(v.finite(F.col("x")).alias("y")).collect()
    day = spark.createDataFrame([(86399,), (86400,), (200000,)], "s long")
    assert [tuple(r) for r in day.select(v.whole_days(F.col("s")).alias("d"), v.seconds_of_days(v.whole_days(F.col("s"))).alias("t")).collect()] == [(0, 0), (1, 86400), (2, 172800)]
    f = np.float32
    up = lambda x, k: float(np.float32(x) + k * np.spacing(np.float32(x)))
    cases = [([1.0, nan], [up(1, 2), nan], True), ([1.0], [up(1, 3)], False), ([1.0], [1.0, 2.0], False), ([0.15039155], [0.1503916], False), ([inf], [inf], True), ([nan], [1.0], False), ([0.0], [float(f(1e-45))], True)]
    got = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a array<float>, b array<float>").select("k", v.approx_equal(F.col("a"), F.col("b")).alias("e")).orderBy("k").collect()
    assert [r["e"] for r in got] == [c[2] for c in cases]
    near = spark.createDataFrame([([1.0], [1.01])], "a array<float>, b array<float>")
    assert near.select(v.approx_equal(F.col("a"), F.col("b"), epsilon=0.02)).first()[0]


def test_phrase_state_operations(spark):
    rows = spark.createDataFrame([(0, "a", "x", [1.0], 0.5, False), (0, "a", "y", [2.0], 0.5, True), (0, "b", "x", [3.0], 0.1, False)], ps.PHRASES)
    more = ps.insert(rows, spark.createDataFrame([(0, "a", "x", [9.0], 0.7, False), (0, "c", "z", [4.0], 0.2, False)], ps.PHRASES))
    assert sorted((r["coi_id"], r["words"], r["point"][0]) for r in more.collect()) == [("a", "x", 9.0), ("a", "y", 2.0), ("b", "x", 3.0), ("c", "z", 4.0)]
    gone, left = ps.remove(rows, spark.createDataFrame([(0, "a"), (0, "q")], "user_id long, coi_id string"))
    assert (gone.count(), left.count()) == (2, 1)
    new = ps.replace(rows, spark.createDataFrame([(0, "a", 0.9)], "user_id long, coi_id string, relevance double"))
    assert sorted((r["coi_id"], r["relevance"]) for r in new.collect()) == [("a", 0.9), ("a", 0.9), ("b", 0.1)]
    with pytest.raises(Exception, match="not finite"):
        ps.replace(rows, spark.createDataFrame([(0, "a", float("nan"))], "user_id long, coi_id string, relevance double")).collect()


def test_ranker_takes_snippets_and_keeps_state(spark, tmp_path):
    rnd = random.Random(1)
    words = ["a", "foo", "foobar", "né", "ne", "ab"]
    rows = [(0, k, k, k % 3, " ".join(rnd.choice(words) for _ in range(8)), [float(k % 2), 1.0], pd.Timestamp(k, unit="s")) for k in range(9)]
    reactions = spark.createDataFrame(pd.DataFrame(rows, columns=["user_id", "seq", "event_id", "feedback", "snippet", "embedding", "at"]))
    more = {"phrase_encoder": wp.ContextEncoder(piece(max_length=32), 8), "scorer": PhraseScorer.random(8), "most_phrases": 5}
    ranker = Ranker.empty(spark, wp.NgramEncoder(2), **more)
    ranker.log_reactions(reactions)
    assert ranker.phrases.count() > 0 and ranker.interests.filter("polarity = 'neg'").count() > 0
    ranker.save(f"{tmp_path}/r")
    again = Ranker.restore(spark, f"{tmp_path}/r", wp.NgramEncoder(2), **more)
    now = F.lit(NOW).cast("timestamp")
    assert sorted(map(str, again.select_top_key_phrases(3, now).collect())) == sorted(map(str, ranker.select_top_key_phrases(3, now).collect()))
    with pytest.raises(ValueError):
        Ranker.empty(spark, wp.NgramEncoder(2)).log_reactions(reactions)
    docs = spark.createDataFrame([("x", [1.0], "2024-01-01")], "doc string, vec array<double>, day string")
    assert mapped(docs, "doc", "vec", "day").columns == ["id", "embedding", "published"]
    for bad in (lambda: mapped(docs), lambda: mapped(docs.withColumn("id", F.lit(1)), "doc", "vec", "day")):
        with pytest.raises(ValueError):
            bad()
