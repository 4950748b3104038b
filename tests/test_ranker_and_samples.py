"""Phrase state, the ranker, training samples, extraction, manifests and the command line."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.__main__ import main
from tessera.functions.layers import PhraseScorer
from tessera.functions.wordpiece import ByteEncoder
from tessera.operators import interests as it
from tessera.operators import keyphrase as kp
from tessera.operators import phrase_state as ps
from tessera.operators import samples as sm
from tessera.plans.ranker import Ranker
from tessera.sources import tables

def now_():
    return F.lit("2024-02-01").cast("timestamp")



def state(spark, rows):
    return spark.createDataFrame([(0, c, w, [1.0, float(k)], 0.5, cleaned) for k, (c, w, cleaned) in enumerate(rows)], ps.PHRASES)


def two_interests(spark):
    return spark.createDataFrame([(0, "pos", k, f"c{k}", [1.0, float(k)], 1 + k, 0.0, datetime(2024, 2, 1)) for k in range(2)], it.INTERESTS)


def test_phrases_are_taken_and_refilled(spark):
    now = state(spark, [("c0", "a", False), ("c0", "b", False), ("c1", "z", False)])
    seen = []
    for _ in range(3):
        chosen, now = ps.take_top(now, two_interests(spark), now_(), 2)
        seen.append([r["words"] for r in chosen.orderBy("position").collect()])
        now = spark.createDataFrame(now.collect(), ps.PHRASES)
    assert seen == [["z", "b"], ["a"], ["z", "b"]]


def test_update_phrases(spark):
    old = state(spark, [("c0", "old", False), ("c0", "gone", True), ("c1", "same", False)])
    new = spark.createDataFrame([(0, "c0", ["new!", "old", "other"])], "user_id long, coi_id string, candidates array<string>")
    got = {(r["coi_id"], r["words"], r["cleaned"]) for r in ps.update(old, new, two_interests(spark), lambda w: np.ones(2)).collect()}
    assert got == {("c0", "old", False), ("c0", "new", False), ("c0", "other", False), ("c1", "same", False)}
    rel = spark.createDataFrame([(0, "c0", 0.3), (0, "c1", 0.1), (0, "c2", 0.2)], "user_id long, coi_id string, relevance double")
    assert [r["coi_id"] for r in ps.of_interests(rel, two_interests(spark).select("user_id", "coi_id")).collect()] == ["c1", "c0"]


def test_ranker(spark):
    r = Ranker.empty(spark, ByteEncoder(2), it.Config(min_positive=1, min_negative=1))
    kinds = [(0, 0, [1.0, 0.0], ["green tea"]), (1, 1, [0.0, 1.0], ["mud"]), (2, 2, [0.5, 0.5], ["x"])]
    r.log_reactions(spark.createDataFrame([(7, s, s, f, e, datetime(2024, 1, 31), c) for s, f, e, c in kinds], "user_id long, seq long, event_id long, feedback int, embedding array<double>, at timestamp, candidates array<string>"))
    views = [(7, 5, 5, 0, [0.9, 0.1], 12.0, datetime(2024, 1, 31)), (7, 6, 6, 1, [0.9, 0.1], 99.0, datetime(2024, 1, 31))]
    r.log_views(spark.createDataFrame(views, "user_id long, seq long, event_id long, feedback int, embedding array<double>, seconds double, at timestamp"))
    assert {(x["polarity"], x["view_time"]) for x in r.interests.collect()} == {("pos", 12.0), ("neg", 0.0)}
    docs = spark.createDataFrame([(7, 0, "near", [1.0, 0.1], datetime(2024, 1, 1)), (7, 1, "far", [0.1, 1.0], datetime(2024, 1, 2))], "user_id long, doc_pos int, id string, embedding array<double>, published timestamp")
    assert [x["id"] for x in r.rank(docs, now_()).orderBy("position").collect()] == ["far", "near"]
    assert [x["words"] for x in r.select_top_key_phrases(5, now_()).collect()] == ["green tea"]
    assert r.phrases.filter("cleaned").count() == 1


def test_close_pairs(spark):
    rows = [(0, "pos", k, i, p, 1, 0.0, datetime(2024, 1, 1)) for k, (i, p) in enumerate([("a", [0.0, 0.0]), ("b", [3.0, 0.0]), ("c", [9.0, 0.0])])]
    got = it.close_pairs(spark.createDataFrame(rows, it.INTERESTS)).collect()
    assert [(r["id0"], r["id1"], r["distance"]) for r in got] == [("a", "b", 3.0)]


@pytest.mark.parametrize("spread,every", [(0.5, 8), (30.0, 8), (30.0, 1), (5.0, 3)])
def test_close_pairs_by_pivots(spark, spread, every):
    """Against all pairs, on interests in clusters, alone and all near each other."""
    rng = np.random.default_rng(int(spread))
    rows = []
    for user, n in ((1, 120), (2, 5), (3, 1)):
        centres = rng.normal(scale=spread, size=(6, 4))
        points = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, 4))
        rows += [(user, "pos" if k % 4 else "neg", k, f"c{k}", points[k].tolist(), 1, 0.0, datetime(2024, 1, 1)) for k in range(n)]
    rows.append((2, "pos", 5, "same", rows[121][4], 1, 0.0, datetime(2024, 1, 1)))
    got = it.close_pairs(spark.createDataFrame(rows, it.INTERESTS), every=every).collect()
    want = {(a[0], a[1], *sorted((a[3], b[3]))) for a in rows for b in rows if a[:2] == b[:2] and a[3] < b[3] and np.linalg.norm(np.subtract(a[4], b[4])) < it.MERGE_DISTANCE}
    assert len(got) == len(want) and {tuple(r)[:4] for r in got} == want


@pytest.mark.parametrize("scale,n,block", [(0.0, 400, 16), (6.0, 10_000, 512)])
def test_nearest_of_many_is_the_full_scan(spark, scale, n, block):
    """One user with very many interests, some of no length, some twice; others with few and none."""
    rng = np.random.default_rng(n)
    centres = rng.normal(scale=scale, size=(12, 6))
    point = lambda k: (centres[k % 12] + rng.normal(size=6)).tolist()
    rows = [(1, "pos" if k % 5 else "neg", k, f"c{k}", point(k), 1, 0.0, datetime(2024, 1, 1 + k % 9)) for k in range(n)]
    rows += [(1, "pos", n + k, f"d{k}", rows[k + 1][4], 1, 0.0, datetime(2024, 1, 1)) for k in range(5)] + [(2, p, 0, f"{p}", point(0), 1, 0.0, None) for p in ("pos", "neg")]
    if not scale:
        rows.append((1, "neg", n + 9, "zero", [0.0] * 6, 1, 0.0, None))
    interests = spark.createDataFrame(rows, it.INTERESTS)
    docs = spark.createDataFrame([(1 + k % 3, 0, k, point(k) if k else [0.0] * 6) for k in range(60)], "user_id long, request_id long, doc_pos int, embedding array<double>")
    keys = ["user_id", "request_id", "doc_pos"]
    shown = lambda f: sorted((r["doc_pos"], *((b["coi_id"], round(b["similarity"], 12), b["last_view"]) if b else None for b in (r["_pos"], r["_neg"]))) for r in f.collect())
    assert shown(it.with_nearest_of_many(docs, interests, keys, 100, block)) == shown(it.with_nearest(docs, it.interest_lists(interests)))
    blocks = it.interest_blocks(interests.filter("polarity = 'pos' and user_id = 1"), block)
    assert blocks.filter(F.size("items") > block).count() == 0 and blocks.agg(F.sum(F.size("items"))).first()[0] == interests.filter("polarity = 'pos' and user_id = 1").count()


def test_pivots_spare_comparisons(spark):
    """In clusters far from each other, far fewer than all pairs are compared."""
    rng = np.random.default_rng(0)
    n, centres = 1_000, rng.normal(scale=200, size=(40, 8))
    rows = [(1, "pos", k, f"c{k:04d}", (centres[k % 40] + rng.normal(scale=0.5, size=8)).tolist(), 1, 0.0, datetime(2024, 1, 1)) for k in range(n)]
    pairs = it.close_pairs(spark.createDataFrame(rows, it.INTERESTS), every=16)
    assert pairs.count() == 40 * 25 * 24 // 2
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    assert isinstance(pairs, Classic)
    done = pairs._jdf.queryExecution()
    pairs._jdf.collectToPython()
    found, todo = [], [done.executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        if "Join" in name:
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    assert found and max(found) < n * n / 10


def joined_rows(frame):
    """Rows out of the largest join of a frame's plan, once it has run."""
    done = frame._jdf.queryExecution()
    frame._jdf.collectToPython()
    found, todo = [0], [done.executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        if "Join" in name:
            found.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return max(found)


@pytest.mark.parametrize("values", [1 << 19, 4_000])
def test_close_pairs_where_pivots_rule_out_nothing(spark, monkeypatch, values):
    """Points about as far from each other as from every pivot, and many copies: no join has a row for each pair."""
    monkeypatch.setattr(it, "GROUP_VALUES", values)
    rng = np.random.default_rng(3)
    n, dim = 900, 16
    points = rng.normal(size=(n, dim))
    points[500:700] = points[500]
    rows = [(1, "pos", k, f"c{k:04d}", points[k].tolist(), 1, 0.0, datetime(2024, 1, 1)) for k in range(n)]
    pairs = it.close_pairs(spark.createDataFrame(rows, it.INTERESTS), below=4.0)
    gaps = np.linalg.norm(points[:, None] - points[None], axis=2)
    want = {(f"c{a:04d}", f"c{b:04d}"): gaps[a, b] for a, b in zip(*np.nonzero(np.triu(gaps < 4.0, 1)), strict=True)}
    got = pairs.collect()
    assert len(got) == len(want) > 200 * 199 // 2 and {(r["id0"], r["id1"]) for r in got} == set(want)
    assert all(r["distance"] == pytest.approx(want[r["id0"], r["id1"]], abs=1e-9) for r in got)
    assert joined_rows(pairs) < n * n / 10


@pytest.mark.parametrize("n", [12, 200])
def test_close_pairs_pass_over_points_that_are_not_finite(spark, n):
    """Whether they would be pivots or not; points of other widths are near nothing either."""
    rows = [(1, "pos", k, f"c{k:03d}", [10.0 * (k // 2), k % 2 * 1.0] if k % 3 else [[float("nan"), 0.0], [None, 1.0], [0.0], None, [float("inf"), 0.0]][k // 3 % 5], 1, 0.0, None) for k in range(n)]
    want = {(f"c{k:03d}", f"c{k + 1:03d}") for k in range(0, n, 2) if k % 3 and (k + 1) % 3}
    narrow = [f"c{k:03d}" for k in range(0, n, 3) if k // 3 % 5 == 2]
    want |= {(a, b) for a in narrow for b in narrow if a < b}
    assert {(r["id0"], r["id1"]) for r in it.close_pairs(spark.createDataFrame(rows, it.INTERESTS)).collect()} == want


def history(spark, queries):
    """queries: (session, count, relevances)."""
    rows, pos = [], 0
    for s, c, rel in queries:
        for rank, r in enumerate(rel):
            rows.append((3, pos, str(pos), s, c, s * 10 + c, "w x", rank, f"u{pos % 3}", "d", 1, r, 2, 2 if r else 0))
            pos += 1
    return spark.createDataFrame(rows, "user_id long, hist_pos long, id string, session long, query_count long, query_id long, query_words string, rank int, url string, domain string, day int, relevance int, user_feedback int, user_action int")


def test_sample_spans_pass_over_irrelevant_queries(spark):
    h = history(spark, [(1, 0, [0, 1]), (2, 1, [2, 0, 0]), (3, 2, [0, 0])])
    assert [tuple(r) for r in sm.sample_spans(h).collect()] == [(3, 2, 5)]
    assert sm.sample_spans(history(spark, [(1, 0, [0, 0])])).count() == 0
    r = sm.training_samples(h).first()
    assert r["sample_id"] == 3 and np.shape(r["inputs"]) == (3, 50) and sum(r["target"]) == pytest.approx(1) and r["target"][0] == max(r["target"])
    # a run of one session is one query, whatever its counts
    assert [tuple(r) for r in sm.sample_spans(history(spark, [(1, 0, [1]), (2, 1, [1]), (2, 2, [0])])).collect()] == [(3, 1, 3)]


def spans_one_by_one(rows):
    """By user, from rows (user, hist_pos, session, query_count, relevance): each entry looked at in turn."""
    found = {}
    for user in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == user)
        stop = len(own)
        while stop:
            other = [k for k in range(stop) if own[k][1] != own[stop - 1][1] and own[k][2] != own[stop - 1][2]]
            start = other[-1] + 1 if other else 0
            if any((r[3] or 0) > 0 for r in own[start:stop]):
                found[user] = (own[start][0], own[stop - 1][0] + 1)
                break
            stop = start
    return found


def test_sample_spans_of_mixed_runs(spark):
    """Sessions and counts that change alone, together and back again; positions with gaps; users without a hit."""
    rng = np.random.default_rng(11)
    rows = []
    for user in range(150):
        pos = np.cumsum(rng.integers(1, 3, int(rng.integers(1, 25))))
        rows += [(user, int(p), int(rng.integers(0, 3)), int(rng.integers(0, 3)), int(rng.random() < 0.15) if rng.random() < 0.9 else None) for p in pos]
    h = spark.createDataFrame(rows, "user_id long, hist_pos long, session long, query_count long, relevance int")
    want = spans_one_by_one(rows)
    assert 20 < len(want) < 150 and {r["user_id"]: (r["start"], r["stop"]) for r in sm.sample_spans(h).collect()} == want
    plan = sm.sample_spans(h)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsIn" not in plan and plan.count("hashpartitioning(user_id#") == 1


def test_only_histories_of_samples_are_aggregated(spark, monkeypatch):
    """Users without a list of ranks have no sample; their histories don't reach the features' sums, and none is read twice."""
    kept = []
    monkeypatch.setattr(sm, "features_50", lambda before, documents, f=sm.features_50: (kept.append(before), f(before, documents))[1])
    h = history(spark, [(1, 0, [0, 1]), (2, 1, [2, 0, 0])])
    bad = history(spark, [(1, 0, [0, 1]), (2, 1, [2, 0, 0])]).withColumns({"user_id": F.lit(4).cast("long"), "rank": F.lit(0)})
    samples = sm.training_samples(h.unionByName(bad))
    assert [r["sample_id"] for r in samples.collect()] == [3]
    assert sorted((r["user_id"], r["hist_pos"]) for r in kept[0].collect()) == [(3, 0), (3, 1)]
    plan = samples._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsIn" not in plan and "Scan ExistingRDD" not in plan


def test_agreement(spark):
    r = sm.agreement(spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([2.0, 0.0], [1.0, 0.0])], "want array<double>, got array<double>")).first()
    assert (r["mae"], r["mre"], r["mse"], r["mean_cosine"]) == pytest.approx((0.25, 0.125, 0.25, 1.0))


def test_extract(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "too few"), (3, None)], "id long, t string")
    scorer = PhraseScorer.random(8)
    got = kp.extract(docs, "id", "t", ByteEncoder(8), scorer, max_count=4).orderBy("position").collect()
    words = "one two three four five six".split()
    scores = scorer.scores(ByteEncoder(8).encode(words))
    phrases = [" ".join(words[i : i + n]) for n in range(1, 6) for i in range(len(words) - n + 1)]
    want = sorted(zip(-scores, phrases, strict=True))[:4]
    assert [(r["id"], r["phrase"]) for r in got] == [(1, p) for _, p in want]
    for bad in ({"max_count": 0}, {"min_score": float("nan")}):
        with pytest.raises(ValueError):
            kp.extract(docs, "id", "t", ByteEncoder(8), scorer, **bad)


def test_manifest(tmp_path):
    (tmp_path / "m.json").write_text('[{"id": "a", "url_suffix": "x/a"}, {"id": "b", "url_suffix": "x/b", "chunk_size": 5}]')
    assert tables.read_manifest(f"{tmp_path}/m.json") == {"a": {"url_suffix": "x/a", "chunk_size": None}, "b": {"url_suffix": "x/b", "chunk_size": 5}}
    (tmp_path / "m.json").write_text('[{"id": "a"}]')
    with pytest.raises(ValueError):
        tables.read_manifest(f"{tmp_path}/m.json")


def test_command_line(spark, tmp_path, capsys):
    main(["generate", f"{tmp_path}/g", "--users", "2"])
    assert spark.read.parquet(f"{tmp_path}/g").count() == 100
    head = "session_id,user_id,query_id,day,query_words,url,domain,relevance,position,query_counter\n"
    lines = [f'{s},{u},{s},1,"a,b",u{p},d,{int(p == 2)},{p},{s}' for u in range(6) for s in range(3) for p in range(1, 11)]
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "all.csv").write_text(head + "\n".join(lines) + "\n")
    main(["convert", f"{tmp_path}/h", f"{tmp_path}/s"])
    assert tables.read_samples(spark, f"{tmp_path}/s").count() == 6
    main(["train", f"{tmp_path}/s", f"{tmp_path}/net.npz", "--batch-size", "2"])
    main(["evaluate", f"{tmp_path}/s", f"{tmp_path}/net.npz"])
    assert "mean cost" in capsys.readouterr().out
    (tmp_path / "c.json").write_text('{"rerank_mode": 1, "histories": [], "documents": [{"id": "a", "rank": 0, "title": "t"}, {"id": "b", "rank": 1, "title": "u"}]}')
    main(["run", f"{tmp_path}/c.json", f"{tmp_path}/out"])
    assert spark.read.json(f"{tmp_path}/out/outcomes").count() == 2 and spark.read.json(f"{tmp_path}/out/faults").first()["code"] == "NoCoi"
