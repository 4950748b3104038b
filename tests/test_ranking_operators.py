"""Histories, features, interests, context, analytics and key phrases against known values."""

import math

import numpy as np
from datetime import datetime
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import vector as v
from tessera.operators import features as ft
from tessera.operators import history as hs
from tessera.operators import interests as it
from tessera.operators import keyphrase as kp
from tessera.operators import ranking as rk

SKIP, MISS, CLICK0, CLICK1, CLICK2 = range(5)
ACTIONS = {SKIP: (1, 0), MISS: (0, 0), CLICK0: (2, 0), CLICK1: (2, 1), CLICK2: (2, 2)}


def history(spark, rows, **columns):
    """rows: (action, url, domain, day, rank); ten rows a query, one session."""
    out = []
    for i, (action, url, domain, day, rank) in enumerate(rows):
        user_action, relevance = ACTIONS[action]
        out.append((0, i, str(i), 1, i // 10, i // 10, f"1 2 {i // 10}", rank, url, domain, day, relevance, 2, user_action))
    frame = spark.createDataFrame(out, "user_id long, hist_pos long, id string, session long, query_count long, query_id long, query_words string, rank int, url string, domain string, day int, relevance int, user_feedback int, user_action int")
    return hs.with_runs(hs.with_actions(frame))


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def array(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_vectors(spark):
    assert value(spark, v.cosine(array(1, 2, 3), array(1, 5, 9))) == pytest.approx(0.98181057, abs=1e-6)
    assert value(spark, v.cosine(array(1, 2, 3), array(4, 5, 6))) == pytest.approx(0.97463185, abs=1e-6)
    assert value(spark, v.cosine(array(0, 0, 0), array(4, 5, 6))) == 1
    assert value(spark, v.shift(array(1, 1, 1), array(2, 3, 4), 0.1)) == pytest.approx([1.1, 1.2, 1.3])
    assert value(spark, v.l2_distance(array(1, 2), array(4, 6))) == 5
    assert value(spark, v.softmax(array(1, 1, 1, 1))) == pytest.approx([0.25] * 4)
    assert value(spark, v.kl_divergence(array(0.5, 0.5), array(0.5, 0.5))) == pytest.approx(0)
    with pytest.raises(Exception, match="not finite"):
        value(spark, v.l2_norm(array(1, float("nan"))))


@pytest.mark.parametrize("days,want", [(0, 1.0), (5, 0.5859145), (30, 0.0), (40, 0.0), (-3, 1.0)])
def test_decay(spark, days, want):
    got = value(spark, v.decay(30.0, F.timestamp_seconds(F.lit(10_000_000 + days * 86400)), F.timestamp_seconds(F.lit(10_000_000))))
    assert got == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize("text,want", [("a!? b", "a b"), ("U.S.A.", "U S A"), ("  x  ", "x"), ("$ 5", "5"), ("né—e", "né e")])
def test_clean_key_phrase(spark, text, want):
    assert value(spark, v.clean_key_phrase(F.lit(text))) == want == kp.clean(text)


def test_sort_puts_nan_last(spark):
    rows = spark.createDataFrame([(float("nan"),), (1.0,), (None,), (3.0,)], "x double").orderBy(*v.nan_lowest_desc(F.col("x")))
    assert [r["x"] for r in rows.collect()][:2] == [3.0, 1.0]


def test_probabilities(spark):
    h = history(spark, [(a, u, "e", 1, i) for i, (a, u) in enumerate([(CLICK1, "a/b"), (CLICK2, "a/b"), (CLICK1, "d.f"), (CLICK1, "r"), (CLICK1, "a/b"), (MISS, "d.f"), (MISS, "d.f"), (CLICK0, "a/b")])])
    s = ft.outcome_sums(h).filter("kind = 'u'").withColumn("c1", F.col("n_click") - F.col("n_click2"))
    got = {r["key"]: r for r in s.select("key", ft.conditional_probability(F.col("c1"), F.col("n")).alias("c"), ft.conditional_probability(F.col("n_miss"), F.col("n"), True).alias("m")).collect()}
    assert got["a/b"]["c"] == 0.5 and got["d.f"]["m"] == pytest.approx(3 / 5)


def test_reciprocal_ranks(spark):
    h = history(spark, [(a, str(i), str(i % 2), 0, i) for i, a in enumerate(range(5))])
    s = ft.outcome_sums(h)
    total = s.filter("kind = 'u'").agg(*[F.sum(c).alias(c) for c in ("n", "r", "n_miss", "r_miss", "n_skip", "r_skip", "n_click", "r_click")]).first()
    mrr = lambda o="": (0.283 + total["r" + o]) / (1 + total["n" + o])
    assert [mrr(), mrr("_miss"), mrr("_skip"), mrr("_click")] == pytest.approx([0.42772225, 0.3915, 0.6415, 0.24433333], abs=1e-6)
    dom = s.filter("kind = 'd' and key = '0'").agg(F.sum("r").alias("r"), F.sum("n").alias("n")).first()
    assert (0.283 + dom["r"]) / (1 + dom["n"]) == pytest.approx(0.45408335, abs=1e-6)


URLS = [(SKIP, "1"), (CLICK1, "2"), (SKIP, "3333"), (SKIP, "4"), (CLICK1, "55"), (SKIP, "6"), (MISS, "7"), (CLICK2, "8"), (SKIP, "9"), (SKIP, "10"), (CLICK1, "1"), (CLICK1, "2"), (CLICK1, "4"), (CLICK1, "3333"), (SKIP, "5"), (MISS, "6"), (CLICK1, "7"), (CLICK1, "8"), (CLICK1, "9"), (CLICK1, "10")]


def test_snippet_scores(spark):
    h = history(spark, [(a, u, "e", 1, i % 10) for i, (a, u) in enumerate(URLS)])
    scores = {r["key"]: r["score"] for r in ft.snippet_scores(h, False).filter("kind = 'u'").groupBy("key").agg(F.sum("score").alias("score")).collect()}
    assert scores["3333"] == pytest.approx(-1 / 3 + 1 / 4) and scores["6"] / 2 == pytest.approx(-0.16666667)


def test_seasonality(spark):
    days = [(MISS, 1, "1"), (CLICK1, 1, "1"), (MISS, 2, "1"), (CLICK1, 1, "1"), (MISS, 2, "2"), (CLICK1, 6, "2"), (CLICK1, 0, "2"), (SKIP, 6, "1"), (CLICK1, 3, "1"), (SKIP, 3, "2"), (CLICK1, 2, "1"), (CLICK1, 1, "2"), (CLICK1, 2, "2"), (CLICK1, 0, "2"), (CLICK1, 5, "1"), (CLICK1, 0, "1"), (CLICK1, 5, "1"), (CLICK1, 0, "1"), (CLICK1, 3, "3"), (CLICK1, 4, "3"), (CLICK1, 5, "3"), (MISS, 1, "4")]
    got = {r["domain"]: r["seasonality"] for r in ft.seasonality(history(spark, [(a, "u", d, day, i % 10) for i, (a, day, d) in enumerate(days)])).collect()}
    assert got == pytest.approx({"1": 0.625, "2": 0.41666666, "3": 3.75})


def test_features_reject_bad_ranks(spark):
    h = history(spark, [(CLICK1, "a", "b", 0, 0)])
    docs = spark.createDataFrame([(0, 0, 2, 9, ["x"], "a", "b"), (0, 2, 2, 9, ["x"], "a", "b")], "user_id long, rank int, session long, query_id long, terms array<string>, url string, domain string")
    with pytest.raises(Exception, match="ranks must be"):
        ft.features_50(h, docs).collect()


def test_features_without_history(spark):
    h = history(spark, [(CLICK1, "a", "b", 0, 0)]).filter("user_id < 0")
    docs = spark.createDataFrame([(0, k, 2, 9, ["x", "y", "x"], "a", "b") for k in range(2)], "user_id long, rank int, session long, query_id long, terms array<string>, url string, domain string")
    rows = [r["features"] for r in ft.features_50(h, docs).orderBy("rank").collect()]
    want = [0.0] * 50
    for i in (1, 8, 12, 13, 14, 15, 18, 28, 35):
        want[i] = 0.283
    want[31], want[48] = 3.0, 2.0
    assert rows[0] == pytest.approx([1.0, *want[1:]]) and rows[1] == pytest.approx([2.0, *want[1:]])


def test_runs_are_neighbours_only(spark):
    rows = [(0, i, str(i), s, 0, 0, "w", 0, "u", "d", 0, 1, 2, 2) for i, s in enumerate([1, 1, 2, 1, 1])]
    frame = spark.createDataFrame(rows, "user_id long, hist_pos long, id string, session long, query_count long, query_id long, query_words string, rank int, url string, domain string, day int, relevance int, user_feedback int, user_action int")
    got = hs.with_runs(hs.with_actions(frame)).orderBy("hist_pos").collect()
    assert [(r["run_id"], r["click_index"], r["run_clicks"]) for r in got] == [(1, 0, 2), (1, 1, 2), (2, 0, 1), (3, 0, 2), (3, 1, 2)]


def test_inferred_actions(spark):
    rows = [(0, i, q, r) for i, (q, r) in enumerate([(1, 0), (1, 1), (1, 0), (2, 0), (1, 0), (1, 2)])]
    got = hs.infer_actions(spark.createDataFrame(rows, "user_id long, hist_pos long, query_id long, relevance int")).orderBy("hist_pos").collect()
    assert [r["inferred_action"] for r in got] == [1, 2, 0, 0, 1, 2]


# --- interests ------------------------------------------------------------------------------------


def interests(spark, pos, neg=()):
    now = datetime(2024, 1, 31)
    rows = [(0, p, k, f"{p}{k}", [float(x) for x in point], 1, 0.0, now) for p, points in (("pos", pos), ("neg", neg)) for k, point in enumerate(points)]
    return spark.createDataFrame(rows, it.INTERESTS)


def test_assign(spark):
    docs = spark.createDataFrame([(0, 0, "d", [2.0, 3.0, 4.0])], "user_id long, request_id long, id string, embedding array<double>")
    pos, neg = [[1, 0, 0], [0, 1, 0], [0, 0, 1]], [[10, 10, 0], [0, 10, 10], [10, 0, 10]]
    r = it.assign(docs, interests(spark, pos, neg)).first()
    assert (r["coi_id"], r["pos_similarity"], r["neg_similarity"]) == ("pos2", pytest.approx(0.74278134, abs=1e-6), pytest.approx(0.91914505, abs=1e-6))
    assert it.assign(docs, interests(spark, pos)).first()["neg_similarity"] == -1
    assert it.assign(docs, interests(spark, [], neg)).first()["coi_id"] is None
    tie = it.assign(docs, interests(spark, [[1, 1, 1], [2, 2, 2]])).first()
    assert tie["coi_id"] == "pos0"


def test_learning_uses_what_it_learned(spark):
    events = spark.createDataFrame([(0, k, k, "like", [0.0, 0.0, x], 0.0, datetime(2024, 1, 1)) for k, x in enumerate((4.9, 5.0))], "user_id long, seq long, event_id long, kind string, embedding array<double>, seconds double, at timestamp")
    got = it.learn(interests(spark, [[0, 0, 0]]), events).collect()
    assert len(got) == 1 and got[0]["point"] == pytest.approx([0, 0, 0.941]) and got[0]["view_count"] == 3


def test_view_time_goes_to_the_closest(spark):
    events = spark.createDataFrame([(0, 0, 0, "view", [0.0, 1.0], 7.0, datetime(2024, 1, 1)), (1, 0, 0, "view", [0.0, 1.0], 7.0, datetime(2024, 1, 1))], "user_id long, seq long, event_id long, kind string, embedding array<double>, seconds double, at timestamp")
    got = {r["coi_id"]: r["view_time"] for r in it.learn(interests(spark, [[1, 0], [0.1, 1]]), events).collect()}
    assert got == {"pos0": 0.0, "pos1": 7.0}


def test_merge_closest():
    coi = lambda i, *p: it.Coi(i, np.array(p, float))
    out = it.merge_closest([coi("a", 0, 0), coi("b", 1, 0), coi("c", 20, 0), coi("d", 1.5, 0)])
    assert sorted(c.id for c in out) == ["a", "c"] and next(c for c in out if c.id == "a").count == 3
    # the closest pair (b, d) merges first, then with a
    assert next(c for c in out if c.id == "a").point == pytest.approx([0.625, 0])


def test_sync_keeps_local(spark):
    local, remote = interests(spark, [[0, 0], [50, 0]]), interests(spark, [[1, 1], [50, 0], [100, 0]])
    got = {r["coi_id"]: r["point"] for r in it.synchronize(local, remote).collect()}
    assert got == {"pos0": [0, 0], "pos1": [50, 0], "pos2": [100, 0]}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.floats(-20, 20), st.floats(-20, 20)), min_size=0, max_size=8), st.randoms())
def test_merge_does_not_depend_on_order(points, rnd):
    cois = [it.Coi(f"c{k}", np.array(p)) for k, p in enumerate(points)]
    a = {c.id: tuple(c.point.round(9)) for c in it.merge_closest(cois)}
    rnd.shuffle(cois)
    assert {c.id: tuple(c.point.round(9)) for c in it.merge_closest(cois)} == a


@pytest.mark.parametrize("bad", [{"shift_factor": 2}, {"threshold": -2}, {"min_positive": 0}, {"gamma": 1.5}, {"penalty": ()}, {"penalty": (0.5, 1.0)}, {"penalty": (math.inf,)}])
def test_config_checks(bad):
    with pytest.raises(ValueError):
        it.Config(**bad)


def test_relevance(spark):
    rows = [(0, "pos", k, f"p{k}", [1.0], 1 + k, 10.0 * k, datetime(2024, 1, 1)) for k in range(3)]
    now = F.lit("2024-01-01").cast("timestamp")
    got = [r["relevance"] for r in rk.coi_relevance(spark.createDataFrame(rows, it.INTERESTS), now).orderBy("coi_id").collect()]
    assert got == pytest.approx([1 / 6, 2 / 6 + 1 / 3, 3 / 6 + 2 / 3], abs=1e-5)


# --- context, ranks, analytics --------------------------------------------------------------------


def test_context(spark):
    rows = [(0, 0, k, *x) for k, x in enumerate([(0.9, 1.0, 10.0, 9.0), (0.5, 6.0, 4.0, 3.0), (0.3, 8.0, 2.0, 12.0)])]
    docs = spark.createDataFrame(rows, "user_id long, request_id long, doc_pos int, ltr_score double, pos_similarity double, neg_similarity double, similarity double")
    got = [r["context"] for r in rk.context(docs).orderBy("doc_pos").collect()]
    assert got == pytest.approx([(5 / 6 + 1 + 0.9 + 8 / 17 * 7) / 10, (5 / 11 + 1 / 7 + 0.5 + 8 / 11 * 7) / 10, (5 / 13 + 1 / 9 + 0.3 + 8 / 20 * 7) / 10])


@pytest.mark.parametrize("k,want", [(2, 0.009846116), (4, 0.48914248), (100, 0.5098679)])
def test_ndcg(spark, k, want):
    rows = [(0, 0, i, float(r), float(s)) for i, (r, s) in enumerate([(1, 12), (4, 9), (10, 7), (3, 5), (0, 4), (6, 1)])]
    docs = spark.createDataFrame(rows, "user_id long, request_id long, doc_pos int, relevance double, s double")
    assert rk.gains(docs, {"ndcg": "s"}, ["user_id"], k).first()["ndcg"] == pytest.approx(want, abs=1e-6)


def test_rank_by_score_ascending_or_date(spark):
    docs = spark.createDataFrame([(0, 0, "a", [1.0, 0.0], datetime(2024, 1, 2)), (0, 1, "b", [0.0, 1.0], datetime(2024, 1, 5)), (0, 2, "c", [0.7, 0.7], datetime(2024, 1, 1))], "user_id long, doc_pos int, id string, embedding array<double>, published timestamp")
    now = F.lit("2024-01-31").cast("timestamp")
    own = interests(spark, [[1, 0], [1, 0.1]], [[0, 1], [0.1, 1]])
    order = lambda rows: [r["id"] for r in rows.orderBy("position").collect()]
    assert order(rk.rank_documents(docs, own, now)) == ["b", "c", "a"]
    assert order(rk.rank_documents(docs, interests(spark, [[1, 0]]), now)) == ["b", "a", "c"]


# --- key phrases ----------------------------------------------------------------------------------


def test_ngrams(spark):
    words = "a b a b c d".split()
    docs = spark.createDataFrame([(1, words), (2, ["few", "words"])], "id long, w array<string>")
    got = {(r["n"], r["phrase"]): (r["first_pos"], r["mentions"]) for r in kp.candidates(docs, "id", F.col("w")).collect()}
    want = {}
    for n in range(1, 6):
        for i in range(len(words) - n + 1):
            p, m = want.get((n, " ".join(words[i : i + n])), (i, 0))
            want[n, " ".join(words[i : i + n])] = (p, m + 1)
    assert got == want


def test_select_phrases():
    points = {"key": np.array([1.0, 1, 0]), "phrase": np.array([1.0, 0, 0.1]), "words": np.array([0.0, 1, 0.2])}
    out = dict(kp.select_phrases(points, np.array([1.0, 0.5, 0]), 3, 0.9))
    assert set(out) == set(points) and max(out.values()) == 1
    assert len(kp.select_phrases(points, np.array([1.0, 0.5, 0]), 2, 0.9)) == 2 and kp.select_phrases({}, np.ones(3), 2, 0.9) == []


def test_unify():
    seen = []
    encode = lambda w: seen.append(w) or np.ones(2)
    out = kp.unify({"known": np.zeros(2)}, ["known", "new!", "  ", "new"], encode)
    assert list(out) == ["known", "new"] and "known" not in seen


def test_top_key_phrases(spark):
    rows = [(0, "pos0", w) for w in "abcd"] + [(0, "pos1", "z")]
    now = F.lit("2024-01-31").cast("timestamp")
    own = interests(spark, [[1, 0], [0, 1]])
    got = rk.top_key_phrases(spark.createDataFrame(rows, "user_id long, coi_id string, words string"), own, now, 3).orderBy("position").collect()
    assert [(r["coi_id"], r["words"]) for r in got] == [("pos0", "d"), ("pos1", "z"), ("pos0", "c")]
