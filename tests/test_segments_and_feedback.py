"""Scans by segments against windows over users, and the feedback stream against the batch operators."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import history as hs
from tessera.operators import segments as sg
from tessera.operators.ranking import analytics
from tessera.plans.rerank import feedback_faults
from tessera.streaming.feedback import REACTION, SHOWN, completed_requests, settle_stream

ROWS = "user_id long, hist_pos long, session long, query_count long, query_id long, relevance int, clicked boolean"


def long_history(seed, n=400):
    """One user holds most rows; runs are short, long and longer than segments; some keys and flags are null."""
    rnd = random.Random(seed)
    rows = []
    for user, size in ((1, n), (2, 7), (3, 1), (4, 30)):
        session, query = 0, 0
        stay = rnd.choice([0.5, 0.9, 0.98])
        for pos in range(size):
            if rnd.random() > stay:
                session, query = session + rnd.randint(0, 1), rnd.randint(0, 3)
            rows.append((user, pos, None if rnd.random() < 0.01 else session, query, query, rnd.choice([0, 0, 0, 1, 2]), rnd.choice([True, False, False, None])))
    return rows


@pytest.mark.parametrize("seed,segment", [(0, 5), (1, 1), (2, 37), (3, 100_000)])
def test_segments_are_windows(spark, seed, segment):
    rows = spark.createDataFrame(long_history(seed), ROWS)
    key = lambda f: sorted(map(tuple, f.collect()), key=lambda r: (r[0], r[1]))
    clean = rows.filter("clicked is not null")
    dense = clean.withColumn("hist_pos", F.col("hist_pos") * 3)  # positions may have gaps
    for own in (clean, dense):
        assert key(sg.with_runs(own, segment)) == key(hs.with_runs(own))
        assert key(sg.infer_actions(own, segment)) == key(hs.infer_actions(own))
    before = {}
    want = [(*r, before.setdefault(r[0], []).append(r[5]) or sum(before[r[0]]) - r[5]) for r in sorted(long_history(seed), key=lambda r: r[:2])]
    assert key(sg.cumulative_sum(rows, F.col("relevance"), "so_far", segment)) == want


def test_a_long_history_is_many_tasks(spark):
    rows = spark.range(20_000).select(F.expr("id div 100000").alias("user_id"), F.col("id").alias("hist_pos"), (F.col("id") / 7).cast("long").alias("session"), F.lit(0).alias("query_count"), (F.col("id") % 3 == 0).alias("clicked"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = lambda f: [r["n"] for r in f.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("run_id"), F.sum("run_clicks")).collect()]
        assert len(tasks(hs.with_runs(rows))) == 1
        split = tasks(sg.with_runs(rows, 100))
        assert len(split) == 4 and max(split) < 10_000
        # the history itself is shuffled once; the other exchanges move summaries
        plan = sg.with_runs(rows, 100)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(user_id#") >= 2 and "BroadcastExchange" not in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_queries_by_segments(spark, sf_dir):
    from tessera.plans.queries import QUERIES

    for name in ("history_runs", "user_action_inference"):
        assert sorted(map(tuple, QUERIES[f"{name}_by_segments"](spark, sf_dir).collect())) == sorted(map(tuple, QUERIES[name](spark, sf_dir).collect()))


# --- feedback -------------------------------------------------------------------------------------

T0 = datetime(2024, 3, 1)
SHOWN_TYPE = "user_id long, request_id long, shown_at timestamp, doc_pos int, id string, rank int, ltr_score double, context double, final_rank int"
REACTION_TYPE = "user_id long, id string, at timestamp, hist_pos long, relevance int, user_feedback int"


def feedback(seed, n=12):
    rnd = random.Random(seed)
    shown, reactions, pos = [], [], 0
    for q in range(n):
        at = T0 + timedelta(hours=5 * q)
        order = rnd.sample(range(6), 6)
        shown += [(q % 3, q, at, k, f"q{q}d{k}", k, rnd.random(), rnd.random(), order[k]) for k in range(6)]
        for _ in range(rnd.choice([0, 0, 3, 8])):
            # some too early, some too late, some of documents that weren't shown, several of one document
            late = timedelta(hours=rnd.choice([-1, 0, 1, 5, 24, 25, 40]))
            reactions.append((q % 3, f"q{q}d{rnd.randrange(7)}", at + late, pos, rnd.randrange(3), rnd.randrange(3)))
            pos += 1
    return shown, reactions


def test_feedback_stream_equals_batch(spark, tmp_path):
    shown, reactions = feedback(1)
    far = T0 + timedelta(days=400)
    closing = [(99, 10**6, far, 0, "end", 0, 0.0, 0.0, 0)], [(99, "other", far, 10**6, 0, 2)]
    split = lambda rows, when: [[r for r in rows if lo <= r[when] < lo + timedelta(hours=30)] for lo in (T0 - timedelta(hours=2) + timedelta(hours=30) * k for k in range(4))]
    parts = list(zip(split(shown, 2), split(reactions, 2), strict=True)) + [closing]

    def run():
        s, r = (spark.readStream.schema(t).parquet(f"{tmp_path}/{n}") for n, t in (("s", SHOWN_TYPE), ("r", REACTION_TYPE)))
        q = settle_stream(completed_requests(s, r), f"{tmp_path}/faults", f"{tmp_path}/ndcg", f"{tmp_path}/c")
        q.processAllAvailable()
        q.stop()

    for k, (s, r) in enumerate(parts):
        spark.createDataFrame(s, SHOWN_TYPE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/s")
        spark.createDataFrame(r, REACTION_TYPE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/r")
        if k in (1, 4):  # a start and a restart
            run()
    ranked = spark.createDataFrame(shown, SHOWN_TYPE)
    in_time = {(r[0], r[1]): next(x[2] for x in shown if x[4] == r[1]) for r in reactions if any(x[4] == r[1] for x in shown)}
    counted = [r for r in reactions if (r[0], r[1]) in in_time and timedelta(0) <= r[2] - in_time[r[0], r[1]] <= timedelta(days=1)]
    history = spark.createDataFrame(counted, REACTION_TYPE)
    rounded = lambda f: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in f.collect())
    names = ("user_id", "request_id", "stage", "code")
    faults = spark.read.parquet(f"{tmp_path}/faults").filter("user_id <> 99").select(*names)
    assert rounded(faults) == rounded(feedback_faults(ranked, history).select(*names))
    want = analytics(ranked, history)
    assert rounded(spark.read.parquet(f"{tmp_path}/ndcg").select(*want.columns)) == rounded(want)
    assert want.count() > 2 and faults.count() > 2 and len(SHOWN) + len(REACTION) == 9
