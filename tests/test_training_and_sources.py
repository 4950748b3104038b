"""Stored samples, keyed epochs, one job an epoch, and histories as Python data sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import listnet as ln
from tessera.operators import training as tr
from tessera.operators.history import infer_actions
from tessera.sources import datasource as ds
from tessera.sources import tables

SAMPLES = "sample_id long, inputs array<array<double>>, target array<double>"


def samples(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(1000 - 7 * k, rng.random((10, 50)).tolist(), ln.softmax(rng.random(10)).tolist()) for k in range(n)], SAMPLES)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    orders = [tr.Permutation(n, seed, epoch) for seed, epoch in ((0, 0), (0, 1), (1, 0))]
    at = [o.place(np.arange(n)) for o in orders]
    for o, a in zip(orders, at, strict=True):
        assert sorted(a) == list(range(n)) and (o.number(a) == np.arange(n)).all()
        assert (a == o.place(np.arange(n))).all()
    if n > 16:
        assert not (at[0] == at[1]).all() and not (at[0] == at[2]).all()
        # places of neighbours are unrelated, and no third of the epoch favours a third of the numbers
        assert abs(np.corrcoef(at[0], np.arange(n))[0, 1]) < 4 / np.sqrt(n)
    with pytest.raises(IndexError):
        orders[0].place(np.array([n]))


def test_places_of_large_epochs():
    o = tr.Permutation(10**15 + 7, 3)
    x = np.random.default_rng(0).integers(0, o.n, 1000)
    assert (o.number(o.place(x)) == x).all() and (o.place(x) < o.n).all()


def test_sums_of_gradients():
    rng = np.random.default_rng(1)
    net = ln.ListNet.random(2)
    x, t = rng.normal(size=(7, 10, 50)), np.array([ln.softmax(rng.random(10)) for _ in range(7)])
    g, cost = net.sums(x, t)
    each = [net.gradients(a, b) for a, b in zip(x, t, strict=True)]
    assert np.allclose(g, np.sum([ln.ListNet(e[0]).flat() for e in each], axis=0)) and cost == pytest.approx(sum(e[1] for e in each))


def test_sample_store(spark, tmp_path):
    store = tr.SampleStore.write(samples(spark, 23).repartition(5), f"{tmp_path}/s")
    assert store.n == 23 and tr.SampleStore.open(spark, f"{tmp_path}/s").n == 23
    ids = {r["number"]: r["sample_id"] for r in store.rows().collect()}
    assert [ids[k] for k in range(23)] == sorted(ids.values())
    assert sorted(r["number"] for r in store.get([3, 22, 0]).collect()) == [0, 3, 22]
    for bad in ([23], [0, -1]):
        with pytest.raises(IndexError, match="out of bounds, there are 23"):
            store.get(bad)
    order = tr.Permutation(23, 5, 1)
    seen = [r["number"] for b in range(4) for r in store.batch(b, 5, order).collect()]
    assert len(set(seen)) == 20 and store.batch(4, 5, order).count() == 0
    assert set(seen) == set(order.number(np.arange(20)))
    # numbers are looked up in their row groups
    plan = store.get([3])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(number,3)" in plan
    assert store.chunks(20, 8, 5) == [(0, 8), (8, 16)] and store.chunks(20, 8) == [(0, 8), (8, 16)]
    for bad in (lambda: store.chunks(20, 0), lambda: store.chunks(20, 8, 9), lambda: store.chunks(3, 8, 5)):
        with pytest.raises(ValueError):
            bad()


def test_split_sizes():
    assert [tr.split_sizes(10, e) for e in (0, 0.25, 1)] == [(10, 0), (7, 3), (0, 10)]
    for n, e in ((0, 0.1), (10, -0.1), (10, 1.1), (10, float("nan")), (10, float("inf")), (10, 1e-40), (10, 0.96), (10, 0.01)):
        with pytest.raises(ValueError):
            tr.split_sizes(n, e)
    assert (tr.batch_size_of(0, 7), tr.batch_size_of(3, 7)) == (7, 3)
    with pytest.raises(ValueError):
        tr.batch_size_of(8, 7)


def test_split_reads_one_range(spark):
    fit, held = ln.split_samples(samples(spark, 40).repartition(6), 0.3)
    assert (fit.count(), held.count()) == (28, 12)
    assert fit.agg(F.max("sample_id")).first()[0] < held.agg(F.min("sample_id")).first()[0]


def jobs_of(spark, group, f):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return f(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_one_job_an_epoch(spark, tmp_path):
    """The same network as by a job for each batch; jobs grow with epochs, not with batches."""
    store = tr.SampleStore.write(samples(spark, 26, 4), f"{tmp_path}/s")
    want = tr.train_by_batches(store, 26, 2, 6, 0.05, seed=9)
    (net, costs), few = jobs_of(spark, "few", lambda: tr.train_by_epochs(store.rows(), 26, 2, 6, 0.05, seed=9, evaluation=store.rows(), tasks=3))
    assert np.allclose(net.flat(), want.flat()) and len(costs) == 2
    assert costs[-1] == pytest.approx(ln.evaluate(want, store.rows()))
    (_, _), many = jobs_of(spark, "many", lambda: tr.train_by_epochs(store.rows(), 26, 2, 2, 0.05, seed=9, evaluation=store.rows(), tasks=2))
    assert few == many
    dumped, told = [], []
    control = ln.Controller(dump=lambda name, n: dumped.append((name, n.flat())), every=2, tell=told.append)
    one, _ = tr.train_by_epochs(store.rows(0, 20), 20, 1, 5, 0.05, seed=9, controller=control, tasks=4)
    assert [d[0] for d in dumped] == ["initial", "0-1", "0-3"] and np.allclose(dumped[-1][1], one.flat()) and len(told) == 4
    # all at once
    whole, _ = tr.train_by_epochs(store.rows(), 26, 1, 0, 0.05, seed=9, tasks=1)
    assert np.allclose(whole.flat(), tr.train_by_batches(store, 26, 1, 0, 0.05, seed=9).flat())


# --- data sources ---------------------------------------------------------------------------------

HEAD = "session_id,user_id,query_id,day,query_words,url,domain,relevance,position,query_counter\n"


def test_history_source(spark, tmp_path):
    ds.register(spark)
    folder = tmp_path / "h"
    folder.mkdir()
    for u in (3, 70_000):
        (folder / f"{u}.csv").write_text(HEAD + "".join(f'{s},{u},{s},{s + 5},"a,b",u{p},d,{int(p == 2)},{p},{s}\n' for s in range(2) for p in range(1, 4)))
    (folder / "note.txt").write_text("no history")
    (folder / "sub").mkdir()
    (folder / "empty.csv").write_text("")
    rows = spark.read.format("tessera_history").load(str(folder))
    by_spark = tables.read_history_csv(spark, str(folder))
    assert sorted(map(str, by_spark.select("user_id", "hist_pos", "id", "rank", "query_words").collect())) == sorted(map(str, rows.select("user_id", "hist_pos", "id", "rank", "query_words").collect()))
    assert rows.rdd.getNumPartitions() == 3
    got = rows.orderBy("user_id", "hist_pos").collect()
    assert [(r["user_id"], r["hist_pos"], r["session"], r["rank"], r["day"]) for r in got[:6]] == [(3, s * 3 + p, s, p, (s + 5) % 7) for s in range(2) for p in range(3)]
    assert len(got) == 12 and len({r["id"] for r in got}) == 12 and got[0]["query_words"] == "a b" and got[7]["id"] == "00000001-eb92-4d36-0000-000000011170" and {r["user_feedback"] for r in got} == {2}
    assert [r["inferred_action"] for r in infer_actions(rows.filter("user_id = 3")).orderBy("hist_pos").collect()] == [1, 2, 0] * 2


@pytest.mark.parametrize("line,message", [
    ("1,2,3,9,w,u,d,1,0,0", "line 3: positions start at 1"), ("1,2,3,9,w,u,d,3,1,0", "line 3: relevance must be"), ("1,2,3,x,w,u,d,1,1,0", "line 3: day is no whole number"),
    ("1,2,3,-9,w,u,d,1,1,0", "line 3: day is no whole number"), ("1,2,3,9,w,u,d,1,1", "line 3: 10 fields expected, not 9"),
])
def test_malformed_histories(spark, tmp_path, line, message):
    ds.register(spark)
    (tmp_path / "u.csv").write_text(HEAD + "1,2,3,9,w,u,d,1,1,0\n" + line + "\n1,2,bad,9,w,u,d,1,1,0\n")
    with pytest.raises(Exception, match=message):
        spark.read.format("tessera_history").load(str(tmp_path)).collect()


def test_folders_of_histories(spark, tmp_path):
    ds.register(spark)
    (tmp_path / "a.csv").mkdir()
    with pytest.raises(Exception, match="is no file"):
        spark.read.format("tessera_history").load(str(tmp_path)).collect()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "u.csv").write_text("session_id,user_id\n1,2\n")
    with pytest.raises(Exception, match="line 1: missing fields"):
        spark.read.format("tessera_history").load(f"{tmp_path}/b").collect()
    with pytest.raises(Exception):
        spark.read.format("tessera_history").load(f"{tmp_path}/nowhere").collect()


def test_histories_as_streams(spark, tmp_path):
    ds.register(spark)
    (tmp_path / "h").mkdir()

    def run(user, name):
        (tmp_path / "h" / f"{name}.csv").write_text(HEAD + f"1,{user},3,9,w,u,d,1,1,0\n")
        q = spark.readStream.format("tessera_history").load(f"{tmp_path}/h").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").start()
        q.processAllAvailable()
        q.stop()

    run(1, "z")
    run(2, "a")  # a restart; the new file comes first by name
    assert sorted(r["user_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]
    made = spark.readStream.format("tessera_generated_history").options(users="5", usersPerBatch="2", queries="2", documents="3").load()
    q = made.writeStream.format("parquet").option("path", f"{tmp_path}/made").option("checkpointLocation", f"{tmp_path}/c2").start()
    q.processAllAvailable()
    batches = q.lastProgress["batchId"]
    q.stop()
    once = spark.read.format("tessera_generated_history").options(users="5", queries="2", documents="3", usersPerTask="2").load()
    key = lambda f: sorted(map(tuple, f.collect()))
    assert key(spark.read.parquet(f"{tmp_path}/made")) == key(once) and once.count() == 30 and batches >= 2
    assert once.rdd.getNumPartitions() == 3
    last = once.groupBy("user_id", "session", "query_count").agg(F.max(F.when(F.col("user_action") == 2, F.col("rank"))).alias("last"))
    both = once.join(last, ["user_id", "session", "query_count"])
    assert both.filter("(user_action = 1 and (last is null or rank >= last)) or (user_action = 0 and rank < last)").count() == 0
