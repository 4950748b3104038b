"""The network, tokenizer, layers, sources, state, plans, streaming and the registered queries."""

import random

import numpy as np
import pyarrow as pa
import struct
from datetime import datetime, timedelta
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions import layers
from tessera.functions import wordpiece as wp
from tessera.operators import interests as it
from tessera.operators import listnet as ln
from tessera.plans import derived
from tessera.plans.rerank import Mode, Reranker, initial_outcomes, outcomes, qa_distances, rerank
from tessera.sources import tables
from tessera.streaming.interests import learn_stream

VOCAB = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "foo", "##bar", "a", "##b", ".", "né", "ne", "中"]


def piece(**more):
    return wp.WordPiece({t: i for i, t in enumerate(VOCAB)}, **more)


def samples(spark, n=24, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(k, k % 4, rng.random((10, 50)).tolist(), ln.softmax(rng.random(10)).tolist()) for k in range(n)]
    return spark.createDataFrame(rows, "sample_id long, user_id long, inputs array<array<double>>, target array<double>")


def test_network_groups_of_ten():
    net = ln.ListNet.random(1)
    x = np.random.default_rng(0).random((13, 50))
    s = net.document_scores(x)
    out = net.run(x)
    assert np.allclose(out[:10], net.group_scores(s[:10]))
    assert np.allclose(out[10:], net.group_scores(np.concatenate([s[:5], s[10:]]))[5:])
    assert net.run(x[:0]).shape == (0,) and len(net.run(x[:3])) == 3
    with pytest.raises(ValueError):
        net.run(x[:, :49])


def test_gradients_are_those_of_the_cost():
    net, rng = ln.ListNet.random(2), np.random.default_rng(3)
    x, target = rng.random((10, 50)), ln.softmax(rng.random(10))
    g, _ = net.gradients(x, target)
    flat, at = net.flat(), np.concatenate([g[k].ravel() for k in sorted(g)])
    for i in rng.choice(len(flat), 40, replace=False):
        e = np.zeros_like(flat)
        e[i] = 1e-6
        slope = (ln.ListNet.of_flat(flat + e).cost(x, target) - ln.ListNet.of_flat(flat - e).cost(x, target)) / 2e-6
        assert at[i] == pytest.approx(slope, abs=1e-5)


def test_training_lowers_the_cost(spark):
    data = samples(spark)
    fit, held = ln.split_samples(data, 0.25)
    assert (fit.count(), held.count(), held.agg(F.min("sample_id")).first()[0]) == (18, 6, 18)
    start = ln.ListNet.random(0)
    net, costs = ln.train(fit, epochs=3, batch_size=6, rate=0.05, evaluation=held)
    assert len(costs) == 3 and ln.evaluate(net, fit) < ln.evaluate(start, fit)
    again, _ = ln.train(fit, epochs=3, batch_size=6, rate=0.05)
    assert np.allclose(net.flat(), again.flat())
    fed = ln.train_federated(fit, "user_id", rounds=2, users=3, rate=0.05)
    assert ln.evaluate(fed, fit) < ln.evaluate(start, fit)
    assert np.isnan(ln.evaluate(net, fit.limit(0)))


def test_prepare_inputs(spark):
    rows = spark.createDataFrame([(1, [[0.0]] * 9, [0.1] * 9), (2, [[0.0]] * 12, [0.1] * 12)], "sample_id long, inputs array<array<double>>, target array<double>")
    assert [(r["sample_id"], len(r["inputs"])) for r in ln.prepare_inputs(rows).collect()] == [(2, 10)]


def test_network_checks():
    params = ln.ListNet.random(0).params
    for bad in ({"more": np.zeros(1)}, {"scores/bias": np.zeros(2)}, {"scores/bias": np.array([np.nan])}):
        with pytest.raises(ValueError):
            ln.ListNet(params | bad)


def test_wordpiece():
    e = piece(max_length=8).encode("Foobar a. né xyz")
    assert e.tokens[:7] == ["[CLS]", "foo", "##bar", "a", ".", "ne", "[UNK]"] and e.offsets[1:7] == [(0, 3), (3, 6), (7, 8), (8, 9), (10, 13), (14, 17)]
    assert piece(max_length=10).encode("a").attention_mask == [1, 1, 1] + [0] * 7
    parts = piece(max_length=4, stride=1).encode("a a a a")
    assert [len(p.ids) for p in parts.overflowing] == [4, 4] and parts.word_indices == [None, 0, 1, None]
    assert piece(chinese=True).encode("a中a").tokens == ["[CLS]", "a", "中", "a", "[SEP]"]
    assert piece(accents=True).encode("né").tokens[1] == "né" and piece(max_chars=2).encode("foobar").tokens[1] == "[UNK]"
    assert piece().decode(piece().encode("foobar a .")) == "foobar a."
    assert wp.decode_words("Foobar né", piece().encode("Foobar né")) == ["Foobar", "né"]
    assert wp.word_starts([(0, 3), (3, 6), (7, 8)]) == [True, False, True]
    for bad in ({"unknown": "?"}, {"prefix": "@@"}, {"max_length": 1}, {"max_length": 4, "stride": 2}):
        with pytest.raises(ValueError):
            piece(**bad)
    with pytest.raises(ValueError):
        wp.read_vocabulary([])


def test_encoders(spark):
    docs = spark.createDataFrame([("ab",), (None,)], "t string")
    got = docs.select(wp.encode_column(wp.ByteEncoder(4), F.col("t")).alias("e"), piece(max_length=4).encode_column(F.col("t")).alias("p")).collect()
    assert [r["e"] for r in got] == [[97, 98, 0, 0], [0, 0, 0, 0]] and [r["p"]["tokens"] for r in got] == [["[CLS]", "a", "##b", "[SEP]"], ["[CLS]", "[SEP]", "[PAD]", "[PAD]"]]
    tokens = np.arange(6.0).reshape(3, 2)
    assert wp.pool_average(tokens, np.array([1, 1, 0])).tolist() == [1, 2] and wp.pool_average(tokens, np.zeros(3)).tolist() == [0, 0] and wp.pool_first(tokens, np.ones(3)).tolist() == [0, 1]


def test_overflowing_parts_are_columns(spark):
    texts = ["a a a a foobar", "", None, "foobar né xyz a a", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for w in (piece(max_length=4, stride=1), piece(max_length=5), piece(max_length=4, padding=False), piece(max_length=2), piece()):
        got = docs.select(w.encode_column(F.col("t")).alias("e"), w.ids_column(F.col("t")).alias("ids")).orderBy("k").collect()
        for t, r in zip(texts, got, strict=True):
            e = w.encode(t)
            parts = [e, *e.overflowing]
            assert r["ids"] == [p.ids for p in parts]
            for p, row in zip(parts, [r["e"], *r["e"]["overflowing"]], strict=True):
                assert (row["ids"], row["tokens"], row["word_indices"], [tuple(o) for o in row["offsets"]]) == (p.ids, p.tokens, p.word_indices, p.offsets)


def test_ids_of_a_batch_equal_the_encodings():
    """Odd spaces, control and combining characters, sliced and empty batches; every choice of the tokenizer."""
    rnd = random.Random(3)
    parts = [*"ab foxyz.,ABé'!", "\u00a0", "\u3000", "\t", "\n", "\x0b", "\x1c", "\x85", "\0", "中", "e\u0301", "foo", "bar", "a" * 120]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.choice([0, 1, 5, 40]))) for _ in range(200)] + [None, "", " "]
    column = pa.array(texts, pa.string())
    for more in ({"max_length": 8, "stride": 2}, {"max_length": 5, "padding": False}, {"max_length": 2}, {}, {"max_length": 9, "stride": 6, "chinese": True, "accents": True, "lowercase": False}, {"cleanup": False, "max_length": 7, "max_chars": 4}):
        w = piece(**more)
        want = [[p.ids for p in (e, *e.overflowing)] for e in map(w.encode, texts)]
        assert w.encode_ids(column).to_pylist() == want
        assert w.encode_ids(column[7:60]).to_pylist() == want[7:60] and len(w.encode_ids(column[:0])) == 0


def test_wordpiece_query_keeps_whole_texts(spark, sf_dir):
    rows = {r["doc_id"]: r for r in entry.queries()["wordpiece_encode"](spark, sf_dir).collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20).collect():
        r, words = rows[d["doc_id"]], len(d["text"].split())
        assert sum(len(p) - 2 for p in [r["ids"], *r["overflowing"]]) >= words and all(len(p) == 52 for p in [r["ids"], *r["overflowing"]])


def test_ngram_encoder_reads_whole_texts():
    same = "x" * 200
    e = wp.NgramEncoder(32).encode([same + "abc", same + "abd", "ab", "", None])
    assert (e[0] != e[1]).any() and e.sum(axis=1).tolist() == [201, 201, 1, 0, 0]


def test_qa_distance_query_reads_behind_equal_beginnings(spark, tmp_path):
    start = "the same beginning of more than 32 bytes, "
    rows = [(1, 0, "user", start + "then one thing"), (1, 1, "user", start + "and something else"), (1, 2, "user", start + "then one thing")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["id"]: r["similarity"] for r in entry.queries()["qa_distance"](spark, str(tmp_path)).collect()}
    assert got["1-0"] == got["1-2"] == 0 and got["1-1"] > 0


def test_layers(tmp_path):
    conv = layers.Conv1D(np.array([[[1.0, 2.0]]]), np.array([0.5]))
    assert conv.run(np.array([[1.0, 2, 3]])).tolist() == [[5.5, 8.5]]
    scorer = layers.PhraseScorer.random(6)
    assert len(scorer.scores(np.ones((7, 6)))) == 7 + 6 + 5 + 4 + 3
    with pytest.raises(ValueError):
        scorer.scores(np.ones((4, 6)))
    p = layers.Params({})
    p.with_scope("d").insert("w", np.ones((2, 2)))
    p.save(f"{tmp_path}/p.npz")
    q = layers.Params.load(f"{tmp_path}/p.npz")
    with pytest.raises(KeyError):
        q.take("w", 2)
    with pytest.raises(ValueError):
        q.check_empty()
    assert q.with_scope("d").take("w", 2).shape == (2, 2)
    q.check_empty()


def test_flattened_arrays():
    rng = np.random.default_rng(0)
    arrays = {"a/w": rng.random((2, 3)), "é": rng.random(4), "none": np.zeros((0, 5)), "one": np.array(7.0), "turned": rng.random((3, 2)).T}
    data = layers.Params(dict(arrays)).to_bytes()
    back = layers.Params.from_bytes(data).arrays
    assert list(back) == list(arrays) and all(back[k].shape == a.shape and np.allclose(back[k], a) for k, a in arrays.items())
    assert layers.Params.from_bytes(layers.Params({}).to_bytes()).arrays == {}
    good = layers.Params({"w": np.ones((2, 2))}).to_bytes()
    head = good[:8] + good[8:17]  # one array, named w
    wrong = head + struct.pack("<QQQQ", 2, 2, 3, 4) + good[-16:]
    for bad, message in ((wrong, "w has 4 entries, its shape"), (good[:-1], "bytes expected"), (good + b"x", "left over"), (b"\2" + good[1:] + good[8:], "twice"), (b"", "8 bytes expected")):
        with pytest.raises(ValueError, match=message):
            layers.Params.from_bytes(bad)
    with pytest.raises(ValueError, match="dimensions"):
        layers.Params.from_bytes(good).take("w", 1)


def test_history_csv(spark, tmp_path):
    head = "session_id,user_id,query_id,day,query_words,url,domain,relevance,position,query_counter\n"
    (tmp_path / "u.csv").write_text(head + '1,2,3,9,"a,b",u,d,1,1,0\n')
    (tmp_path / "note.txt").write_text("no history")
    r = tables.read_history_csv(spark, str(tmp_path)).first()
    assert (r["rank"], r["day"], r["query_words"], len(r["id"])) == (0, 2, "a b", 36)
    (tmp_path / "v.csv").write_text(head + '1,2,3,9,"a,b",u,d,1,0,0\n')
    with pytest.raises(Exception, match="positions start at 1"):
        tables.read_history_csv(spark, str(tmp_path)).collect()


def test_calls_and_samples(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"rerank_mode": 1, "histories": [], "documents": [{"id": "a", "rank": 0}], "serialized_state": "AQI="}')
    calls = tables.read_calls(spark, f"{tmp_path}/c.json")
    r = calls.first()
    assert (r["rerank_mode"], r["documents"][0]["id"], bytes(r["state"])) == (1, "a", b"\1\2")
    tables.write_calls(calls, f"{tmp_path}/out")
    assert bytes(tables.read_calls(spark, f"{tmp_path}/out").first()["state"]) == b"\1\2"
    good = samples(spark, 3).drop("user_id")
    tables.write_samples(good, f"{tmp_path}/s")
    assert tables.read_samples(spark, f"{tmp_path}/s", [0, 2]).count() == 2
    with pytest.raises(IndexError):
        tables.read_samples(spark, f"{tmp_path}/s", [0, 9])
    with pytest.raises(Exception, match="50 inputs"):
        tables.write_samples(good.withColumn("target", F.slice("target", 1, 2)), f"{tmp_path}/s")
    (tmp_path / "v.txt").write_text("x\ny \nx\n")
    assert tables.read_vocabulary_file(spark, f"{tmp_path}/v.txt") == {"x": 2, "y": 1}
    assert tables.synthetic_calls(spark, 2).count() == 100


def test_state(spark, tmp_path):
    old = spark.createDataFrame([(0, "pos", 0, "a", [1.0], 1.0, 1.0)], "user_id long, polarity string, coi_pos int, coi_id string, point array<double>, alpha double, beta double")
    new = tables.migrate(old, 0)
    assert (new.first()["view_count"], new.first()["view_time"]) == (1, 0.0) and "alpha" not in new.columns
    tables.save_state(new, f"{tmp_path}/state")
    assert tables.load_state(spark, f"{tmp_path}/state").drop("schema_version").count() == 1
    with pytest.raises(ValueError):
        tables.migrate(old, 7)


# --- plans ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("mode", list(Mode))
def test_modes(spark, sf_dir, mode):
    docs = derived.requests(spark, sf_dir).filter("request_id < 3").withColumns({"title": F.lit("t"), "snippet": F.concat(F.lit("s"), "id"), "query_words": F.lit("q"), "id": F.col("id").cast("string")})
    out = outcomes(rerank(mode, docs, derived.interests(spark, sf_dir), encoder=wp.ByteEncoder(8)).ranked, mode).collect()
    assert len(out) == 60
    for k in range(3):
        assert sorted(r["final_rank"] for r in out if r["request_id"] == k) == list(range(20))
    assert all((r["context_score"] is not None) == mode.personalized and (r["qa_similarity"] is not None) == mode.search for r in out)


def test_faults_leave_neutral_values(spark, sf_dir):
    docs = derived.requests(spark, sf_dir).filter("request_id < 2")
    done = rerank(Mode.PERSONALIZED_NEWS, docs, derived.interests(spark, sf_dir).filter("polarity = 'neg'"))
    assert [(r["request_id"], r["code"]) for r in done.faults.orderBy("request_id").collect()] == [(0, "NoCoi"), (1, "NoCoi")]
    r = done.ranked.first()
    assert (r["pos_similarity"], r["neg_similarity"], r["context"]) == (0, 0, pytest.approx(0.6))
    assert initial_outcomes(docs).count() == 40


def test_reranker_learns_between_calls(spark, sf_dir):
    docs = derived.requests(spark, sf_dir).filter("request_id = 0")
    service = Reranker(derived.interests(spark, sf_dir))
    now = F.lit(derived.AS_OF).cast("timestamp")
    history = docs.select("user_id", "id", F.col("doc_pos").cast("long").alias("hist_pos"), (F.col("doc_pos") % 3).alias("relevance"), F.lit(2).alias("user_feedback"))
    service.rerank(Mode.PERSONALIZED_NEWS, history, docs, now)
    before = service.interests.agg(F.sum("view_count")).first()[0]
    service.rerank(Mode.PERSONALIZED_NEWS, history, docs, now)
    assert service.interests.agg(F.sum("view_count")).first()[0] > before
    a = service.analytics.first()
    assert 0 <= a["ndcg_context"] <= 1 and a["ndcg_context"] == a["ndcg_final_ranking"]


def test_query_is_the_first_documents(spark):
    rows = [(0, 0, k, f"d{k}", "title", "" if k else "snip", q) for k, q in enumerate(("title", "other"))]
    docs = spark.createDataFrame(rows, "user_id long, request_id long, doc_pos int, id string, title string, snippet string, query_words string")
    got = {r["id"]: r["similarity"] for r in qa_distances(docs, wp.ByteEncoder(8)).collect()}
    assert got["d1"] == 0 and got["d0"] > 0


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(k % 3, k, ["like", "dislike", "view"][k % 5 % 3], rng.random(4).tolist(), 2.0, datetime(2024, 1, 1) + timedelta(minutes=k)) for k in range(40)]
    events = spark.createDataFrame(rows, "user_id long, event_id long, kind string, embedding array<double>, seconds double, at timestamp")
    for part in range(2):
        events.filter(F.col("event_id").between(20 * part, 20 * part + 19)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = learn_stream(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), delay="1 day")
    q = stream.writeStream.format("memory").queryName("learned").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    want = it.learn(spark.createDataFrame([], it.INTERESTS), events.withColumn("seq", F.col("event_id")))
    key = lambda rows: sorted((r["user_id"], r["polarity"], r["coi_pos"], r["view_count"], r["view_time"], tuple(np.round(r["point"], 9))) for r in rows)
    assert set(key(want.collect())) <= set(key(spark.table("learned").collect()))


# --- queries --------------------------------------------------------------------------------------


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def canonical(frame):
    def text(x):
        if x is None or (isinstance(x, float) and x != x):
            return "-"
        if isinstance(x, (bool, np.bool_)):
            return str(bool(x))
        if isinstance(x, (int, float, np.integer, np.floating)):
            return f"{float(x) + 0.0:.8g}"
        return str(x)

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(text(x) for x in row) for row in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(entry.ORACLE_SQL))
def test_query_against_sql(spark, duck, sf_dir, name):
    assert canonical(entry.queries()[name](spark, sf_dir).toPandas()) == canonical(duck.execute(entry.oracle_sql()[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(entry.QUERIES) - set(entry.ORACLE_SQL)))
def test_query_runs(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 0
