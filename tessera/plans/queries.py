"""The operators as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as v
from ..functions.layers import PhraseScorer
from ..functions.wordpiece import NgramEncoder, WordPiece
from ..operators import features as ft
from ..operators import history as hs
from ..operators import interests as it
from ..operators import keyphrase as kp
from ..operators import phrase_state as ps
from ..operators import ranking as rk
from ..operators import samples as sm
from ..operators import segments as sg
from ..operators import user_state as us
from ..operators.listnet import ListNet, listnet_scores
from ..sources import tables
from ..sources.scratch import materialize, scratch_folder
from ..streaming.feedback import completed_requests, settle_stream
from . import derived as d
from . import rerank as plans
from .rerank import Mode, qa_distances, rerank

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    """Register a query; its whole numbers are longs and its others doubles."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f(spark, sf_dir)
        wide = {"int": "long", "smallint": "long", "tinyint": "long", "float": "double"}
        return out.select(*[F.col(c).cast(wide[t]).alias(c) if t in wide else F.col(c) for c, t in out.dtypes])

    QUERIES[f.__name__] = run
    return f


def _r(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6)


def _as_of() -> Column:
    return F.lit(d.AS_OF).cast("timestamp")


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hs.with_runs(hs.with_actions(d.history(spark, sf_dir)))


# --- vectors ------------------------------------------------------------------------------------


@query
def vec_l2_norm(spark, sf_dir):
    return d.table(spark, sf_dir, "embeddings").select("vec_id", _r(v.l2_norm(F.col("embedding"))).alias("norm"))


def _neighbours(spark, sf_dir):
    e = d.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "embedding").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")


@query
def vec_l2_distance_pairs(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("vec_id", _r(v.l2_distance(F.col("embedding"), F.col("other"))).alias("distance"), _r(v.cosine(F.col("embedding"), F.col("other"))).alias("cosine"))


def _weighted(c: Column) -> Column:
    """All entries in one number: each times its place."""
    return F.aggregate(F.transform(c, lambda x, i: x * (i + 1.0)), F.lit(0.0), lambda acc, x: acc + x)


@query
def vec_mean_shift(spark, sf_dir):
    n = _neighbours(spark, sf_dir).select("vec_id", v.midpoint(F.col("embedding"), F.col("other")).alias("mid"), v.shift(F.col("embedding"), F.col("other"), 0.1).alias("shift"))
    return n.select("vec_id", _r(F.element_at("mid", 1)).alias("mid1"), _r(F.element_at("shift", 2)).alias("shift2"), _r(_weighted(F.col("mid"))).alias("mid_weighted"), _r(_weighted(F.col("shift"))).alias("shift_weighted"))


@query
def vec_softmax_kl(spark, sf_dir):
    n = _neighbours(spark, sf_dir).select("vec_id", v.softmax(F.col("embedding")).alias("a"), v.softmax(F.col("other")).alias("b"))
    return n.select("vec_id", _r(F.element_at("a", 1)).alias("p1"), _r(v.kl_divergence(F.col("a"), F.col("b"))).alias("kl"))


@query
def vec_cosine_topk(spark, sf_dir):
    """The three interests closest to each vector."""
    from pyspark.sql.window import Window

    pairs = d.requests(spark, sf_dir).join(d.interests(spark, sf_dir).select("user_id", "coi_pos", "point"), "user_id")
    pairs = pairs.select("id", "coi_pos", _r(v.cosine(F.col("embedding"), F.col("point"))).alias("cosine"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "coi_pos"))
    return pairs.withColumn("place", place).filter("place <= 3")


# --- histories and features -----------------------------------------------------------------------


@query
def history_actions(spark, sf_dir):
    return hs.with_actions(d.history(spark, sf_dir)).select("user_id", "hist_pos", "action", "clicked", F.size("terms").alias("n_terms"))


@query
def history_runs(spark, sf_dir):
    return _prepared(spark, sf_dir).select("user_id", "hist_pos", "run_id", "click_index", "run_clicks")


@query
def user_action_inference(spark, sf_dir):
    return hs.infer_actions(d.history(spark, sf_dir)).select("user_id", "hist_pos", "inferred_action")


@query
def history_runs_by_segments(spark, sf_dir):
    """Runs of histories too long for a task each; here segments of forty results."""
    return sg.with_runs(hs.with_actions(d.history(spark, sf_dir)), 40).select("user_id", "hist_pos", "run_id", "click_index", "run_clicks")


@query
def user_action_inference_by_segments(spark, sf_dir):
    return sg.infer_actions(d.history(spark, sf_dir), 40).select("user_id", "hist_pos", "inferred_action")


@query
def clicks_so_far(spark, sf_dir):
    """How many clicks each result's user made before it."""
    h = hs.with_actions(d.history(spark, sf_dir))
    return sg.cumulative_sum(h, F.col("clicked").cast("long"), "clicks", 40).select("user_id", "hist_pos", "clicks")


@query
def feedback_classification(spark, sf_dir):
    return d.history(spark, sf_dir).groupBy("user_id").agg(F.sum(hs.is_negative().cast("int")).alias("n_negative"), F.sum((~hs.is_negative()).cast("int")).alias("n_positive"))


@query
def last_query_start(spark, sf_dir):
    return hs.last_query_start(d.history(spark, sf_dir))


@query
def mrr_by_url(spark, sf_dir):
    s = ft.outcome_sums(_prepared(spark, sf_dir)).filter("kind = 'u'").groupBy("user_id", "key").agg(*[F.sum(c).alias(c) for c in ("n", "n_miss", "n_skip", "n_click", "r", "r_miss", "r_skip", "r_click")])
    m = lambda o: _r(ft.mean_reciprocal_rank(F.col(f"r{o}"), F.col(f"n{o}"))).alias(f"mrr{o}")
    return s.select("user_id", F.col("key").alias("url"), m(""), m("_miss"), m("_skip"), m("_click"))


@query
def cond_prob_by_domain(spark, sf_dir):
    s = ft.outcome_sums(_prepared(spark, sf_dir)).filter("kind = 'd'").groupBy("user_id", "key").agg(*[F.sum(c).alias(c) for c in ("n", "n_miss", "n_skip", "n_click2")])
    p = lambda o: _r(ft.conditional_probability(F.col(f"n_{o}"), F.col("n"), o == "miss")).alias(f"p_{o}")
    return s.select("user_id", F.col("key").alias("domain"), p("miss"), p("skip"), p("click2"))


@query
def snippet_quality_by_url(spark, sf_dir):
    h = _prepared(spark, sf_dir)
    scores = ft.snippet_scores(h, False).filter("kind = 'u'").groupBy("user_id", "key").agg(F.sum("score").alias("score"))
    n = h.groupBy("user_id", F.col("url").alias("key")).agg(F.sum(F.col("action").isin(hs.MISS, hs.SKIP).cast("int")).alias("n"))
    return scores.join(n, ["user_id", "key"]).select("user_id", F.col("key").alias("url"), _r(F.when(F.col("n") == 0, 0.0).otherwise(F.col("score") / F.when(F.col("n") != 0, F.col("n")))).alias("quality"))


@query
def click_entropy_by_user(spark, sf_dir):
    return ft.click_entropy(_prepared(spark, sf_dir), ["user_id"]).select("user_id", _r("click_entropy").alias("click_entropy"))


@query
def query_features(spark, sf_dir):
    q = ft.query_features(_prepared(spark, sf_dir))
    return q.select("user_id", "query_id", "num_occurs", *[_r(c).alias(c) for c in q.columns if c not in ("user_id", "query_id", "num_occurs")])


@query
def user_features(spark, sf_dir):
    u = ft.user_features(_prepared(spark, sf_dir))
    return u.select("user_id", "click12", "click345", "click6up", "num_queries", *[_r(c).alias(c) for c in ("click_entropy", "words_per_query", "unique_words_per_session")])


@query
def seasonality(spark, sf_dir):
    return ft.seasonality(_prepared(spark, sf_dir)).select("user_id", "domain", _r("seasonality").alias("seasonality"))


def _features(spark, sf_dir):
    now, past = d.current_and_past(spark, sf_dir)
    # a dozen aggregations read the prepared history: it is made once
    past, now = materialize(hs.with_runs(hs.with_actions(past))), materialize(now.withColumn("terms", hs.query_terms(F.col("query_words"))))
    return ft.features_50(past, now)


@query
def cumulated_features(spark, sf_dir):
    return _features(spark, sf_dir).select("user_id", "rank", *[_r(F.element_at("features", 46 + i)).alias(n) for i, n in enumerate(("cum_skip", "cum_click1", "cum_click2"))])


@query
def terms_variety(spark, sf_dir):
    now, _ = d.current_and_past(spark, sf_dir)
    return now.select("user_id", "rank", F.size(F.array_distinct(hs.query_terms(F.col("query_words")))).alias("terms_variety"))


@query
def features_50(spark, sf_dir):
    return _features(spark, sf_dir).select("user_id", "rank", *[_r(F.element_at("features", i + 1)).alias(f"f{i:02d}") for i in range(50)])


@query
def target_distribution(spark, sf_dir):
    now, _ = d.current_and_past(spark, sf_dir)
    lists = now.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "relevance"))), lambda x: x["relevance"]).alias("r"))
    return lists.select("user_id", F.posexplode(v.target_distribution(F.col("r"))).alias("rank", "p")).select("user_id", "rank", _r("p").alias("target"))


# --- interests, context, ranks --------------------------------------------------------------------


@query
def coi_assign(spark, sf_dir):
    a = it.assign(d.requests(spark, sf_dir), d.interests(spark, sf_dir))
    return a.select("request_id", "id", "coi_id", _r("pos_similarity").alias("pos_similarity"), _r("neg_similarity").alias("neg_similarity"))


def _news(spark, sf_dir):
    return rerank(Mode.PERSONALIZED_NEWS, d.requests(spark, sf_dir), d.interests(spark, sf_dir)).ranked


@query
def context_score(spark, sf_dir):
    return _news(spark, sf_dir).select("request_id", "id", _r("context").alias("context"))


@query
def rerank_personalized_news(spark, sf_dir):
    return _news(spark, sf_dir).select("request_id", "id", "coi_id", _r("context").alias("context"), "final_rank")


@query
def rerank_standard_news(spark, sf_dir):
    return rerank(Mode.STANDARD_NEWS, d.requests(spark, sf_dir)).ranked.select("request_id", "id", _r("context").alias("context"), "final_rank")


@query
def rerank_faults(spark, sf_dir):
    """A user without positive interests: neutral values and a fault for each request."""
    done = rerank(Mode.PERSONALIZED_NEWS, d.requests(spark, sf_dir), d.interests(spark, sf_dir).filter("polarity = 'neg'"))
    return done.faults


def _label_history(spark, sf_dir):
    return d.table(spark, sf_dir, "labels").select(d.user_of("doc_id").alias("user_id"), F.col("doc_id").alias("id"), F.lit(0).alias("hist_pos"), (F.col("quality") + 1 - F.col("toxic")).alias("relevance"), F.lit(2).alias("user_feedback"))


@query
def feedback_faults(spark, sf_dir):
    """Requests of which the history, here of toxic documents, knows none: nothing to learn from, and no analytics."""
    toxic = d.table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return plans.feedback_faults(_news(spark, sf_dir), _label_history(spark, sf_dir).join(toxic, "id", "left_semi"))


@query
def feedback_events(spark, sf_dir):
    """What the ranked requests' users are taught by the history, in its order."""
    matched = hs.matching_documents(_label_history(spark, sf_dir), _news(spark, sf_dir), ["user_id", "id"]).withColumn("at", _as_of())
    return it.feedback_events(matched, ["request_id", "id"]).select("event_id", "seq", "kind")


@query
def ndcg_at_2(spark, sf_dir):
    a = rk.analytics(_news(spark, sf_dir), _label_history(spark, sf_dir))
    return a.select("request_id", *[_r(c).alias(c) for c in a.columns if c.startswith("ndcg")])


def _streamed(spark, sf_dir, history, what):
    """The news and the reactions to them as two streams, each from written files; rows from long after let the last requests go."""
    paths = {k: scratch_folder(spark) for k in ("shown", "reactions", "faults", "ndcg", "checkpoint")}
    at = F.lit("2024-05-01 00:00:00").cast("timestamp")
    shown = _news(spark, sf_dir).select(*rk.REQUEST, at.alias("shown_at"), "doc_pos", "id", "rank", F.col("ltr_score").cast("double").alias("ltr_score"), "context", "final_rank")
    reactions = history.select("user_id", "id", (at + F.expr("INTERVAL 1 HOUR")).alias("at"), F.col("hist_pos").cast("long").alias("hist_pos"), F.col("relevance").cast("int").alias("relevance"), "user_feedback")
    later, nobody = at + F.expr("INTERVAL 400 DAYS"), F.lit(-1).cast("long")
    streams = []
    for name, rows, time in (("shown", shown, "shown_at"), ("reactions", reactions, "at")):
        rows.write.parquet(f"{paths[name]}/now")
        rows.limit(1).withColumns({"user_id": nobody, time: later}).write.parquet(f"{paths[name]}/later")
        streams.append(spark.readStream.schema(rows.schema).parquet(f"{paths[name]}/*"))
    running = settle_stream(completed_requests(*streams), paths["faults"], paths["ndcg"], paths["checkpoint"])
    running.processAllAvailable()
    running.stop()
    return spark.read.parquet(paths[what]).filter("user_id >= 0")


@query
def streamed_ndcg_at_2(spark, sf_dir):
    a = _streamed(spark, sf_dir, _label_history(spark, sf_dir), "ndcg")
    return a.select("request_id", *[_r(c).alias(c) for c in a.columns if c.startswith("ndcg")])


@query
def streamed_feedback_faults(spark, sf_dir):
    toxic = d.table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return _streamed(spark, sf_dir, _label_history(spark, sf_dir).join(toxic, "id", "left_semi"), "faults").select(*rk.REQUEST, "stage", "code")


@query
def csv_history_scan(spark, sf_dir):
    """Each user's history from the CSV files that it was written to."""
    h, folder = d.history(spark, sf_dir), scratch_folder(spark)
    records = h.select(F.col("session").alias("session_id"), "user_id", "query_id", "day", F.replace("query_words", F.lit(" "), F.lit(",")).alias("query_words"), "url", "domain", "relevance", (F.col("rank") + 1).alias("position"), F.col("query_count").alias("query_counter"), "hist_pos")
    records.repartition("user_id").sortWithinPartitions("user_id", "hist_pos").drop("hist_pos").write.option("header", True).csv(folder)
    return tables.read_history_csv(spark, folder).select("user_id", "hist_pos", "id", "session", "query_count", "query_id", "query_words", "url", "domain", "day", "relevance", "rank")


@query
def state_migrations(spark, sf_dir):
    """Interests as every version of the state kept them, brought to the present one."""
    now, folder = d.interests(spark, sf_dir), scratch_folder(spark)
    for version in range(tables.STATE_VERSION + 1):
        old = now if version == tables.STATE_VERSION else now.drop("view_count", "view_time", "last_view")
        old = old.withColumns({"alpha": F.lit(1.1), "beta": F.lit(0.9)}) if version < 2 else old
        old.withColumns({"coi_id": F.concat("coi_id", F.lit(f"v{version}")), "schema_version": F.lit(version)}).write.parquet(f"{folder}/part={version}")
    out = tables.load_state(spark, folder)
    return out.select("user_id", "polarity", "coi_pos", "coi_id", "view_count", _r("view_time").alias("view_time"), F.unix_timestamp("last_view").alias("last_view"))


@query
def coi_decay(spark, sf_dir):
    return d.interests(spark, sf_dir).select("user_id", "coi_id", _r(v.decay(30.0, _as_of(), F.col("last_view"))).alias("decay"))


@query
def coi_relevance(spark, sf_dir):
    return rk.coi_relevance(d.interests(spark, sf_dir).filter("polarity = 'pos'"), _as_of()).select("user_id", "coi_id", _r("relevance").alias("relevance"))


def _scored(spark, sf_dir):
    docs = d.requests(spark, sf_dir).withColumn("published", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 97).cast("int"))).withColumn("doc_pos", F.col("id"))
    pos, neg = (d.interests(spark, sf_dir).filter(F.col("polarity") == p) for p in ("pos", "neg"))
    return docs, pos.unionByName(neg)


@query
def ranker_score(spark, sf_dir):
    docs, interests = _scored(spark, sf_dir)
    return rk.document_scores(docs, interests, _as_of()).select("id", _r("score").alias("score"))


@query
def ranker_rank(spark, sf_dir):
    """Every request's user likes its first two documents and dislikes the next two."""
    docs, _ = _scored(spark, sf_dir)
    docs = docs.withColumn("user_id", F.col("request_id"))
    first = docs.filter("rank < 4")
    own = first.select("user_id", F.when(F.col("rank") < 2, "pos").otherwise("neg").alias("polarity"), F.col("rank").alias("coi_pos"), F.col("id").cast("string").alias("coi_id"), F.col("embedding").alias("point"), (F.col("rank") + 1).alias("view_count"), F.lit(1.0).alias("view_time"), F.timestamp_seconds(F.unix_timestamp(_as_of()) - F.col("rank") * 86400).alias("last_view"))
    return rk.rank_documents(docs.filter("rank >= 4"), own, _as_of()).select("request_id", "id", _r("score").alias("score"))


@query
def rank_by_date_fallback(spark, sf_dir):
    docs, interests = _scored(spark, sf_dir)
    docs = docs.withColumn("user_id", F.col("request_id"))
    return rk.rank_documents(docs, interests.filter("user_id < 0"), _as_of()).select("request_id", "id", F.col("position").cast("long").alias("position"))


# --- key phrases and texts ------------------------------------------------------------------------


def _titles(spark, sf_dir):
    return d.table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text"))


@query
def clean_key_phrase(spark, sf_dir):
    return d.table(spark, sf_dir, "benchmark").select("item_id", v.clean_key_phrase(F.col("text")).alias("cleaned"))


@query
def ngram_candidates(spark, sf_dir):
    return kp.candidates(_titles(spark, sf_dir), "item_id", hs.query_terms(F.col("text")))


@query
def ranked_phrases(spark, sf_dir):
    """Phrases of each item by the best of their mentions' scores (here: one over the mention's place)."""
    words = _titles(spark, sf_dir).select("item_id", hs.query_terms(F.col("text")).alias("w")).select("item_id", F.posexplode("w").alias("p", "phrase"))
    return kp.rank_phrases(words.select("item_id", "phrase", _r(1 / (F.col("p") + 1.0)).alias("score")), "item_id", 5, 0.01)


def _phrases(spark, sf_dir):
    e = d.table(spark, sf_dir, "embeddings")
    return e.select(d.user_of("vec_id").alias("user_id"), F.format_string("coi%02d", "label").alias("coi_id"), F.concat(F.lit("phrase "), F.lpad(F.col("vec_id").cast("string"), 6, "0")).alias("words"), F.col("embedding").alias("point"), "vec_id")


@query
def top_key_phrases(spark, sf_dir):
    t = rk.top_key_phrases(_phrases(spark, sf_dir), d.interests(spark, sf_dir).filter("polarity = 'pos'"), _as_of(), 10)
    return t.select("user_id", F.col("position").cast("long").alias("position"), "coi_id", "words", _r("score").alias("score"))


@query
def sync_append(spark, sf_dir):
    local = d.interests(spark, sf_dir).filter("coi_pos % 2 = 0")
    remote = d.interests(spark, sf_dir).withColumn("view_count", F.col("view_count") + 100)
    return it.append_remote(local, remote).select("user_id", "polarity", "coi_pos", "coi_id", "view_count")


@query
def initial_ranking(spark, sf_dir):
    from .rerank import initial_outcomes

    return initial_outcomes(d.requests(spark, sf_dir)).select("request_id", "id", "final_rank")


@query
def coi_close_pairs(spark, sf_dir):
    """Every label's vectors, four times as long, as interests of a user."""
    e = d.table(spark, sf_dir, "embeddings")
    own = e.select(F.col("label").cast("long").alias("user_id"), F.lit("pos").alias("polarity"), F.format_string("v%09d", "vec_id").alias("coi_id"), F.transform("embedding", lambda x: x.cast("double") * 4).alias("point"))
    return it.close_pairs(own).select("user_id", "id0", "id1", _r("distance").alias("distance"))


@query
def encoder_agreement(spark, sf_dir):
    n = _neighbours(spark, sf_dir)
    wide = lambda c: F.transform(c, lambda x: x.cast("double"))
    a = sm.agreement(n.select(wide("embedding").alias("want"), wide("other").alias("got")))
    return a.select(*[_r(c).alias(c) for c in ("mae", "mre", "mse", "mean_cosine")])


# --- learning, networks, encoders --------------------------------------------------------------------------------


def _reactions(spark, sf_dir):
    e = d.table(spark, sf_dir, "embeddings")
    kind = F.when(F.col("label") < 5, "like").when(F.col("label") < 9, "dislike").otherwise("view")
    return e.select(F.expr("vec_id div 40").alias("user_id"), F.col("vec_id").cast("long").alias("seq"), F.col("vec_id").alias("event_id"), kind.alias("kind"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), F.lit(5.0).alias("seconds"), F.timestamp_seconds(F.col("vec_id") + 1_700_000_000).alias("at"))


def _learned(spark, sf_dir):
    return it.learn(spark.createDataFrame([], it.INTERESTS), _reactions(spark, sf_dir))


def _shown(interests):
    return interests.select("user_id", "polarity", "coi_pos", "coi_id", "view_count", "view_time", _r(v.l2_norm(F.col("point"))).alias("norm"))


@query
def coi_learn(spark, sf_dir):
    return _shown(_learned(spark, sf_dir))


@query
def coi_merge(spark, sf_dir):
    return _shown(it.merge(_learned(spark, sf_dir)))


def _advanced(spark, sf_dir):
    """Forty vectors are a user's reactions, one after the other, with phrases; now and then phrases are shown."""
    e = d.table(spark, sf_dir, "embeddings")
    at = F.expr("vec_id % 40")
    kind = F.when(at % 10 == 9, "show").when(F.col("label") < 7, "like").when(F.col("label") < 9, "dislike").otherwise("view")
    words = F.array(F.concat(F.lit("topic "), "label"), F.concat(F.lit("word "), F.col("vec_id") % 7), F.concat(F.lit("thing! "), F.col("vec_id") % 3))
    events = e.select(F.expr("vec_id div 40").alias("user_id"), F.col("vec_id").cast("long").alias("seq"), F.col("vec_id").cast("string").alias("event_id"), kind.alias("kind"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), words.alias("candidates"), F.lit(5.0).alias("seconds"), F.lit(3).alias("top"), F.timestamp_seconds(F.col("vec_id") * 3600 + 1_700_000_000).alias("at"))
    encoder = NgramEncoder(64)
    return us.advance(us.no_states(spark), events, lambda words: encoder.encode([words])[0])


@query
def reactions_in_order(spark, sf_dir):
    """Phrases of interests as reactions and showings, one after the other, have left them."""
    rows = _advanced(spark, sf_dir).select("user_id", F.posexplode("phrases").alias("place", "p"))
    return rows.select("user_id", "place", "p.coi_id", "p.words", "p.standing", _r("p.relevance").alias("relevance"))


@query
def phrases_shown_in_order(spark, sf_dir):
    return _advanced(spark, sf_dir).select("user_id", F.inline("shown")).withColumn("score", _r("score"))


@query
def kp_mmr_select(spark, sf_dir):
    """Each hundred vectors are a user's phrases, the first of a label its interest: an interest has few phrases at any size."""
    own = _phrases(spark, sf_dir).withColumn("user_id", F.expr("vec_id div 100"))
    first = own.groupBy("user_id", "coi_id").agg(F.min_by("point", "vec_id").alias("point")).withColumn("polarity", F.lit("pos"))
    return kp.select_for_interests(own.drop("vec_id"), first).withColumn("relevance", _r("relevance"))


@query
def listnet_ltr_scores(spark, sf_dir):
    return listnet_scores(_features(spark, sf_dir), ListNet.random(7), ["user_id"]).withColumn("ltr_score", _r("ltr_score"))


@query
def wordpiece_encode(spark, sf_dir):
    vocab = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *map(chr, range(97, 123)), *(f"##{chr(c)}" for c in range(97, 123)), "the", "##tion", "ing", "##ing", ".", ","]
    w = WordPiece({t: i for i, t in enumerate(vocab)}, max_length=52)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"  # rows hold whole texts
    spark.conf.set(key, str(min(1_000, int(spark.conf.get(key)) or 1_000)))
    rows = d.table(spark, sf_dir, "documents").select("doc_id", w.ids_column(F.col("text")).alias("parts"))
    return rows.select("doc_id", F.col("parts")[0].alias("ids"), F.slice("parts", 2, 1 << 30).alias("overflowing"))


def _conversations(spark, sf_dir):
    """Turns as the documents of a conversation's request, its first text the query."""
    c = d.table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") % d.USERS).alias("user_id"), F.col("conv_id").alias("request_id"), F.col("turn").cast("int").alias("doc_pos"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("turn").cast("int").alias("rank"), F.col("role").alias("title"), F.col("text").alias("snippet"), F.col("text").alias("query_words"))


@query
def qa_distance(spark, sf_dir):
    return qa_distances(_conversations(spark, sf_dir), NgramEncoder(32)).select("request_id", "id", _r("similarity").alias("similarity"))


@query
def rerank_standard_search(spark, sf_dir):
    done = rerank(Mode.STANDARD_SEARCH, _conversations(spark, sf_dir), encoder=NgramEncoder(32))
    return done.ranked.select("request_id", "id", _r("context").alias("context"), "final_rank")


@query
def rerank_personalized_search(spark, sf_dir):
    """Each turn has a vector of the table as its embedding; the conversation's user has interests."""
    e = d.table(spark, sf_dir, "embeddings")
    docs = _conversations(spark, sf_dir).withColumn("_v", (F.col("request_id") * 7 + F.col("doc_pos")) % e.count())
    docs = docs.join(e.select(F.col("vec_id").alias("_v"), "embedding"), "_v").drop("_v")
    done = rerank(Mode.PERSONALIZED_SEARCH, docs, d.interests(spark, sf_dir), encoder=NgramEncoder(32))
    return done.ranked.select("request_id", "id", _r("context").alias("context"), "final_rank")


@query
def sample_spans(spark, sf_dir):
    return sm.sample_spans(d.history(spark, sf_dir))


@query
def training_samples(spark, sf_dir):
    s = sm.training_samples(materialize(d.history(spark, sf_dir)))
    return s.select("sample_id", F.size("inputs").alias("n"), F.posexplode("target").alias("rank", "t")).select("sample_id", "n", "rank", _r("t").alias("target"))


@query
def key_phrase_extraction(spark, sf_dir):
    docs = d.table(spark, sf_dir, "benchmark")
    return kp.extract(docs, "item_id", "text", NgramEncoder(16), PhraseScorer.random(16), 5).withColumn("score", _r("score"))


@query
def phrases_taken(spark, sf_dir):
    """Phrases left after the top ten were shown."""
    rows = _phrases(spark, sf_dir).select("user_id", "coi_id", "words", F.transform("point", lambda x: x.cast("double")).alias("point"), F.lit(0.5).alias("relevance"), F.lit(False).alias("cleaned"))
    _, after = ps.take_top(rows, d.interests(spark, sf_dir), _as_of(), 10)
    return after.select("user_id", "coi_id", "words", "cleaned")
