"""The fifty ranking features of a request's documents, from the user's history, without a documents x history product.

Everything additive is aggregated once, at the grain (user, url or domain, key, query, session); nine predicates over a
document's url and domain are then conditional sums after one equi-join. Snippet quality isn't additive below a run of
results, so that its scores are made per run first, with and without the query in the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .history import CLICK1, CLICK2, MISS, SKIP

# The prior of reciprocal ranks; the predicates (same query or any, and which sessions).
PRIOR = 0.283
PREDICATES = {"base": (False, None), "ant": (False, "ant"), "q": (True, None), "q_ant": (True, "ant"), "q_cur": (True, "cur")}


def mean_reciprocal_rank(total: Column, n: Column) -> Column:
    return (PRIOR + F.coalesce(total, F.lit(0.0))) / (1 + F.coalesce(n, F.lit(0)))


def conditional_probability(n_outcome: Column, n_all: Column, miss: bool = False) -> Column:
    """Share of an outcome; misses add one above and their own number below. 0 without any result."""
    n_all, n_outcome = F.coalesce(n_all, F.lit(0)), F.coalesce(n_outcome, F.lit(0))
    up, down = (n_outcome + 1, n_all + n_outcome) if miss else (n_outcome, n_all)
    return F.when(n_all == 0, F.lit(0.0)).otherwise(up.cast("double") / down)


def _kinds(rows: DataFrame, *columns: str) -> DataFrame:
    """One row for the url and one for the domain."""
    keys = F.explode(F.array(F.struct(F.lit("u").alias("kind"), F.col("url").alias("key")), F.struct(F.lit("d").alias("kind"), F.col("domain").alias("key")))).alias("k")
    return rows.select(*columns, keys).select(*columns, "k.kind", "k.key")


def _count(condition: Column) -> Column:
    return F.sum(condition.cast("int"))


def outcome_sums(history: DataFrame) -> DataFrame:
    """Counts and sums of reciprocal ranks by outcome, by (user, kind, key, query, session)."""
    rows = _kinds(history.withColumn("rr", 1.0 / (F.col("rank") + 1)), "user_id", "query_id", "session", "action", "rr")
    a, rr = F.col("action"), F.col("rr")
    return rows.groupBy("user_id", "kind", "key", "query_id", "session").agg(
        F.count("*").alias("n"), _count(a == MISS).alias("n_miss"), _count(a == SKIP).alias("n_skip"), _count(a >= CLICK1).alias("n_click"), _count(a == CLICK2).alias("n_click2"),
        F.sum(rr).alias("r"), F.sum(F.when(a == MISS, rr).otherwise(0.0)).alias("r_miss"), F.sum(F.when(a == SKIP, rr).otherwise(0.0)).alias("r_skip"), F.sum(F.when(a >= CLICK1, rr).otherwise(0.0)).alias("r_click"),
    )


def snippet_scores(history: DataFrame, by_query: bool) -> DataFrame:
    """Sums of run scores by (user, kind, key, session), or by query too.

    A run with a matching skip loses one over its clicks; one with a matching click gains one over its place among them.
    """
    keys = ["user_id", "kind", "key", *(["query_id"] if by_query else []), "session"]
    rows = _kinds(history, "user_id", "query_id", "session", "run_id", "action", "clicked", "click_index", "run_clicks")
    runs = rows.groupBy(*keys, "run_id").agg(
        F.max((F.col("action") == SKIP).cast("int")).alias("skip"), F.max("run_clicks").alias("clicks"), F.min(F.when(F.col("clicked"), F.col("click_index"))).alias("first")
    )
    score = F.when((F.col("skip") == 1) & (F.col("clicks") > 0), -1.0 / F.col("clicks")).otherwise(0.0) + F.when(F.col("first").isNotNull(), 1.0 / (F.col("first") + 1)).otherwise(0.0)
    return runs.groupBy(*keys).agg(F.sum(score).alias("score"))


def _mask(name: str) -> Column:
    query, session = PREDICATES[name]
    m = F.lit(True)
    if query:
        m = m & (F.col("query_id") == F.col("d_query_id"))
    if session == "ant":
        m = m & (F.col("session") != F.col("d_session"))
    if session == "cur":
        m = m & (F.col("session") == F.col("d_session"))
    return F.coalesce(m, F.lit(False))


SUMS = ("n", "n_miss", "n_skip", "n_click", "n_click2", "r", "r_miss", "r_skip", "r_click")


def key_features(history: DataFrame, documents: DataFrame) -> DataFrame:
    """-> user_id, rank, m: a map from u_<predicate> (url) and d_<predicate> (domain) to sums and snippet quality (sq).

    Counts and both kinds of run scores are stacked to one table of facts, so that documents meet them by one join. A
    pair goes on once for each predicate that holds, and what follows are plain sums.
    """
    docs = _kinds(documents.withColumnRenamed("query_id", "d_query_id").withColumnRenamed("session", "d_session"), "user_id", "rank", "d_query_id", "d_session")
    facts = outcome_sums(history)
    for by_query, name in ((False, "run_score"), (True, "query_score")):
        facts = facts.unionByName(snippet_scores(history, by_query).withColumnRenamed("score", name), allowMissingColumns=True)
    holds = F.filter(F.array(*[F.when(_mask(p), F.lit(p)) for p in PREDICATES]), lambda p: p.isNotNull())
    rows = docs.join(facts, ["user_id", "kind", "key"], "left").withColumn("pred", F.explode(holds))
    sums = rows.groupBy("user_id", "rank", "kind", "pred").agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in (*SUMS, "run_score", "query_score")])
    poor = F.col("n_miss") + F.col("n_skip")
    score = F.when(F.col("pred").isin("base", "ant"), F.col("run_score")).otherwise(F.col("query_score"))
    item = F.struct(F.concat_ws("_", "kind", "pred").alias("k"), F.struct(*SUMS, F.when(poor == 0, 0.0).otherwise(score / F.when(poor != 0, poor)).alias("sq")).alias("v"))
    return sums.groupBy("user_id", "rank").agg(F.map_from_entries(F.collect_list(item)).alias("m"))


def entropy(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Base-2 entropy of the counts of each key."""
    p = F.col(n) / F.sum(n).over(Window.partitionBy(*keys))
    return counts.withColumn("_p", p).groupBy(*keys).agg(F.sum(-F.col("_p") * F.log2("_p")).alias("click_entropy"))


def click_entropy(history: DataFrame, keys: list[str]) -> DataFrame:
    return entropy(history.filter("clicked").groupBy(*keys, "rank").agg(F.count("*").alias("n")), keys)


def query_features(history: DataFrame) -> DataFrame:
    """By (user, query): entropy, mean_query_count, occurs_per_session, num_occurs, click_mrr, mean_clicks, mean_non_clicks."""
    keys = ["user_id", "query_id"]
    occurs = history.groupBy(*keys, "session", "query_count").agg(
        F.count("*").alias("n"), _count(F.col("clicked")).alias("clicks"), F.sum(F.when(F.col("clicked"), 1.0 / (F.col("rank") + 1)).otherwise(0.0)).alias("rr")
    )
    sums = occurs.groupBy(*keys).agg(F.count("*").alias("num_occurs"), F.avg("query_count").alias("mean_query_count"), F.countDistinct("session").alias("sessions"), F.sum("clicks").alias("clicks"), F.sum("n").alias("n"), F.sum("rr").alias("rr"))
    return sums.join(click_entropy(history, keys), keys, "left").select(
        *keys, F.coalesce("click_entropy", F.lit(0.0)).alias("click_entropy"), "mean_query_count", (F.col("num_occurs") / F.col("sessions")).alias("occurs_per_session"), "num_occurs",
        mean_reciprocal_rank(F.col("rr"), F.col("clicks")).alias("click_mrr"), (F.col("clicks") / F.col("num_occurs")).alias("mean_clicks"), ((F.col("n") - F.col("clicks")) / F.col("num_occurs")).alias("mean_non_clicks"),
    )


def user_features(history: DataFrame) -> DataFrame:
    """By user: click_entropy, click12, click345, click6up, num_queries, words_per_query, unique_words_per_session."""
    rank, clicked = F.col("rank"), F.col("clicked")
    clicks = history.groupBy("user_id").agg(_count(clicked & (rank <= 1)).alias("click12"), _count(clicked & rank.between(2, 4)).alias("click345"), _count(clicked & (rank > 4)).alias("click6up"))
    queries = history.select("user_id", "session", "query_count", "query_id", "terms").distinct()
    per_query = queries.groupBy("user_id").agg(F.count("*").alias("num_queries"), F.avg(F.size("terms")).alias("words_per_query"))
    per_session = queries.groupBy("user_id", "session").agg(F.size(F.array_distinct(F.flatten(F.collect_set("terms")))).alias("w")).groupBy("user_id").agg(F.avg("w").alias("unique_words_per_session"))
    return clicks.join(per_query, "user_id").join(per_session, "user_id").join(click_entropy(history, ["user_id"]), "user_id", "left").withColumn("click_entropy", F.coalesce("click_entropy", F.lit(0.0)))


def seasonality(history: DataFrame) -> DataFrame:
    """By (user, domain) with clicks: 2.5 (1 + clicks on Thursday and Friday) / (1 + other clicks); none is 0."""
    weekend = F.col("day").isin(3, 4)
    return history.filter("clicked").groupBy("user_id", "domain").agg((2.5 * (1 + _count(weekend)) / (1 + _count(~weekend))).alias("seasonality"))


def with_cumulated(keyed: DataFrame) -> DataFrame:
    """Adds cum_skip, cum_click1, cum_click2: sums of the urls' probabilities over better ranks."""
    before = Window.partitionBy("user_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    u = F.col("m")["u_base"]
    n = {"skip": u["n_skip"], "click1": u["n_click"] - u["n_click2"], "click2": u["n_click2"]}
    return keyed.select("*", *[F.coalesce(F.sum(conditional_probability(c, u["n"])).over(before), F.lit(0.0)).alias(f"cum_{x}") for x, c in n.items()])


def features_50(history: DataFrame, documents: DataFrame) -> DataFrame:
    """-> user_id, rank, features (array of 50 doubles).

    history: with actions and runs; documents: one request per user with user_id, rank (0, 1, ...), session, query_id,
    terms, url, domain. A user whose ranks aren't 0..n-1 once each, or whose documents are of several queries, is an error.
    """
    bad = documents.groupBy("user_id").agg((F.count("*") != F.countDistinct("rank")) | (F.max("rank") != F.count("*") - 1) | (F.count_distinct(F.struct("session", "query_id")) > 1)).toDF("user_id", "bad")
    checked = documents.join(bad, "user_id").filter(F.when(F.col("bad"), F.raise_error(F.lit("ranks must be 0..n-1 of one query")).cast("boolean")).otherwise(True)).drop("bad")
    rows = checked.join(with_cumulated(key_features(history, checked)), ["user_id", "rank"])
    q = query_features(history)
    rows = rows.join(q.select("user_id", "query_id", F.struct(*[c for c in q.columns if c not in ("user_id", "query_id")]).alias("q")), ["user_id", "query_id"], "left")
    s = user_features(history)
    rows = rows.join(s.select("user_id", F.struct(*[c for c in s.columns if c != "user_id"]).alias("s")), "user_id", "left").join(seasonality(history), ["user_id", "domain"], "left")

    def mrr(k: str, outcome: str = "") -> Column:
        end = f"_{outcome}" if outcome else ""
        return mean_reciprocal_rank(F.col("m")[k][f"r{end}"], F.col("m")[k][f"n{end}"])

    def prob(k: str, outcome: str) -> Column:
        return conditional_probability(F.col("m")[k][f"n_{outcome}"], F.col("m")[k]["n"], outcome == "miss")

    def sq(k: str) -> Column:
        return F.coalesce(F.col("m")[k]["sq"], F.lit(0.0))

    values = [
        F.col("rank") + 1,
        mrr("u_base", "click"), prob("u_base", "click2"), prob("u_base", "miss"), sq("u_base"),
        prob("u_ant", "click2"), prob("u_ant", "miss"), sq("u_ant"),
        mrr("u_q"), prob("u_q", "click2"), prob("u_q", "miss"), sq("u_q"),
        mrr("u_q_ant"), mrr("u_q_ant", "click"), mrr("u_q_ant", "miss"), mrr("u_q_ant", "skip"), prob("u_q_ant", "miss"), sq("u_q_ant"),
        mrr("u_q_cur", "miss"),
        prob("d_base", "skip"), prob("d_base", "miss"), prob("d_base", "click2"), sq("d_base"),
        prob("d_ant", "click2"), prob("d_ant", "miss"), sq("d_ant"),
        prob("d_q", "miss"), sq("d_q"), mrr("d_q", "miss"),
        sq("d_q_ant"),
        F.coalesce("q.click_entropy", F.lit(0.0)), F.size("terms"), F.coalesce("q.mean_query_count", F.lit(0.0)), F.coalesce("q.occurs_per_session", F.lit(0.0)), F.coalesce("q.num_occurs", F.lit(0)),
        F.coalesce("q.click_mrr", F.lit(PRIOR)), F.coalesce("q.mean_clicks", F.lit(0.0)), F.coalesce("q.mean_non_clicks", F.lit(0.0)),
        *[F.coalesce(F.col(f"s.{c}"), F.lit(0)) for c in ("click_entropy", "click12", "click345", "click6up", "num_queries", "words_per_query", "unique_words_per_session")],
        F.col("cum_skip"), F.col("cum_click1"), F.col("cum_click2"),
        F.size(F.array_distinct("terms")), F.coalesce("seasonality", F.lit(0.0)),
    ]
    return rows.select("user_id", "rank", F.array(*[v.cast("double") for v in values]).alias("features"))
