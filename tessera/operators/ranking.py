"""Context scores, ranks, outcomes, nDCG analytics, interest relevance and the interest-based document score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vector import EPSILON32, decay, nan_lowest_desc
from .interests import Config, interest_lists, with_nearest

REQUEST = ["user_id", "request_id"]
# What stages that are switched off give, and how far gains look.
NEUTRAL_SIMILARITY = 0.5
NEUTRAL_LTR = 0.5
NIL = "00000000-0000-0000-0000-000000000000"
TOP = 2


# --- context and rank ---------------------------------------------------------------------------


def context(documents: DataFrame, keys: list[str] = REQUEST) -> DataFrame:
    """Adds context, from similarity, pos_similarity, neg_similarity and ltr_score against their request's.

    The score falls as similarity and pos_similarity grow: it takes both as distances.
    """
    w = Window.partitionBy(*keys)
    pos_avg, sim_avg = F.avg("pos_similarity").over(w), F.avg("similarity").over(w)
    neg_max = F.max(F.when(~F.isnan("neg_similarity"), F.col("neg_similarity"))).over(w)
    frac_pos = F.when(pos_avg > 0, 1 / (1 + F.col("pos_similarity") / pos_avg)).otherwise(1.0)
    frac_neg = 1 / (1 + (neg_max - F.col("neg_similarity")))
    frac_sim = F.when(sim_avg > 0, 1 / (1 + F.col("similarity") / sim_avg)).otherwise(0.5)
    return documents.withColumn("context", (7 * frac_sim + frac_pos + frac_neg + F.col("ltr_score")) / 10)


def rank_by_context(documents: DataFrame, keys: list[str] = REQUEST) -> DataFrame:
    """Adds final_rank: context descending, NaN last, ties in document order."""
    order = Window.partitionBy(*keys).orderBy(*nan_lowest_desc(F.col("context")), "doc_pos")
    return documents.withColumn("final_rank", (F.row_number().over(order) - 1).cast("int"))


def rank_by_identity(documents: DataFrame) -> DataFrame:
    return documents.withColumn("final_rank", F.col("doc_pos").cast("int"))


# --- analytics ----------------------------------------------------------------------------------


def gains(scored: DataFrame, scores: dict[str, str], keys: list[str], k: int = TOP) -> DataFrame:
    """-> keys and for each name the nDCG of the order by its score (NaN lowest); the gain itself where the ideal is 0.

    All orders are windows over one partitioning, and one aggregation follows.
    """
    w = Window.partitionBy(*keys)
    place = lambda c: F.row_number().over(w.orderBy(*nan_lowest_desc(F.col(c).cast("double")), "doc_pos"))
    placed = scored.select("*", place("relevance").alias("_best"), *[place(c).alias(f"_{name}") for name, c in scores.items()])
    gain = lambda i: F.sum(F.when(F.col(i) <= k, (F.pow(F.lit(2.0), F.col("relevance").cast("double")) - 1) / F.log2(F.col(i) + 1.0)).otherwise(0.0))
    sums = placed.groupBy(*keys).agg(gain("_best").alias("_best"), *[gain(f"_{name}").alias(name) for name in scores])
    return sums.select(*keys, *[F.when(F.col("_best") == 0, F.col(n)).otherwise(F.col(n) / F.when(F.col("_best") != 0, F.col("_best"))).alias(n) for n in scores])


def analytics(ranked: DataFrame, history: DataFrame, keys: list[str] = REQUEST, k: int = TOP) -> DataFrame:
    """-> keys and nDCG by ltr score, context, final and initial rank, of the documents with a history entry."""
    from .history import latest_by_id

    own = [*(c for c in keys if c in history.columns), "id"]
    rows = ranked.join(latest_by_id(history, own).select(*own, "relevance"), own)
    rows = rows.select(*keys, "doc_pos", "relevance", "ltr_score", "context", (-F.col("final_rank")).alias("final"), (-F.col("rank")).alias("initial"))
    return gains(rows, {"ndcg_ltr": "ltr_score", "ndcg_context": "context", "ndcg_final_ranking": "final", "ndcg_initial_ranking": "initial"}, keys, k)


# --- relevance and score of interests -------------------------------------------------------------


def coi_relevance(interests: DataFrame, as_of: Column, horizon_days: float = 30.0) -> DataFrame:
    """-> user_id, coi_id, relevance: shares of views and of viewing time among the positive ones, decayed since the last view."""
    w = Window.partitionBy("user_id")
    count = F.col("view_count") / (F.sum("view_count").over(w) + EPSILON32)
    time = F.col("view_time") / (F.sum("view_time").over(w) + EPSILON32)
    value = F.greatest(F.lit(0.0), (count + time) * decay(horizon_days, as_of, F.col("last_view")))
    pos = interests.filter("polarity = 'pos'")
    return pos.select("user_id", "coi_id", value.alias("relevance"))


def document_scores(documents: DataFrame, interests: DataFrame, as_of: Column, config: Config = Config()) -> DataFrame:  # noqa: B008
    """documents with score; null for users with too few interests."""
    relevant = interests.join(coi_relevance(interests, as_of, config.horizon_days), ["user_id", "coi_id"], "left")
    enough = (F.size("pos") >= config.min_positive) & (F.size("neg") >= config.min_negative)
    lists = interest_lists(relevant, "relevance").filter(enough)
    rows = with_nearest(documents, lists, "relevance")
    faded = lambda p: F.col(f"_{p}.similarity") * decay(config.horizon_days, as_of, F.col(f"_{p}.last_view"))
    return rows.select(*documents.columns, (faded("pos") + F.col("_pos.relevance") - faded("neg")).alias("score"))


def rank_documents(documents: DataFrame, interests: DataFrame, as_of: Column, config: Config = Config()) -> DataFrame:  # noqa: B008
    """Adds score and position: score ascending; for users with a document without a score the newest first.

    documents: user_id, doc_pos, published, embedding.
    """
    rows = document_scores(documents, interests, as_of, config)
    fails = F.max(F.col("score").isNull().cast("int")).over(Window.partitionBy("user_id"))
    rows = rows.withColumn("_fails", fails)
    order = Window.partitionBy("user_id").orderBy(F.when(F.col("_fails") == 0, F.col("score")).asc_nulls_last(), F.when(F.col("_fails") == 1, F.col("published")).desc_nulls_last(), "doc_pos")
    return rows.withColumn("position", F.row_number().over(order) - 1).drop("_fails")


# --- key phrases --------------------------------------------------------------------------------


def top_key_phrases(phrases: DataFrame, interests: DataFrame, as_of: Column, top: int, config: Config = Config()) -> DataFrame:  # noqa: B008
    """-> user_id, position, coi_id, words, score: the best phrases of each user after penalties by place in their interest.

    phrases: user_id, coi_id, words. Within an interest the phrases go by words from the end; ties over interests go by
    relevance ascending, then coi_id, as they were met.
    """
    rel = coi_relevance(interests, as_of, config.horizon_days)
    place = F.row_number().over(Window.partitionBy("user_id", "coi_id").orderBy(F.desc("words")))
    penalty = F.element_at(F.array(*[F.lit(float(p)) for p in config.penalty]), F.col("place"))
    rows = phrases.join(rel, ["user_id", "coi_id"]).withColumn("place", place).filter(F.col("place") <= len(config.penalty)).withColumn("score", F.col("relevance") * penalty)
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "relevance", "coi_id", "place")
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= top).select("user_id", "position", "coi_id", "words", "score")
