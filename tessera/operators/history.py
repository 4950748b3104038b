"""Search histories: actions, runs of results, click positions, inferred actions, matching, feedback.

A history has user_id, hist_pos (its order), session, query_count, query_id, query_words, rank (from 0), url, domain,
day (0 Monday), relevance (0..2), user_feedback (0 relevant, 1 irrelevant, 2 not given), user_action (0 miss, 1 skip, 2 click).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Action codes, in their order: skipped, missed, clicked without, with medium and with high relevance.
SKIP, MISS, CLICK0, CLICK1, CLICK2 = range(5)


def action() -> Column:
    return F.when(F.col("user_action") == 0, MISS).when(F.col("user_action") == 1, SKIP).otherwise(F.col("relevance") + CLICK0)


def query_terms(words: Column) -> Column:
    return F.filter(F.split(F.coalesce(words, F.lit("")), r"\s+"), lambda w: w != "")


def with_actions(history: DataFrame) -> DataFrame:
    """Adds action, clicked (a click of medium relevance at least) and terms."""
    return history.withColumn("action", action()).withColumn("clicked", F.col("action") >= CLICK1).withColumn("terms", query_terms(F.col("query_words")))


def with_runs(history: DataFrame) -> DataFrame:
    """Adds run_id, one for each stretch of neighbours with the same (session, query_count), click_index and run_clicks."""
    order = Window.partitionBy("user_id").orderBy("hist_pos")
    new = F.coalesce(((F.lag("session").over(order) != F.col("session")) | (F.lag("query_count").over(order) != F.col("query_count"))).cast("int"), F.lit(1))
    runs = history.withColumn("_new", new).withColumn("run_id", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    run = Window.partitionBy("user_id", "run_id")
    clicked = F.col("clicked").cast("int")
    return runs.withColumn("click_index", F.sum(clicked).over(run.orderBy("hist_pos").rowsBetween(Window.unboundedPreceding, 0)) - 1).withColumn("run_clicks", F.sum(clicked).over(run))


def infer_actions(rows: DataFrame) -> DataFrame:
    """Adds inferred_action: medium and high relevance are clicks; low is a skip before a click of its query, else a miss."""
    order = Window.partitionBy("user_id").orderBy("hist_pos")
    new = F.coalesce((F.lag("query_id").over(order) != F.col("query_id")).cast("int"), F.lit(1))
    runs = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    later = Window.partitionBy("user_id", "_run").orderBy("hist_pos").rowsBetween(1, Window.unboundedFollowing)
    seen = F.coalesce(F.max((F.col("relevance") > 0).cast("int")).over(later), F.lit(0))
    return runs.withColumn("inferred_action", F.when(F.col("relevance") > 0, 2).when(seen == 1, 1).otherwise(0)).drop("_new", "_run")


def latest_by_id(history: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key, the last one of the history."""
    others = [c for c in history.columns if c not in keys]
    last = history.groupBy(*keys).agg(F.max_by(F.struct(*others), "hist_pos").alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in others])


def matching_documents(history: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """Documents with relevance and feedback of their last history entry; documents without one are left out."""
    return documents.join(latest_by_id(history, keys).select(*keys, "relevance", "user_feedback"), keys)


def is_negative() -> Column:
    """Low relevance, and feedback that isn't positive."""
    return (F.col("relevance") == 0) & F.col("user_feedback").isin(1, 2)


def last_query_start(history: DataFrame) -> DataFrame:
    """For each user the position at which the last query starts: after the last entry of another session and count."""
    ends = history.groupBy("user_id").agg(F.max_by(F.struct("session", "query_count"), "hist_pos").alias("last"))
    before = history.join(ends, "user_id").filter((F.col("session") != F.col("last.session")) & (F.col("query_count") != F.col("last.query_count")))
    found = before.groupBy("user_id").agg((F.max("hist_pos") + 1).alias("start"))
    return ends.select("user_id").join(found, "user_id", "left").select("user_id", F.coalesce("start", F.lit(0)).cast("long").alias("start"))
