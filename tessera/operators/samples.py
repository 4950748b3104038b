"""Training samples from histories, and metrics between encoders' outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vector import cosine, target_distribution
from ..sources.scratch import materialize
from .features import features_50
from .history import with_actions, with_runs

def sample_spans(history: DataFrame) -> DataFrame:
    """-> user_id, start, stop: positions of the last query with a relevant result; users without one are left out.

    A query starts behind the last entry whose session and count both differ from the end's; queries without a relevant
    result are passed over, the latest first. Neighbours of one session and count are one run, and a user's runs are folded
    from the last one back.
    """
    along = Window.partitionBy("user_id").orderBy("hist_pos")
    differs = lambda a, b: F.coalesce(a != b, F.lit(True))
    new = differs(F.lag("session").over(along), F.col("session")) | differs(F.lag("query_count").over(along), F.col("query_count"))
    marked = history.select("user_id", "hist_pos", "session", "query_count", "relevance", new.cast("long").alias("new"))
    rows = marked.withColumn("run", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    hit = F.coalesce(F.max(F.col("relevance") > 0), F.lit(False))
    runs = rows.groupBy("user_id", "run").agg(F.min("hist_pos").alias("start"), F.max("hist_pos").alias("last"), F.first("session").alias("session"), F.first("query_count").alias("query_count"), hit.alias("hit"))
    lists = runs.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("run", "start", (F.col("last") + 1).alias("stop"), "session", "query_count", "hit")), asc=False).alias("l"))

    def back(q: Column, r: Column) -> Column:
        begins = differs(r["session"], q["session"]) & differs(r["query_count"], q["query_count"])
        longer = F.struct(q["run"].alias("run"), r["start"].alias("start"), q["stop"].alias("stop"), q["session"].alias("session"), q["query_count"].alias("query_count"), (q["hit"] | r["hit"]).alias("hit"), q["done"].alias("done"))
        closed = q.withField("done", F.lit(True))
        return F.when(q["done"], q).when(~begins, longer).when(q["hit"], closed).otherwise(r.withField("done", F.lit(False)))

    first = F.col("l")[0].withField("done", F.lit(False))
    found = lists.select("user_id", F.aggregate(F.slice("l", 2, F.greatest(F.lit(0), F.size("l") - 1)), first, back).alias("q"))
    return found.filter("q.hit").select(F.col("user_id").cast("long").alias("user_id"), F.col("q.start").cast("long").alias("start"), F.col("q.stop").cast("long").alias("stop"))


def training_samples(history: DataFrame) -> DataFrame:
    """-> sample_id (the user), inputs, target: the last relevant query ranked by features of the history before it."""
    rows = history.join(sample_spans(history), "user_id")
    query = with_actions(rows.filter("hist_pos >= start and hist_pos < stop"))
    # users whose ranks don't make one list have no sample
    fine = query.groupBy("user_id").agg((F.count("*") == F.countDistinct("rank")).alias("a"), (F.max("rank") == F.count("*") - 1).alias("b"), (F.count_distinct(F.struct("session", "query_id")) == 1).alias("c")).filter("a and b and c")
    query = materialize(query.join(fine.select("user_id"), "user_id", "left_semi"))
    before = materialize(with_runs(with_actions(rows.filter("hist_pos < start").join(query.select("user_id").distinct(), "user_id", "left_semi"))))
    features = features_50(before, query.select("user_id", "rank", "session", "query_id", "terms", "url", "domain"))
    lists = features.join(query.select("user_id", "rank", "relevance"), ["user_id", "rank"]).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rank", "features", "relevance"))).alias("l"))
    return lists.select(F.col("user_id").alias("sample_id"), F.col("l.features").alias("inputs"), target_distribution(F.col("l.relevance")).alias("target"))


def agreement(pairs: DataFrame) -> DataFrame:
    """pairs of vectors (want, got) -> mae, mre, mse, mean_cosine."""
    deltas = F.zip_with("want", "got", lambda a, b: F.abs(a - b))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x) / F.size(c)
    relative = F.zip_with("want", "got", lambda a, b: F.when(a == 0, F.abs(b)).otherwise(F.abs((a - b) / F.when(a != 0, a))))
    squares = F.transform(deltas, lambda x: x * x)
    rows = pairs.select(mean(deltas).alias("mae"), mean(relative).alias("mre"), mean(squares).alias("mse"), cosine(F.col("want"), F.col("got")).alias("cosine"))
    return rows.agg(F.avg("mae").alias("mae"), F.avg("mre").alias("mre"), F.avg("mse").alias("mse"), F.avg("cosine").alias("mean_cosine"))
