"""Scans along long histories, segment by segment: no user is one task.

A window over a user puts the user's whole history into one task. Here a history is cut into segments of so many
positions; windows run within (user, segment), every segment gives one summary row, a window over a user's few summaries
carries what a segment has to know of those before and behind it, and a join brings it back. Windows and join share one
partitioning of the rows by (user, segment), so that the rows are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Positions of a segment.
SEGMENT = 100_000
_BEFORE = (Window.unboundedPreceding, -1)


def _cut(rows: DataFrame, segment: int, user: str, pos: str) -> DataFrame:
    return rows.withColumn("_seg", F.floor(F.col(pos) / segment))


def _joined(rows: DataFrame, carried: DataFrame, user: str) -> DataFrame:
    """By shuffle at any size: the rows are partitioned by (user, segment) already."""
    return rows.join(carried.hint("merge"), [user, "_seg"])


def cumulative_sum(rows: DataFrame, value: Column, name: str, segment: int = SEGMENT, user: str = "user_id", pos: str = "hist_pos") -> DataFrame:
    """rows with the sum of the value over the user's rows before."""
    cut = _cut(rows, segment, user, pos).withColumn("_v", value)
    own = Window.partitionBy(user, "_seg").orderBy(pos).rowsBetween(*_BEFORE)
    local = cut.withColumn("_sum", F.coalesce(F.sum("_v").over(own), F.lit(0)))
    sums = cut.groupBy(user, "_seg").agg(F.sum("_v").alias("_all"))
    carried = sums.select(user, "_seg", F.coalesce(F.sum("_all").over(Window.partitionBy(user).orderBy("_seg").rowsBetween(*_BEFORE)), F.lit(0)).alias("_carry"))
    return _joined(local, carried, user).select(*rows.columns, (F.col("_sum") + F.col("_carry")).alias(name))


def runs(rows: DataFrame, keys: list[str], flag: Column, segment: int = SEGMENT, user: str = "user_id", pos: str = "hist_pos") -> DataFrame:
    """rows with run_id (from 1) of their stretch of neighbours with equal keys, seen, its flags up to here, and total, all its flags.

    A null key ends a run, as it equals nothing.
    """
    segments = Window.partitionBy(user, "_seg")
    order = segments.orderBy(pos)
    differs = lambda before, now: F.coalesce(before != now, F.lit(True))
    new = F.lit(False)
    for k in keys:
        new = new | differs(F.lag(k).over(order), F.col(k))
    first = F.row_number().over(order) == 1
    cut = _cut(rows, segment, user, pos).withColumn("_flag", F.coalesce(flag.cast("long"), F.lit(0)))
    cut = cut.withColumn("_run", F.sum(F.when(first, 0).otherwise(new.cast("int"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(user, "_seg", "_run")
    local = cut.withColumns({"_seen": F.sum("_flag").over(run.orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)), "_total": F.sum("_flag").over(run), "_last": F.max("_run").over(segments)})

    ends = [F.min_by(k, pos).alias(f"_a{i}") for i, k in enumerate(keys)] + [F.max_by(k, pos).alias(f"_z{i}") for i, k in enumerate(keys)]
    flags = lambda where: F.sum(F.when(where, F.col("_flag")).otherwise(0))
    sums = local.groupBy(user, "_seg").agg(*ends, F.max("_last").alias("_last"), F.sum("_flag").alias("_all"), flags(F.col("_run") == 0).alias("_head"), flags(F.col("_run") == F.col("_last")).alias("_tail"))
    along = Window.partitionBy(user).orderBy("_seg")
    fresh = F.row_number().over(along) == 1
    for i in range(len(keys)):
        fresh = fresh | differs(F.lag(f"_z{i}").over(along), F.col(f"_a{i}"))
    sums = sums.withColumn("_fresh", fresh)
    sums = sums.withColumns({
        "_before": F.coalesce(F.sum("_all").over(along.rowsBetween(*_BEFORE)), F.lit(0)),
        "_runs": F.coalesce(F.sum(F.col("_last") + F.col("_fresh").cast("int")).over(along.rowsBetween(*_BEFORE)), F.lit(0)) + F.col("_fresh").cast("int"),
    })
    inner = F.col("_last") > 0
    # flags before the run that is open at a segment's end, where it began here; where a run that comes in here ends
    began = F.when(inner | F.col("_fresh"), F.col("_before") + F.col("_all") - F.col("_tail"))
    ended = F.when(F.col("_fresh"), F.col("_before")).when(inner, F.col("_before") + F.col("_head"))
    whole = F.sum("_all").over(Window.partitionBy(user))
    behind = F.coalesce(F.first(ended, ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)), whole) - F.col("_before") - F.col("_all")
    carried = sums.select(user, "_seg", "_runs", F.when(F.col("_fresh"), 0).otherwise(F.col("_before") - F.last(began, ignorenulls=True).over(along.rowsBetween(*_BEFORE))).alias("_in"), behind.alias("_out"))
    come = F.when(F.col("_run") == 0, F.col("_in")).otherwise(0)
    go = F.when(F.col("_run") == F.col("_last"), F.col("_out")).otherwise(0)
    return _joined(local, carried, user).select(*rows.columns, (F.col("_run") + F.col("_runs")).alias("run_id"), (F.col("_seen") + come).alias("seen"), (F.col("_total") + come + go).alias("total"))


def with_runs(history: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """As ``history.with_runs``: run_id of neighbours with the same session and count, click_index and run_clicks."""
    out = runs(history, ["session", "query_count"], F.col("clicked"), segment)
    return out.select(*history.columns, "run_id", (F.col("seen") - 1).alias("click_index"), F.col("total").alias("run_clicks"))


def infer_actions(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """As ``history.infer_actions``: a result of low relevance is a skip if a click of its query comes after it."""
    out = runs(rows, ["query_id"], F.col("relevance") > 0, segment)
    action = F.when(F.col("relevance") > 0, 2).when(F.col("total") > F.col("seen"), 1).otherwise(0)
    return out.select(*rows.columns, action.alias("inferred_action"))
