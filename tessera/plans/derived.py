"""Histories, requests and interests derived from the driver's tables, the same way in every query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

AS_OF = "2024-06-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as results of queries of five, three queries a session."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))
    e = e.withColumn("hp", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1)
    kind = F.col("event_type")
    rows = e.select(
        F.col("user_id").cast("long"), F.col("hp").alias("hist_pos"), F.col("event_id").cast("long").alias("id"), F.expr("hp div 15").alias("session"), F.expr("(hp div 5) % 3").alias("query_count"), F.expr("(hp div 5) % 7").alias("query_id"),
        (F.col("hp") % 5).alias("rank"), F.concat(F.lit("u"), F.col("k") % 20).alias("url"), F.concat(F.lit("d"), F.col("k") % 6).alias("domain"), F.weekday("ts").alias("day"), (F.col("event_id") % 3).cast("int").alias("user_feedback"),
        F.when(kind == "purchase", 2).when(kind == "click", 1).otherwise(0).alias("relevance"), F.when(kind == "view", 1).when(kind == "error", 0).otherwise(2).alias("user_action"),
    )
    return rows.withColumn("query_words", F.concat(F.lit("w"), F.col("query_id"), F.lit(" w"), F.col("query_id") % 3))


def current_and_past(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The last query of each user as its current request, and the history before it."""
    h = history(spark, sf_dir).withColumn("_q", F.expr("hist_pos div 5"))
    last = h.groupBy("user_id").agg(F.max("_q").alias("_last"))
    rows = h.join(last, "user_id")
    return rows.filter("_q = _last").drop("_q", "_last"), rows.filter("_q < _last").drop("_q", "_last")


#: The requests are dealt to so many users in turn.
USERS = 4


def user_of(id: str) -> Column:
    """The user of a vector's request."""
    return F.expr(f"({id} div 20) % {USERS}").cast("long")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as documents of requests of twenty, of several users."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(user_of("vec_id").alias("user_id"), F.expr("vec_id div 20").alias("request_id"), (F.col("vec_id") % 20).cast("int").alias("doc_pos"), F.col("vec_id").alias("id"), (F.col("vec_id") % 20).cast("int").alias("rank"), "embedding", "label")


def interests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first embedding of each label; labels up to 4 are liked, the others disliked."""
    e = table(spark, sf_dir, "embeddings").groupBy(user_of("vec_id").alias("user_id"), "label").agg(F.min_by("embedding", "vec_id").alias("point"))
    return e.select(
        "user_id", F.when(F.col("label") < 5, "pos").otherwise("neg").alias("polarity"), F.col("label").cast("int").alias("coi_pos"), F.format_string("coi%02d", "label").alias("coi_id"),
        F.transform("point", lambda x: x.cast("double")).alias("point"), (F.col("label") + 1).cast("long").alias("view_count"), (F.col("label") * 10.0).alias("view_time"), F.timestamp_seconds(F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.col("label") * 86400 * 3).alias("last_view"),
    )
