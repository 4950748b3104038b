"""Feedback as a stream: rankings that were shown meet the reactions to them, within a time range.

Both streams have watermarks, so that a shown document waits for reactions only as long as one can come. Documents that
nothing came for leave the join unmatched; a request is complete when all its documents have left. A complete request of
which no document was met is a fault (``NoMatchingDocuments``), of the others the analytics are made, by the batch
operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ranking import REQUEST, analytics
from ..plans.rerank import feedback_faults

SHOWN = ("doc_pos", "id", "rank", "ltr_score", "context", "final_rank")
REACTION = ("hist_pos", "relevance", "user_feedback")


def completed_requests(shown: DataFrame, reactions: DataFrame, within: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """-> user_id, request_id, shown_at, rows: each document with each reaction to it, or none.

    shown: user_id, request_id, shown_at (the same for a request's documents) and SHOWN; reactions: user_id, id, at and
    REACTION (hist_pos is their order). A reaction counts from the showing until ``within`` after it.
    """
    s = shown.select(*REQUEST, "shown_at", *SHOWN).withWatermark("shown_at", delay)
    r = reactions.select(F.col("user_id").alias("_user"), F.col("id").alias("_id"), F.col("at").alias("_at"), *REACTION).withWatermark("_at", delay)
    in_time = (F.col("_at") >= F.col("shown_at")) & (F.col("_at") <= F.col("shown_at") + F.expr(f"INTERVAL {within}"))
    met = s.join(r, (F.col("user_id") == F.col("_user")) & (F.col("id") == F.col("_id")) & in_time, "left_outer")
    return met.groupBy(*REQUEST, "shown_at").agg(F.collect_list(F.struct(*SHOWN, *REACTION)).alias("rows"))


def settle(completed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Complete requests -> their faults, and the nDCG of those that were met; of a document's reactions the last counts."""
    rows = completed.select(*REQUEST, F.inline("rows"))
    ranked = rows.select(*REQUEST, *SHOWN).dropDuplicates([*REQUEST, "doc_pos"])
    history = rows.filter("hist_pos is not null").select(*REQUEST, "id", *REACTION)
    return feedback_faults(ranked, history), analytics(ranked, history)


def settle_stream(completed: DataFrame, faults: str, ndcg: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write faults and analytics of requests as they are completed; a batch that runs again writes the same files anew."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for rows, path in zip(settle(batch), (faults, ndcg), strict=True):
            rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        batch.unpersist()

    query = completed.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
    return (query.trigger(**trigger) if trigger else query).start()
