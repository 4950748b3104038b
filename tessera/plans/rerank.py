"""Re-ranking plans: four modes over many users and requests at once, with data-driven fallbacks and a table of faults.

A plan is one DataFrame; where a request lacks what a stage needs (no positive interest, no features), its documents get
the stage's neutral values by coalesce and a row in ``faults``. Nothing is tried and caught around lazy plans.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import IntEnum
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vector import l2_distance
from ..functions.wordpiece import Encoder, encode_column
from ..operators.features import features_50
from ..operators.history import matching_documents, query_terms, with_actions, with_runs
from ..operators.interests import Config, assign, feedback_events, learn, synchronize
from ..operators.listnet import ListNet, listnet_scores
from ..operators.ranking import NEUTRAL_LTR, NEUTRAL_SIMILARITY, NIL, REQUEST, analytics, context, rank_by_context, rank_by_identity
from ..sources.scratch import materialize
from ..sources.tables import load_state, save_state, state_from_bytes, state_to_bytes

FAULTS = "user_id long, request_id long, stage string, code string"


class Mode(IntEnum):
    STANDARD_NEWS = 0
    PERSONALIZED_NEWS = 1
    STANDARD_SEARCH = 2
    PERSONALIZED_SEARCH = 3

    @property
    def personalized(self) -> bool:
        return self in (Mode.PERSONALIZED_NEWS, Mode.PERSONALIZED_SEARCH)

    @property
    def search(self) -> bool:
        return self in (Mode.STANDARD_SEARCH, Mode.PERSONALIZED_SEARCH)


@dataclass
class Outcome:
    ranked: DataFrame
    faults: DataFrame


def qa_text() -> Column:
    """The snippet, or the title where it is empty."""
    return F.when(F.coalesce(F.col("snippet"), F.lit("")) == "", F.col("title")).otherwise(F.col("snippet"))


def qa_distances(documents: DataFrame, encoder: Encoder) -> DataFrame:
    """Adds similarity: the distance of each text from its request's query, that of the first document, encoded once."""
    query = documents.groupBy(*REQUEST).agg(F.min_by("query_words", "doc_pos").alias("_q")).withColumn("_qe", encode_column(encoder, F.col("_q"))).drop("_q")
    rows = documents.withColumn("_te", encode_column(encoder, qa_text())).join(query, REQUEST)
    return rows.withColumn("similarity", l2_distance(F.col("_qe"), F.col("_te"))).drop("_qe", "_te")


def with_ltr(documents: DataFrame, history: DataFrame | None, net: ListNet | None, strict_alignment: bool = True) -> DataFrame:
    """Adds ltr_score; constant without a network or history, null where a document got no score. One request per user.

    Scores go by rank. With strict_alignment False they are dealt to the documents in their given order instead.
    """
    if history is None or net is None:
        return documents.withColumn("ltr_score", F.lit(NEUTRAL_LTR))
    features = features_50(with_runs(with_actions(history)), documents.withColumn("terms", query_terms(F.col("query_words"))))
    scores = listnet_scores(features, net, ["user_id"])
    if not strict_alignment:
        scores = scores.withColumnRenamed("rank", "doc_pos")
    return documents.join(scores, ["user_id", "rank" if strict_alignment else "doc_pos"], "left")


@dataclass(frozen=True)
class Systems:
    """The stages of a service, each a function of frames that another may take the place of.

    embed adds the embedding to documents that have none; without it they must have one where a mode is personalised.
    """

    embed: Callable[[DataFrame], DataFrame] | None = None
    assign: Callable[[DataFrame, DataFrame], DataFrame] = assign
    similarity: Callable[[DataFrame, Encoder], DataFrame] = qa_distances
    ltr: Callable[[DataFrame, DataFrame | None, ListNet | None, bool], DataFrame] = with_ltr
    context: Callable[[DataFrame], DataFrame] = context
    learn: Callable[[DataFrame, DataFrame, Config], DataFrame] = learn
    analytics: Callable[[DataFrame, DataFrame], DataFrame] = analytics


def rerank(mode: Mode, documents: DataFrame, interests: DataFrame | None = None, history: DataFrame | None = None, encoder: Encoder | None = None, net: ListNet | None = None, strict_alignment: bool = True, systems: Systems = Systems()) -> Outcome:  # noqa: B008
    """documents (user_id, request_id, doc_pos, id, rank; embedding if personalised; texts and query_words if searched)."""
    spark = documents.sparkSession
    faults = spark.createDataFrame([], FAULTS)
    rows = documents
    if mode.personalized:
        rows = systems.assign(systems.embed(rows) if systems.embed and "embedding" not in rows.columns else rows, interests)
        missing = rows.filter("coi_id is null").select(*REQUEST).distinct()
        faults = faults.unionByName(missing.select(*REQUEST, F.lit("coi").alias("stage"), F.lit("NoCoi").alias("code")))
        rows = rows.withColumn("neg_similarity", F.when(F.col("coi_id").isNull(), 0.0).otherwise(F.col("neg_similarity"))).withColumn("pos_similarity", F.coalesce("pos_similarity", F.lit(0.0))).withColumn("coi_id", F.coalesce("coi_id", F.lit(NIL)))
    else:
        rows = rows.withColumns({"coi_id": F.lit(NIL), "pos_similarity": F.lit(0.0), "neg_similarity": F.lit(0.0)})
    rows = systems.similarity(rows, encoder) if mode.search else rows.withColumn("similarity", F.lit(NEUTRAL_SIMILARITY))
    rows = systems.ltr(rows, history, net, strict_alignment) if mode.personalized else rows.withColumn("ltr_score", F.lit(NEUTRAL_LTR))
    if mode.personalized and net is not None and history is not None:
        # a request with a document that the network gave no finite score is neutral as a whole
        failed = F.max((F.col("ltr_score").isNull() | F.isnan("ltr_score")).cast("int")).over(Window.partitionBy(*REQUEST)) == 1
        rows = rows.withColumn("_failed", failed)
        faults = faults.unionByName(rows.filter("_failed").select(*REQUEST).distinct().select(*REQUEST, F.lit("ltr").alias("stage"), F.lit("LtrFailed").alias("code")))
        rows = rows.withColumn("ltr_score", F.when(F.col("_failed"), NEUTRAL_LTR).otherwise(F.col("ltr_score"))).drop("_failed")
    rows = systems.context(rows)
    rows = rank_by_identity(rows) if mode is Mode.STANDARD_NEWS else rank_by_context(rows)
    return Outcome(rows, faults)


def outcomes(ranked: DataFrame, mode: Mode, documents: DataFrame | None = None) -> DataFrame:
    """-> user_id, request_id, id, final_rank and the scores the mode reports.

    documents: of whose ids there must be an outcome each; one without is an error. Of repeated ids the last one counts.
    """
    none = F.lit(None).cast("double")
    out = ranked.select(*REQUEST, "id", "doc_pos", "final_rank", (F.col("similarity") if mode.search else none).alias("qa_similarity"), (F.col("context") if mode.personalized else none).alias("context_score"))
    if documents is None:
        return out.drop("doc_pos")
    scores = ("final_rank", "qa_similarity", "context_score")
    best = out.groupBy(*REQUEST, "id").agg(F.max_by(F.struct(*scores), "doc_pos").alias("_best"), F.lit(True).alias("_found"))
    rows = documents.select(*REQUEST, "id").join(best, [*REQUEST, "id"], "left").select(*REQUEST, "id", *[f"_best.{c}" for c in scores], "_found")
    return rows.filter(F.when(F.col("_found"), True).otherwise(F.raise_error(F.concat(F.lit("no outcome for document "), F.col("id").cast("string"))).cast("boolean"))).drop("_found")


def initial_outcomes(documents: DataFrame) -> DataFrame:
    """What a request gets when nothing can be computed: the ranks it came with."""
    none = F.lit(None).cast("double")
    return documents.select(*REQUEST, "id", F.col("rank").alias("final_rank"), none.alias("qa_similarity"), none.alias("context_score"))


def feedback_faults(previous: DataFrame, history: DataFrame) -> DataFrame:
    """Faults of the feedback on the last ranking: requests none of whose documents the history knows.

    Nothing can be learned from those, and no analytics be made.
    """
    met = matching_documents(history, previous, [*(k for k in REQUEST if k in history.columns), "id"])
    lost = previous.select(*REQUEST).distinct().join(met.select(*REQUEST).distinct(), REQUEST, "left_anti")
    kinds = [("coi", "NoMatchingDocuments")] + ([("analytics", "NoRelevantHistoricInfo")] if "context" in previous.columns else [])
    stages = F.explode(F.array(*[F.struct(F.lit(a).alias("stage"), F.lit(b).alias("code")) for a, b in kinds]))
    return lost.select(*REQUEST, stages.alias("f")).select(*REQUEST, "f.stage", "f.code")


PREVIOUS = ("doc_pos", "id", "rank", "embedding", "ltr_score", "context", "final_rank")


def run_calls(calls: DataFrame, encoder: Encoder, as_of: Column, net: ListNet | None = None, pre_runs: int = 0) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame]:
    """Recorded calls (call, rerank_mode, histories, documents, state), each by a service of its own -> outcomes, faults, analytics, states.

    A call is a user with one request. It is repeated pre_runs times before, which changes the state it ends with. Calls
    of one mode run together.
    """
    spark = calls.sparkSession
    calls = materialize(calls)
    docs = calls.select(F.col("call").alias("user_id"), F.lit(0).cast("long").alias("request_id"), "rerank_mode", F.posexplode("documents").alias("doc_pos", "d")).select("user_id", "request_id", "rerank_mode", "doc_pos", "d.*")
    docs = docs.withColumn("embedding", encode_column(encoder, F.col("title")))
    past = calls.select(F.col("call").alias("user_id"), F.posexplode("histories").alias("hist_pos", "h")).select("user_id", F.col("hist_pos").cast("long").alias("hist_pos"), "h.*")
    done = []
    for mode in Mode:
        own = calls.filter(F.col("rerank_mode") == int(mode))
        if not own.limit(1).count():
            continue
        service = Reranker.from_bytes(own.select(F.col("call").alias("user_id"), "state"), encoder=encoder, net=net)
        now, history = docs.filter(F.col("rerank_mode") == int(mode)).drop("rerank_mode"), past.join(own.select(F.col("call").alias("user_id")), "user_id", "left_semi")
        for _ in range(pre_runs + 1):
            out = service.rerank(mode, history, now, as_of)
        done.append((out, service.faults, service.analytics, service.serialize()))
    if not done:
        none = spark.createDataFrame([], "user_id long, request_id long, id string, final_rank int, qa_similarity double, context_score double")
        return none, spark.createDataFrame([], FAULTS), None, spark.createDataFrame([], "user_id long, state binary")
    union = lambda k: reduce(DataFrame.unionByName, [x[k] for x in done if x[k] is not None]) if any(x[k] is not None for x in done) else None
    return union(0), union(1), union(2), union(3)


@dataclass
class Reranker:
    """The calls of one service: learn from the feedback on the last ranking, then rank anew. State is in tables."""

    interests: DataFrame
    config: Config = Config()
    encoder: Encoder | None = None
    net: ListNet | None = None
    previous: DataFrame | None = None
    analytics: DataFrame | None = None
    faults: DataFrame | None = None
    systems: Systems = Systems()

    def rerank(self, mode: Mode, history: DataFrame, documents: DataFrame, as_of: Column) -> DataFrame:
        faults = documents.sparkSession.createDataFrame([], FAULTS)
        self.analytics = None
        if self.previous is not None:
            faults = faults.unionByName(feedback_faults(self.previous, history))
            matched = matching_documents(history, self.previous, ["user_id", "id"])
            events = feedback_events(matched.withColumn("at", as_of), ["request_id", "id"])
            # written, as the next call's plans start from it
            self.interests = materialize(self.systems.learn(self.interests, events, self.config))
            if "context" in self.previous.columns:
                self.analytics = self.systems.analytics(self.previous, history)
        done = rerank(mode, documents, self.interests, history if self.net is not None else None, self.encoder, self.net, systems=self.systems)
        self.faults = faults.unionByName(done.faults)
        self.previous = materialize(done.ranked.select(*REQUEST, *[c for c in PREVIOUS if c in done.ranked.columns])) if mode.personalized else None
        return outcomes(done.ranked, mode)

    def synchronize(self, remote: DataFrame) -> None:
        self.interests = synchronize(self.interests, remote)

    def syncdata(self) -> DataFrame:
        """What devices exchange, in bytes by user: the interests."""
        return state_to_bytes(self.interests)

    def synchronize_bytes(self, states: DataFrame) -> None:
        self.synchronize(state_from_bytes(states, needed=True)[0])

    def serialize(self) -> DataFrame:
        """-> user_id, state: what a later service goes on from, in bytes."""
        return state_to_bytes(self.interests, self.previous)

    @classmethod
    def from_bytes(cls, states: DataFrame, **more) -> Reranker:
        """states: user_id, state; a user whose last call left no ranking to learn from has none."""
        interests, previous = state_from_bytes(states)
        previous = materialize(previous)
        return cls(interests, previous=previous if previous.limit(1).count() else None, **more)

    def save(self, folder: str) -> None:
        """Interests and the last ranking, each a versioned table."""
        save_state(self.interests, f"{folder}/interests")
        previous = self.previous
        if previous is None:
            previous = self.interests.sparkSession.createDataFrame([], "user_id long, request_id long, id string, doc_pos int")
        previous.write.mode("overwrite").parquet(f"{folder}/previous")

    @classmethod
    def restore(cls, spark: SparkSession, folder: str, **more) -> Reranker:
        previous = spark.read.parquet(f"{folder}/previous")
        return cls(load_state(spark, f"{folder}/interests"), previous=previous if "embedding" in previous.columns else None, **more)
