"""The ranker: reactions and viewing times teach interests and key phrases; documents are ranked by their score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.layers import PhraseScorer
from ..functions.wordpiece import Encoder
from ..operators.interests import Config
from ..operators.keyphrase import extract
from ..operators.ranking import rank_documents
from ..operators.user_state import advance, interests_of, no_states, phrases_of, states_of
from ..sources.scratch import materialize
from ..sources.tables import load_state, save_state


def mapped(documents: DataFrame, id: str = "id", embedding: str = "embedding", published: str = "published") -> DataFrame:
    """Documents of any column names as the ranker reads them; the other columns are kept under their own names."""
    names = {id: "id", embedding: "embedding", published: "published"}
    missing = [c for c in names if c not in documents.columns]
    if missing:
        raise ValueError(f"documents lack {missing}")
    clash = [c for c in documents.columns if c in names.values() and c not in names]
    if clash:
        raise ValueError(f"other columns have the names {clash}")
    return documents.withColumnsRenamed(names)


@dataclass
class Ranker:
    """State is a table with a row for each user, written after every method that changes it.

    Reactions are user_id, seq, event_id, feedback (0 relevant, 1 irrelevant, 2 not given), embedding, at and candidates
    (an array of phrases) or a snippet, whose phrases are extracted; views are user_id, seq, event_id, feedback, embedding,
    seconds, at. Events of a call are taken one after the other: each finds interests and phrases as those before left
    them. keep_stale: whether leftover phrases keep the relevance they had (``operators.phrase_book``).
    """

    state: DataFrame
    encoder: Encoder
    config: Config = Config()
    phrase_encoder: Encoder | None = None
    scorer: PhraseScorer | None = None
    most_phrases: int | None = None
    least_score: float | None = None
    keep_stale: bool = True

    @classmethod
    def empty(cls, spark, encoder: Encoder, config: Config = Config(), **more) -> Ranker:  # noqa: B008
        return cls(no_states(spark), encoder, config, **more)

    @classmethod
    def of(cls, interests: DataFrame, phrases: DataFrame, encoder: Encoder, config: Config = Config(), **more) -> Ranker:  # noqa: B008
        """A ranker that begins with interests and phrases from elsewhere."""
        return cls(materialize(states_of(interests, phrases)), encoder, config, **more)

    @property
    def interests(self) -> DataFrame:
        return interests_of(self.state)

    @property
    def phrases(self) -> DataFrame:
        return phrases_of(self.state)

    def save(self, folder: str) -> None:
        """The users' state, a versioned table."""
        save_state(self.state, f"{folder}/users")

    @classmethod
    def restore(cls, spark, folder: str, encoder: Encoder, config: Config = Config(), **more) -> Ranker:  # noqa: B008
        """From what was saved, also as two tables, interests and phrases, as earlier versions did."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/users")
        if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return cls(spark.read.parquet(f"{folder}/users").drop("schema_version"), encoder, config, **more)
        return cls.of(load_state(spark, f"{folder}/interests"), load_state(spark, f"{folder}/phrases", phrases=True), encoder, config, **more)

    def _with_candidates(self, reactions: DataFrame) -> DataFrame:
        if "candidates" in reactions.columns:
            return reactions
        if self.scorer is None or self.phrase_encoder is None:
            raise ValueError("snippets need a phrase encoder and a scorer")
        keyed = reactions.withColumn("_k", F.struct("user_id", "seq"))
        found = extract(keyed, "_k", "snippet", self.phrase_encoder, self.scorer, self.most_phrases, self.least_score)
        lists = found.groupBy("_k").agg(F.collect_list("phrase").alias("candidates"))
        return keyed.join(lists, "_k", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>"))).drop("_k")

    def _advance(self, events: DataFrame) -> DataFrame:
        encoder = self.encoder
        done = materialize(advance(self.state, events, lambda words: encoder.encode([words])[0], self.config, self.keep_stale))
        self.state = done.drop("shown")
        return done

    def log_reactions(self, reactions: DataFrame) -> None:
        """Relevant reactions teach positive interests and their phrases, irrelevant ones negative interests."""
        kind = F.when(F.col("feedback") == 0, "like").when(F.col("feedback") == 1, "dislike")
        self._advance(self._with_candidates(reactions).withColumn("kind", kind).filter("kind is not null"))

    def log_views(self, views: DataFrame) -> None:
        """Viewing time goes to the closest positive interest unless the document was found irrelevant."""
        self._advance(views.filter("feedback <> 1").withColumn("kind", F.lit("view")))

    def rank(self, documents: DataFrame, as_of: Column) -> DataFrame:
        return rank_documents(documents, self.interests, as_of, self.config)

    def select_top_key_phrases(self, top: int, as_of: Column) -> DataFrame:
        """-> user_id, position, coi_id, words, score: each user's best phrases, which count as shown from now on."""
        shows = self.state.select("user_id", F.lit(0).alias("seq"), F.lit("show").alias("event_id"), F.lit("show").alias("kind"), F.lit(top).alias("top"), as_of.alias("at"))
        done = self._advance(shows)
        return done.select("user_id", F.inline("shown")).select("user_id", "position", "coi_id", "words", "score")
