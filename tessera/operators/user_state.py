"""Users' whole state as one table, a row for each: interests of either polarity and key phrases, learned in order.

Interests and phrases depend on each other at every reaction: a reaction finds the closest interest as it then is, moves
it, and teaches phrases to it where it then stands. So a user's events are one fold. The fold reads sorted rows: state and
events of a user are neighbours in a partition, and a task holds one user's state and one batch of events, however long
a history is. The streaming job (``streaming.user_state``) folds with the same function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.vector import EPSILON32, SECONDS_PER_DAY
from .interests import INTERESTS, Coi, Config, react, view
from .phrase_book import SHOWN, Phrase, PhraseBook
from .phrase_state import PHRASES

INTEREST = "coi_id string, point array<double>, view_count long, view_time double, last_view timestamp"
PHRASE = "coi_id string, words string, point array<double>, own boolean, relevance double, standing string"
SHOWING = "event_id string, position int, coi_id string, words string, score double"


def _nested(columns: str) -> str:
    return f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in columns.split(', '))}>>"


STATES = f"user_id long, pos {_nested(INTEREST)}, neg {_nested(INTEREST)}, phrases {_nested(PHRASE)}"
ADVANCED = f"{STATES}, shown {_nested(SHOWING)}"
#: Events; kind is like, dislike, view (uses seconds) or show (uses top). What a kind doesn't use may be null.
EVENT_COLUMNS = {"seq": "long", "event_id": "string", "kind": "string", "embedding": "array<double>", "candidates": "array<string>", "seconds": "double", "top": "int", "at": "timestamp"}
Encode = Callable[[str], np.ndarray]


@dataclass
class UserState:
    pos: list[Coi] = field(default_factory=list)
    neg: list[Coi] = field(default_factory=list)
    book: PhraseBook = field(default_factory=PhraseBook)


def _utc(at: datetime | None) -> datetime | None:
    return at.replace(tzinfo=timezone.utc) if at is not None and at.tzinfo is None else at


def relevances(cois: list[Coi], as_of: datetime, horizon_days: float) -> dict[str, float]:
    """Each interest's share of views and viewing time, decayed since its last view; one never seen has none."""
    views = sum(c.count for c in cois) + EPSILON32
    time = sum(c.time for c in cois) + EPSILON32
    horizon, out = np.exp(-0.1 * horizon_days), {}
    for c in cois:
        elapsed = 0.0 if c.last_view is None else max((_utc(as_of) - _utc(c.last_view)).total_seconds(), 0.0)
        left = 0.0 if c.last_view is None else max((horizon - np.exp(-0.1 * elapsed / SECONDS_PER_DAY)) / (horizon - 1 - EPSILON32), 0.0)
        out[c.id] = float(max((c.count / views + c.time / time) * left, 0.0))
    return out


def apply(state: UserState, user_id: int, event: dict, encode: Encode, config: Config) -> list[dict]:
    """One event changes the state; the phrases it shows."""
    kind = event["kind"]
    if kind == "show":
        chosen = state.book.show(relevances(state.pos, event["at"], config.horizon_days), int(event["top"]), config.penalty)
        return [{"event_id": event["event_id"], "position": k, "coi_id": p.coi_id, "words": p.words, "score": s} for k, (p, s) in enumerate(chosen, 1)]
    point = np.asarray(event["embedding"], float)
    if not np.isfinite(point).all():
        raise ValueError("vector is not finite")
    if kind == "like":
        coi = react(state.pos, user_id, event["event_id"], point, event["at"], config)
        state.book.learn(coi.id, coi.point, event["candidates"] or [], encode, config)
    elif kind == "dislike":
        react(state.neg, user_id, event["event_id"], point, event["at"], config)
    elif kind == "view":
        view(state.pos, point, float(event["seconds"] or 0))
    return []


# --- rows ---------------------------------------------------------------------------------------


def to_interests(cois: list[Coi]) -> list[dict]:
    return [{"coi_id": c.id, "point": c.point.tolist(), "view_count": c.count, "view_time": c.time, "last_view": _utc(c.last_view)} for c in cois]


def of_interests(rows: list[dict] | None) -> list[Coi]:
    return [Coi(r["coi_id"], np.asarray(r["point"], float), int(r["view_count"]), float(r["view_time"]), _utc(r["last_view"])) for r in rows or []]


def to_phrases(book: PhraseBook) -> list[dict]:
    return [{"coi_id": p.coi_id, "words": p.words, "point": np.asarray(p.point, float).tolist(), "own": p.own, "relevance": float(p.relevance), "standing": p.standing} for p in book.phrases]


def of_phrases(rows: list[dict] | None, keep_stale: bool) -> PhraseBook:
    return PhraseBook([Phrase(r["coi_id"], r["words"], np.asarray(r["point"], float), bool(r["own"]), float(r["relevance"]), r["standing"]) for r in rows or []], keep_stale)


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def advance(states: DataFrame, events: DataFrame, encode: Encode, config: Config = Config(), keep_stale: bool = True, held: int = 200) -> DataFrame:  # noqa: B008
    """The states after the events (user_id and EVENT_COLUMNS), by seq and event_id, and what was shown (ADVANCED).

    Users without events keep their state, users without a state begin with none. Ids of new interests follow from user
    and event, so that a task that runs again gives the same rows.
    """
    spark = states.sparkSession
    names = list(EVENT_COLUMNS)
    own = events.select("user_id", F.lit(1).alias("_e"), *[(F.col(c) if c in events.columns else F.lit(None)).cast(t).alias(c) for c, t in EVENT_COLUMNS.items()])
    first = states.select("user_id", F.lit(0).alias("_e"), *[F.lit(None).cast(t).alias(c) for c, t in EVENT_COLUMNS.items()], F.struct("pos", "neg", "phrases").alias("_state"))
    rows = first.unionByName(own, allowMissingColumns=True).repartition("user_id").sortWithinPartitions("user_id", "_e", "seq", "event_id")
    schema = _arrow(spark, ADVANCED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        user, state, shown = None, None, []

        def close() -> None:
            if state is not None:
                done.append({"user_id": user, "pos": to_interests(state.pos), "neg": to_interests(state.neg), "phrases": to_phrases(state.book), "shown": shown})

        for b in batches:
            users, is_event = b.column("user_id").to_pylist(), b.column("_e").to_pylist()
            columns = {c: b.column(c).to_pylist() for c in (*names, "_state")}
            for k, (u, e) in enumerate(zip(users, is_event, strict=True)):
                if state is None or u != user:
                    close()
                    user, state, shown = u, UserState(book=PhraseBook(keep_stale=keep_stale)), []
                    if len(done) >= held:
                        yield pa.RecordBatch.from_pylist(done, schema=schema)
                        done = []
                if e:
                    shown += apply(state, u, {c: columns[c][k] for c in names}, encode, config)
                else:
                    s = columns["_state"][k]
                    state = UserState(of_interests(s["pos"]), of_interests(s["neg"]), of_phrases(s["phrases"], keep_stale))
        close()
        yield pa.RecordBatch.from_pylist(done, schema=schema)

    return rows.mapInArrow(run, ADVANCED)


# --- as tables ----------------------------------------------------------------------------------


def no_states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATES)


def interests_of(states: DataFrame) -> DataFrame:
    """The states' interests, as INTERESTS."""
    sides = [states.select("user_id", F.lit(p).alias("polarity"), F.posexplode(p).alias("coi_pos", "c")) for p in ("pos", "neg")]
    return sides[0].unionByName(sides[1]).select("user_id", "polarity", "coi_pos", "c.*")


def phrases_of(states: DataFrame) -> DataFrame:
    """The states' phrases, as PHRASES; cleaned ones were shown."""
    rows = states.select("user_id", F.explode("phrases").alias("p"))
    return rows.select("user_id", "p.coi_id", "p.words", "p.point", "p.relevance", (F.col("p.standing") == SHOWN).alias("cleaned"))


def states_of(interests: DataFrame, phrases: DataFrame) -> DataFrame:
    """One row a user from INTERESTS and PHRASES; the phrases stand under relevances of their own."""
    item = F.struct("coi_pos", F.struct(*[c.split(" ")[0] for c in INTEREST.split(", ")]).alias("c"))
    lists = interests.groupBy("user_id").agg(*[F.transform(F.sort_array(F.collect_list(F.when(F.col("polarity") == p, item))), lambda x: x["c"]).alias(p) for p in ("pos", "neg")])
    standing = F.when(F.col("cleaned"), SHOWN).otherwise("held")
    one = F.struct("coi_id", "words", "point", F.lit(True).alias("own"), "relevance", standing.alias("standing"))
    books = phrases.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("relevance", "words", one.alias("p")))), lambda x: x["p"]).alias("phrases"))
    both = lists.join(books, "user_id", "full")
    kinds = dict(c.split(" ", 1) for c in (f"pos {_nested(INTEREST)}", f"neg {_nested(INTEREST)}", f"phrases {_nested(PHRASE)}"))
    return both.select("user_id", *[F.coalesce(F.col(c), F.array()).cast(t).alias(c) for c, t in kinds.items()])


__all__ = ["ADVANCED", "INTERESTS", "PHRASES", "STATES", "UserState", "advance", "apply", "interests_of", "no_states", "phrases_of", "relevances", "states_of"]
