"""Interests and key phrases from a stream of reactions and showings, as typed state of each user.

Interests are list states and phrases a map state, so that a store holds them as rows; the fold is that of
``operators.user_state``, event by event. A restart from the checkpoint goes on where the query was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.interests import Config
from ..operators.user_state import ADVANCED, EVENT_COLUMNS, INTEREST, PHRASE, Encode, UserState, apply, of_interests, of_phrases, to_interests, to_phrases

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_INTEREST_NAMES = [c.split(" ")[0] for c in INTEREST.split(", ")]
_PHRASE_NAMES = [c.split(" ")[0] for c in PHRASE.split(", ")]


class _Users(StatefulProcessor):
    def __init__(self, encode: Encode, config: Config, keep_stale: bool):
        self.encode, self.config, self.keep_stale = encode, config, keep_stale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sides = {p: handle.getListState(p, INTEREST) for p in ("pos", "neg")}
        self.phrases = handle.getMapState("phrases", "place int", PHRASE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lists = {p: [dict(zip(_INTEREST_NAMES, r, strict=True)) for r in s.get()] if s.exists() else [] for p, s in self.sides.items()}
        book = sorted((k[0], dict(zip(_PHRASE_NAMES, v, strict=True))) for k, v in self.phrases.iterator()) if self.phrases.exists() else []
        state = UserState(of_interests(lists["pos"]), of_interests(lists["neg"]), of_phrases([p for _, p in book], self.keep_stale))
        events = pd.concat(list(rows)).sort_values(["seq", "event_id"])
        shown: list[dict] = []
        for e in events.to_dict("records"):
            shown += apply(state, key[0], e | {"at": e["at"].to_pydatetime(), "candidates": None if e["candidates"] is None else list(e["candidates"])}, self.encode, self.config)
        out = {"pos": to_interests(state.pos), "neg": to_interests(state.neg)}
        for p, s in self.sides.items():
            s.clear()
            if out[p]:
                s.put([tuple(r.values()) for r in out[p]])
        phrases = to_phrases(state.book)
        self.phrases.clear()
        for place, p in enumerate(phrases):
            self.phrases.updateValue((place,), tuple(p.values()))
        yield pd.DataFrame({"user_id": [key[0]], "pos": [out["pos"]], "neg": [out["neg"]], "phrases": [phrases], "shown": [shown]})

    def close(self) -> None:
        pass


def user_state_stream(events: DataFrame, encode: Encode, config: Config = Config(), keep_stale: bool = True) -> DataFrame:  # noqa: B008
    """events: a stream of user_id and EVENT_COLUMNS -> each user's state after a micro-batch, and what it showed (ADVANCED).

    Within a micro-batch a user's events go by seq and event_id; an event counts when it comes. States live in the RocksDB
    store, which this sets for the session.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = events.select("user_id", *[(F.col(c) if c in events.columns else F.lit(None)).cast(t).alias(c) for c, t in EVENT_COLUMNS.items()])
    return rows.groupBy("user_id").transformWithStateInPandas(_Users(encode, config, keep_stale), ADVANCED, "update", "None")
