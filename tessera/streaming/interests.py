"""Interests from a stream of reactions: the batch fold, with each user's interests as state between micro-batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.interests import INTERESTS, Coi, Config, fold, to_rows


def _dump(cois: list[Coi]) -> str:
    return json.dumps([(c.id, c.point.tolist(), c.count, c.time, None if c.last_view is None else str(c.last_view)) for c in cois])


def _load(text: str) -> list[Coi]:
    return [Coi(i, np.array(p), n, t, None if v is None else pd.Timestamp(v)) for i, p, n, t, v in json.loads(text)]


def learn_stream(events: DataFrame, config: Config = Config(), delay: str = "1 hour") -> DataFrame:  # noqa: B008
    """events: user_id, event_id, kind, embedding, seconds, at -> the users' interests after each micro-batch.

    Within a micro-batch a user's events go by (at, event_id); events behind the watermark (delay) are dropped.
    """

    def of_user(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pos, neg = (_load(x) for x in state.get) if state.exists else ([], [])
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        if state.getCurrentWatermarkMs() > 0:
            rows = rows[rows["at"] >= pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")]
        fold(key[0], rows, pos, neg, config)
        state.update((_dump(pos), _dump(neg)))
        yield to_rows(key[0], pos, neg)

    watermarked = events.withWatermark("at", delay)
    return watermarked.groupBy("user_id").applyInPandasWithState(of_user, INTERESTS, "pos string, neg string", "update", GroupStateTimeout.NoTimeout)
