"""Key phrases of interests as a state table: replaced as interests learn, taken out as they are shown, refilled.

Rows have user_id, coi_id, words, point, relevance and cleaned (taken out). A phrase is known by its words within its
interest. Leftover phrases of an interest always carry the interest's present relevance.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vector import finite
from .interests import Config
from .keyphrase import select_phrases, unify
from .ranking import top_key_phrases

PHRASES = "user_id long, coi_id string, words string, point array<double>, relevance double, cleaned boolean"
KEYS = ["user_id", "coi_id", "words"]


def update(phrases: DataFrame, candidates: DataFrame, interests: DataFrame, encode: Callable[[str], np.ndarray], config: Config = Config()) -> DataFrame:  # noqa: B008
    """The phrases after new candidates (user_id, coi_id, candidates array): of both, each interest keeps the best.

    Interests without candidates keep their phrases as they are; phrases that were taken out go with what is replaced.
    """
    points = interests.filter("polarity = 'pos'").select("user_id", "coi_id", F.col("point").alias("coi_point"))
    news = candidates.groupBy("user_id", "coi_id").agg(F.flatten(F.collect_list("candidates")).alias("new")).join(points, ["user_id", "coi_id"])
    most, gamma = config.max_key_phrases, config.gamma

    def of_coi(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        if new.empty:
            return old
        live = old[~old["cleaned"].astype(bool)]
        known = {r.words: np.asarray(r.point, float) for r in live.itertuples()}
        both = unify(known, sorted(new["new"].iloc[0]), encode)
        chosen = select_phrases(both, np.asarray(new["coi_point"].iloc[0], float), most, gamma)
        return pd.DataFrame([(*key, w, both[w].tolist(), r, False) for w, r in chosen], columns=old.columns)

    return phrases.groupBy("user_id", "coi_id").cogroup(news.groupBy("user_id", "coi_id")).applyInPandas(of_coi, PHRASES)


def refill(phrases: DataFrame) -> DataFrame:
    """Users whose phrases are all taken out get them back."""
    left = F.max((~F.col("cleaned")).cast("int")).over(Window.partitionBy("user_id"))
    return phrases.withColumn("cleaned", F.when(left == 0, F.lit(False)).otherwise(F.col("cleaned")))


def take_top(phrases: DataFrame, interests: DataFrame, as_of: Column, top: int, config: Config = Config()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """The top phrases of each user, and the state with these taken out."""
    full = refill(phrases)
    chosen = top_key_phrases(full.filter("not cleaned").select(*KEYS), interests, as_of, top, config)
    marks = chosen.select(*KEYS, F.lit(True).alias("_taken"))
    after = full.join(marks, KEYS, "left").withColumn("cleaned", F.col("cleaned") | F.coalesce("_taken", F.lit(False))).drop("_taken")
    return chosen, after


def insert(phrases: DataFrame, more: DataFrame) -> DataFrame:
    """The state with further phrases (as PHRASES); of one that is there, the new row counts. Relevances must be finite."""
    new = more.withColumn("relevance", finite(F.col("relevance"))).dropDuplicates(KEYS)
    return phrases.join(new.select(*KEYS), KEYS, "left_anti").unionByName(new.select(*phrases.columns))


def remove(phrases: DataFrame, cois: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The phrases of some interests (user_id, coi_id), and the state without them."""
    on = ["user_id", "coi_id"]
    return phrases.join(cois.select(*on).distinct(), on, "left_semi"), phrases.join(cois.select(*on).distinct(), on, "left_anti")


def replace(phrases: DataFrame, relevances: DataFrame) -> DataFrame:
    """The state with new relevances (user_id, coi_id, relevance) of interests; all their phrases get them."""
    on = ["user_id", "coi_id"]
    new = relevances.select(*on, finite(F.col("relevance")).alias("_new"))
    return phrases.join(new, on, "left").withColumn("relevance", F.coalesce("_new", "relevance")).select(*phrases.columns)


def of_interests(relevances: DataFrame, cois: DataFrame) -> DataFrame:
    """Relevances of some interests (user_id, coi_id), the least first."""
    return relevances.join(cois, ["user_id", "coi_id"], "left_semi").orderBy("user_id", "relevance", "coi_id")
