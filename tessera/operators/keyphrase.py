"""Key phrases: candidates from a text, unification, maximal-marginal-relevance selection, ranking by scores."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.layers import PhraseScorer
from ..functions.wordpiece import ContextEncoder, Encoder, Encoding, OnnxEncoder, spoken_words, word_starts

# Words of a phrase, tokens of a text, at most.
MAX_WORDS = 5
MAX_TOKENS = 512


def ngrams(words: Column, longest: int = MAX_WORDS) -> Column:
    """All runs of 1 to longest words as structs (n, pos, phrase), by length and position."""
    size = F.size(words)
    runs = []
    for n in range(1, longest + 1):
        starts = F.when(size >= n, F.sequence(F.lit(1), size - (n - 1))).otherwise(F.array().cast("array<int>"))
        runs.append(_runs_of(words, starts, n))
    return F.concat(*runs)


def _runs_of(words: Column, starts: Column, n: int) -> Column:
    return F.transform(starts, lambda i: F.struct(F.lit(n).alias("n"), (i - 1).alias("pos"), F.array_join(F.slice(words, i, n), " ").alias("phrase")))


def candidates(docs: DataFrame, id_col: str, words: Column, longest: int = MAX_WORDS) -> DataFrame:
    """-> id, n, phrase, first_pos, mentions; a document with fewer than longest words has no candidates."""
    rows = docs.select(F.col(id_col), words.alias("_w")).filter(F.size("_w") >= longest).select(id_col, F.explode(ngrams(F.col("_w"), longest)).alias("g"))
    return rows.groupBy(id_col, F.col("g.n").alias("n"), F.col("g.phrase").alias("phrase")).agg(F.min("g.pos").alias("first_pos"), F.count("*").alias("mentions"))


def rank_phrases(scored: DataFrame, id_col: str, max_count: int | None = None, min_score: float | None = None) -> DataFrame:
    """scored: id, phrase, score of each mention -> id, position, phrase, score: a phrase has its best mention's score."""
    best = scored.groupBy(id_col, "phrase").agg(F.max("score").alias("score"))
    if min_score is not None:
        best = best.filter(F.col("score") >= min_score)
    best = best.withColumn("position", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("score"), "phrase")))
    return best if max_count is None else best.filter(F.col("position") <= max_count)


def clean(phrase: str) -> str:
    kind = lambda c: unicodedata.category(c)[0]
    spaced = re.sub(" +", " ", "".join({"S": "\1", "P": "\1", "Z": " "}.get(kind(c), c) for c in phrase))
    return re.sub(" +", " ", re.sub("\1+ *", " ", spaced)).strip()


def unify(known: dict[str, np.ndarray], new: list[str], encode: Callable[[str], np.ndarray]) -> dict[str, np.ndarray]:
    """Known phrases and cleaned new ones with a finite, non-empty point, by words; known raw candidates aren't encoded."""
    out = dict(known)
    for raw in new:
        if raw in known:
            continue
        words = clean(raw)
        point = np.asarray(encode(words), float)
        if words and len(point) and np.isfinite(point).all():
            out.setdefault(words, point)
    return dict(sorted(out.items()))


def similarities(points: np.ndarray, coi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosines among n phrases and (last column) with the interest, and their normalisation.

    Columns are scaled to their least and largest entry off the diagonal and then standardised around 0.5. Two habits of
    the standardisation are kept: means divide by n - 1 also in the last column, which has n entries, and a deviation's
    sum starts with its first entry unsquared. What isn't finite becomes 0.5.
    """
    n = len(points)
    rows = np.vstack([points, coi])
    norms = np.linalg.norm(rows, axis=1)
    outer = np.outer(norms, norms)
    s = np.where(outer == 0, 1.0, np.clip(np.divide(rows @ rows.T, outer, out=np.zeros_like(outer), where=outer != 0), -1, 1))[:n]
    normal = np.full(s.shape, 0.5)
    with np.errstate(all="ignore"):
        for j in range(n + 1):
            off = np.arange(n) != j
            if not off.any():
                continue
            low, high = s[off, j].min(), s[off, j].max()
            x = (s[:, j] - low) / (high - low)
            d = x - x[off].sum() / (n - 1) if n > 1 else np.full(n, np.nan)
            e = d[off]
            deviation = np.sqrt((e[0] + (e[1:] ** 2).sum()) / (n - 1)) if n > 1 else np.nan
            z = d / deviation + 0.5
            normal[:, j] = np.where(np.isfinite(z), z, 0.5)
    return s, normal


def select_phrases(phrases: dict[str, np.ndarray], coi: np.ndarray, most: int, gamma: float) -> list[tuple[str, float]]:
    """At most ``most`` phrases near the interest and unlike each other, with relevances in [0, 1]."""
    if not phrases:
        return []
    names = sorted(phrases)
    s, normal = similarities(np.array([phrases[k] for k in names]), np.asarray(coi, float))
    n = len(names)
    chosen = np.ones(n, bool)
    if n > most:
        chosen[:] = False
        chosen[int(np.argmax(normal[:, -1]))] = True
        for _ in range(most - 1):
            value = gamma * normal[:, -1] - (1 - gamma) * normal[:, :n][:, chosen].max(axis=1)
            value[chosen] = -np.inf
            chosen[int(np.argmax(value))] = True
    high = s[chosen, -1].max()
    return [(names[i], float(np.clip(s[i, -1] / high, 0, 1)) if s[i, -1] > 0 else 0.0) for i in np.flatnonzero(chosen)]


def select_for_interests(phrases: DataFrame, interests: DataFrame, most: int = 3, gamma: float = 0.9) -> DataFrame:
    """phrases: user_id, coi_id, words, point -> user_id, coi_id, words, relevance of the selected ones."""
    rows = phrases.join(interests.filter("polarity = 'pos'").select("user_id", "coi_id", F.col("point").alias("coi_point")), ["user_id", "coi_id"])

    def of_coi(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = select_phrases({r.words: np.asarray(r.point, float) for r in rows.itertuples()}, np.asarray(rows["coi_point"].iloc[0], float), most, gamma)
        return pd.DataFrame([(*key, w, r) for w, r in found], columns=["user_id", "coi_id", "words", "relevance"])

    return rows.groupBy("user_id", "coi_id").applyInPandas(of_coi, "user_id long, coi_id string, words string, relevance double")


def phrase_masks(encoding: Encoding, text: str, lengths: tuple[int, ...]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Of an encoded text: the mask of tokens that begin a word, its distinct phrases, and which run is a mention of which.

    Runs go by length and position; phrases in the order of their first run.
    """
    words = spoken_words(text, encoding)
    runs = [" ".join(words[i : i + n]) for n in lengths for i in range(len(words) - n + 1)]
    phrases = list(dict.fromkeys(runs))
    place = {p: k for k, p in enumerate(phrases)}
    active = np.zeros((len(phrases), len(runs)), bool)
    active[[place[r] for r in runs], np.arange(len(runs))] = True
    return np.array(word_starts(encoding.offsets), bool), phrases, active


def extract(docs: DataFrame, id_col: str, text_col: str, encoder: Encoder | OnnxEncoder | ContextEncoder, scorer: PhraseScorer, max_count: int | None = None, min_score: float | None = None) -> DataFrame:
    """-> id, position, phrase, score of each document's best phrases; documents of too few words have none.

    An encoder of tokens reads the text as one, its tokens in their context, and the tokens that begin a word go on; one
    that only encodes texts gets the words one by one. All runs of one to five are scored in Arrow batches, a phrase by its
    best mention; ranking is a window.
    """
    if max_count is not None and max_count < 1:
        raise ValueError("max_count must be positive")
    if min_score is not None and not np.isfinite(min_score):
        raise ValueError("min_score must be finite")
    in_context = hasattr(encoder, "tokens")
    if in_context and not 2 <= (encoder.tokenizer.max_length or MAX_TOKENS) <= MAX_TOKENS:
        raise ValueError(f"texts need a length of 2 to {MAX_TOKENS} tokens")

    def scored(text: str) -> list[tuple[str, float]]:
        if in_context:
            encoding, tokens = encoder.tokens([text])[0]
            valid, phrases, active = phrase_masks(encoding, text, scorer.lengths)
            words = tokens[valid]
        else:
            own = text.split()
            runs = [" ".join(own[i : i + n]) for n in scorer.lengths for i in range(len(own) - n + 1)]
            phrases, active, words = runs, np.eye(len(runs), dtype=bool), encoder.encode(own) if own else np.zeros((0, 1))
        if len(words) < max(scorer.lengths):
            return []
        return list(zip(phrases, np.where(active, scorer.scores(words)[None, :], -np.inf).max(axis=1).tolist(), strict=True))

    @F.pandas_udf("array<struct<phrase:string,score:double>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"phrase": p, "score": s} for p, s in scored(t or "")] for t in texts], dtype=object)

    mentions = docs.select(F.col(id_col), F.explode(run(F.col(text_col))).alias("m")).select(id_col, "m.phrase", "m.score")
    return rank_phrases(mentions, id_col, max_count, min_score)
