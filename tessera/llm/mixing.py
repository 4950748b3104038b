"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic); the cells are raked, margin after margin, until their sums have the
target shares; a document's inclusion probability follows from its cell's share over its cell's tokens, scaled so that
the expected sample has ``keep`` of all tokens; cells that would be wanted more than once are taken whole, and their
documents carry the rest as a weight. A document is in the sample if a hash of its id falls below its probability.

With given targets (``mix_sources``) there are at most as many cells as the targets have combinations (each margin with
one cell more for all other values and null); only those that occur are fitted, on the driver.
``mix_tempered`` has a target for every value that there is: up to DRIVER_CELLS cells are raked on the driver, more of
them by alternate sums and joins with written tables of factors; both give the same shares.

Cases: null or unlisted values of a margin share its OTHER category, whose target is its observed share unless given;
null and empty texts have no tokens and are kept at their cell's probability; a null id is a value like others; repeated
rows are drawn together; very long texts count whole; an empty table gives no rows; other columns are kept, but input
columns n_tokens, probability and weight give way to those of the result.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

OTHER = "\0other"
DRIVER_CELLS = 200_000


def n_tokens(text: Column) -> Column:
    """Words between spaces and the characters 9 to 13."""
    text = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, "[ \t\n\x0B\f\r]+"))).cast("long")


@dataclass
class Fit:
    shares: np.ndarray
    rounds: int
    gap: float


def rake_cells(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], tolerance: float = 1e-10, most: int = 1000) -> Fit:
    """Scale the tokens of the cells that there are, margin by margin, until each margin's sums are its targets (shares).

    codes: for each margin the value of each cell. A value without any tokens can't get its share; what the targets ask
    for it is spread over the margin's others.
    """
    x = tokens / tokens.sum()
    axes = []
    for code, t in zip(codes, targets, strict=True):
        has = np.bincount(code, weights=x, minlength=len(t)) > 0
        goal = np.where(has, t, 0.0)
        axes.append((code, goal / goal.sum() if goal.sum() > 0 else has / has.sum()))
    gap = np.inf
    for done in range(1, most + 1):
        for code, goal in axes:
            own = np.bincount(code, weights=x, minlength=len(goal))
            x = x * np.divide(goal, own, out=np.zeros_like(goal), where=own > 0)[code]
        gap = max(np.abs(np.bincount(code, weights=x, minlength=len(goal)) - goal).max() for code, goal in axes)
        if gap < tolerance:
            break
    return Fit(x, done, float(gap))


def rake(table: np.ndarray, targets: list[np.ndarray], tolerance: float = 1e-10, most: int = 1000) -> Fit:
    """The same for a whole table, an axis for each margin."""
    at = np.nonzero(table)
    fit = rake_cells(table[at], list(at), targets, tolerance, most)
    shares = np.zeros(table.shape)
    shares[at] = fit.shares
    return Fit(shares, fit.rounds, fit.gap)


def probabilities(tokens: np.ndarray, shares: np.ndarray, keep: float) -> tuple[np.ndarray, np.ndarray]:
    """Inclusion probability and weight by cell: expected tokens are min(1, p) of the cell's, keep of all in sum."""
    want = keep * tokens.sum()
    rate = np.divide(shares, tokens, out=np.zeros_like(shares), where=tokens > 0)
    lo, hi = 0.0, 1.0
    some = rate[(rate > 0)]
    if not len(some):
        return np.full(tokens.shape, keep), np.ones(tokens.shape)
    hi = 1 / some.min()
    for _ in range(200):
        c = (lo + hi) / 2
        lo, hi = (c, hi) if (tokens * np.minimum(1, c * rate)).sum() < want else (lo, c)
    raw = hi * rate
    p = np.where(tokens > 0, np.minimum(1, raw), keep)
    return p, np.where(tokens > 0, np.maximum(1, raw), 1.0)


def tempered(observed: Mapping[str, float], power: float = 0.5) -> dict[str, float]:
    """Shares in proportion to a power of what is there."""
    total = sum(v**power for v in observed.values()) or 1.0
    return {k: v**power / total for k, v in observed.items()}


def _marked(docs: DataFrame, cells: list[Column], tokens: Column, id_col: str, seed: int) -> DataFrame:
    u = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), tokens.alias("_tokens"), u.alias("_u"), *[c.alias(f"_m{i}") for i, c in enumerate(cells)])


def _draw(docs: DataFrame, marked: DataFrame, known: DataFrame, keys: list[str], keep: float) -> DataFrame:
    drawn = marked.join(known, keys, "left").withColumn("_p", F.coalesce("_p", F.lit(float(keep)))).withColumn("_w", F.coalesce("_w", F.lit(1.0))).filter("_u < _p")
    own = [c for c in docs.columns if c not in ("n_tokens", "probability", "weight")]
    return drawn.select(*[F.col("_row").getField(c).alias(c) for c in own], F.col("_tokens").alias("n_tokens"), F.col("_p").alias("probability"), F.col("_w").alias("weight"))


def mix_sources(docs: DataFrame, targets: Mapping[str, Mapping[str, float]], margins: Mapping[str, Column] | None = None, tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text", keep: float = 0.5, seed: int = 0) -> DataFrame:
    """docs in the sample, with n_tokens, probability and weight.

    targets: for each margin the share of each value; margins: expressions for margins that aren't columns.
    """
    names = list(targets)
    exprs = [(margins or {}).get(m, F.col(m)).cast("string") for m in names]
    values = [[*targets[m], OTHER] for m in names]
    cells = [F.when(e.isin(list(t)), e).otherwise(F.lit(OTHER)) if t else F.lit(OTHER) for e, t in zip(exprs, (targets[m] for m in names), strict=True)]
    count = n_tokens(F.col(text_col)) if tokens is None else tokens
    marked = _marked(docs, cells, count, id_col, seed)
    keys = [f"_m{i}" for i in range(len(names))]
    # only combinations that occur: at most as many as the targets have, and as the table has
    cells = marked.groupBy(*keys).agg(F.sum("_tokens").alias("n")).filter("n > 0").toArrow()
    n = cells.column("n").to_numpy().astype(float)
    codes = [pc.index_in(cells.column(k), pa.array(v)).to_numpy().astype(np.int64) for k, v in zip(keys, values, strict=True)]
    goals = []
    for m, v, code in zip(names, values, codes, strict=True):
        t = np.array([targets[m].get(x, np.nan) for x in v], float)
        if np.isnan(t[-1]):
            t[-1] = n[code == len(v) - 1].sum() / max(n.sum(), 1.0)
        t[:-1] *= (1 - t[-1]) / max(t[:-1].sum(), 1e-300)
        goals.append(t)
    p, w = probabilities(n, rake_cells(n, codes, goals).shares, keep) if len(n) else (n, n)
    known = docs.sparkSession.createDataFrame(pa.table([*(cells.column(k).cast(pa.string()) for k in keys), pa.array(p, pa.float64()), pa.array(w, pa.float64())], names=[*keys, "_p", "_w"]))
    return _draw(docs, marked, F.broadcast(known), keys, keep)


def length_class(text: Column) -> Column:
    """A stand-in for a topic where a table has none."""
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(n < 500, "note").when(n < 2000, "short").when(n < 8000, "article").otherwise("long")


def _rake_here(cells: DataFrame, keys: list[str], power: float, keep: float, tolerance: float = 1e-10, most: int = 1000) -> DataFrame:
    """The cells' probabilities and weights, fitted on the driver."""
    t = cells.toArrow().sort_by([(k, "ascending") for k in keys])
    n = t.column("n").to_numpy().astype(float)
    total, axes = n.sum(), []
    for k in keys:
        values, code = np.unique(t.column(k).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        seen = np.bincount(code, weights=n)
        rest = float(seen[values == OTHER].sum() / total)
        goal = np.where(values == OTHER, 0.0, seen**power)
        goal *= (1 - rest) / max(goal.sum(), 1e-300)
        axes.append((code, goal + np.where(values == OTHER, rest, 0.0)))
    x = n / total
    for _ in range(most):
        for code, goal in axes:
            x = x * (goal / np.bincount(code, weights=x))[code]
        if max(np.abs(np.bincount(code, weights=x) - goal).max() for code, goal in axes) < tolerance:
            break
    p, w = probabilities(n, x, keep)
    return cells.sparkSession.createDataFrame(pa.table([*(t.column(k).cast(pa.string()) for k in keys), pa.array(p), pa.array(w)], names=[*keys, "_p", "_w"]))


def _rake_there(cells: DataFrame, keys: list[str], power: float, keep: float, tolerance: float = 1e-9, most: int = 1000) -> DataFrame:
    """The same by sums and joins: x is n times a factor for each value; a margin's factors follow from the others'."""
    total = float(cells.agg(F.sum("n")).first()[0])
    factors = []
    for k in keys:
        sums = materialize(cells.groupBy(k).agg(F.sum("n").cast("double").alias("s")))
        rest, roots = sums.agg(F.coalesce(F.sum(F.when(F.col(k) == OTHER, F.col("s"))), F.lit(0.0)) / total, F.sum(F.when(F.col(k) != OTHER, F.pow("s", F.lit(power))))).first()
        goal = F.when(F.col(k) == OTHER, F.col("s") / total).otherwise(F.pow("s", F.lit(power)) / (roots or 1.0) * (1 - rest))
        factors.append(materialize(sums.select(k, goal.alias("goal"), F.lit(1.0).alias("f"))))

    def scaled(but: int | None = None) -> DataFrame:
        x, share = cells, F.col("n") / total
        for j, k in enumerate(keys):
            if j != but:
                x, share = x.join(factors[j].select(k, F.col("f").alias(f"_f{j}")), k), share * F.col(f"_f{j}")
        return x.select(*keys, "n", share.alias("x"))

    for _ in range(most):
        gap = 0.0
        for i, k in enumerate(keys):
            own = scaled(i).groupBy(k).agg(F.sum("x").alias("own")).join(factors[i], k)
            new = materialize(own.select(k, "goal", (F.col("goal") / F.col("own")).alias("f"), F.abs(F.col("own") * F.col("f") - F.col("goal")).alias("gap")))
            gap = max(gap, new.agg(F.max("gap")).first()[0])
            factors[i] = new
        if gap < tolerance:
            break
    rates = materialize(scaled())
    # wanted is what c times the shares give, where no cell gives more than it has: c only grows as cells are used up
    want, c = keep * total, 0.0
    while True:
        full = F.col("x") * c >= F.col("n")
        used, left, most_c = rates.agg(F.coalesce(F.sum(F.when(full, F.col("n"))), F.lit(0)).cast("double"), F.coalesce(F.sum(F.when(~full, F.col("x"))), F.lit(0.0)), F.max(F.col("n") / F.col("x"))).first()
        before, c = c, min((want - used) / left if left > 0 else most_c, most_c)
        if c <= before * (1 + 1e-12):
            break
    raw = F.col("x") * c / F.col("n")
    return rates.select(*keys, F.least(F.lit(1.0), raw).alias("_p"), F.greatest(F.lit(1.0), raw).alias("_w"))


def mix_tempered(docs: DataFrame, margins: Mapping[str, Column], power: float = 0.5, id_col: str = "doc_id", text_col: str = "text", keep: float = 0.5, seed: int = 0) -> DataFrame:
    """docs in the sample, drawn to shares in proportion to a power of each margin value's tokens; null keeps its share."""
    keys = [f"_m{i}" for i in range(len(margins))]
    marked = _marked(docs, [F.coalesce(m.cast("string"), F.lit(OTHER)) for m in margins.values()], n_tokens(F.col(text_col)), id_col, seed)
    cells = materialize(marked.groupBy(*keys).agg(F.sum("_tokens").alias("n")).filter("n > 0"), narrow=True)
    n_cells = cells.count()
    if not n_cells:
        known = cells.select(*keys, F.lit(float(keep)).alias("_p"), F.lit(1.0).alias("_w"))
    elif n_cells <= DRIVER_CELLS:
        known = F.broadcast(_rake_here(cells, keys, power, keep))
    else:
        known = _rake_there(cells, keys, power, keep)
    return _draw(docs, marked, known, keys, keep)


def mix_documents(docs: DataFrame, keep: float = 0.5, seed: int = 0) -> DataFrame:
    """documents drawn to sources, languages and topics in proportion to the roots of their tokens."""
    return mix_tempered(docs, {"source": F.col("source"), "lang": F.col("lang"), "topic": length_class(F.col("text"))}, keep=keep, seed=seed)
