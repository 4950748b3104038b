"""Centres of interest: assignment, learning from feedback, view time, merging and synchronisation.

Interests have user_id, polarity (pos, neg), coi_pos (their order), coi_id, point, view_count, view_time, last_view.
Learning is order-dependent, one fold per user: a grouped map over each user's events.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions.vector import dot, is_finite, l2_distance

# Interests nearer than this merge; the similarity to no interest.
MERGE_DISTANCE = 4.5
NO_COI = -1.0
INTERESTS = "user_id long, polarity string, coi_pos int, coi_id string, point array<double>, view_count long, view_time double, last_view timestamp"


@dataclass(frozen=True)
class Config:
    """Parameters; their defaults are fixed values, their bounds stand in the checks below."""

    shift_factor: float = 0.1
    threshold: float = 0.67
    min_positive: int = 2
    min_negative: int = 2
    horizon_days: float = 30.0
    gamma: float = 0.9
    penalty: tuple[float, ...] = field(default=(1.0, 0.75, 0.66))

    def __post_init__(self) -> None:
        if not 0 <= self.shift_factor <= 1:
            raise ValueError("shift_factor must be within [0, 1]")
        if not -1 <= self.threshold <= 1:
            raise ValueError("threshold must be within [-1, 1]")
        if self.min_positive <= 0 or self.min_negative <= 0:
            raise ValueError("the least numbers of interests must be positive")
        if not 0 <= self.gamma <= 1:
            raise ValueError("gamma must be within [0, 1]")
        if self.horizon_days < 0:
            raise ValueError("the horizon must not be negative")
        if not self.penalty or not np.isfinite(self.penalty).all() or list(self.penalty) != sorted(self.penalty, reverse=True):
            raise ValueError("penalties must be finite and descend")

    @property
    def max_key_phrases(self) -> int:
        return len(self.penalty)


# --- assignment ---------------------------------------------------------------------------------


def interest_lists(interests: DataFrame, *more: str) -> DataFrame:
    """-> user_id, pos, neg: each user's interests as arrays, so that documents meet them by one join on the user."""
    item = F.struct("coi_pos", "coi_id", "point", F.sqrt(dot(F.col("point"), F.col("point"))).alias("norm"), "last_view", *more)
    of = lambda p: F.collect_list(F.when(F.col("polarity") == p, item)).alias(p)
    return interests.groupBy("user_id").agg(of("pos"), of("neg"))


def nearest(cois: Column, embedding: Column, norm: Column, *more: str) -> Column:
    """The most similar interest of an array (ties: the first in order): similarity, coi_id, last_view; null without any."""

    def candidate(c: Column) -> Column:
        s = F.when(c["norm"] * norm == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(embedding, c["point"]) / (c["norm"] * norm))))
        return F.struct(s.alias("similarity"), (-c["coi_pos"]).alias("p"), c["coi_id"].alias("coi_id"), c["last_view"].alias("last_view"), *[c[m].alias(m) for m in more])

    return F.array_max(F.transform(cois, candidate))


def with_nearest(documents: DataFrame, lists: DataFrame, *more: str) -> DataFrame:
    """documents with _pos and _neg, their users' nearest interests of either polarity."""
    rows = documents.join(lists, "user_id", "left").withColumn("_norm", F.sqrt(dot(F.col("embedding"), F.col("embedding"))))
    found = [nearest(F.col(p), F.col("embedding"), F.col("_norm"), *more).alias(f"_{p}") for p in ("pos", "neg")]
    return rows.select(*documents.columns, *found)


#: A user's interests are one array up to so many; more are kept in blocks.
MOST_LISTED = 4_096


def _cosine(a: Column, b: Column, norms: Column) -> Column:
    return F.when(norms == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms)))


def interest_blocks(interests: DataFrame, block: int = 512) -> DataFrame:
    """interests of one polarity -> user_id, b, pivot, radius, items: blocks of at most so many, around some of a user's interests.

    The radius is the largest angle of an item from the pivot; a block with an item of no length, which is as similar to
    everything as can be, reaches everywhere.
    """
    item = F.struct("coi_pos", "coi_id", "point", F.col("_norm").alias("norm"), "last_view")
    own = interests.withColumn("_norm", F.sqrt(dot(F.col("point"), F.col("point"))))
    ordered = own.filter("_norm > 0").withColumn("_n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.xxhash64("coi_id"), "coi_id")))
    sizes = ordered.groupBy("user_id").agg(F.ceil(F.count("*") / block).alias("_k"))
    pivots = ordered.join(sizes, "user_id").filter("_n <= _k").groupBy("user_id").agg(F.collect_list(F.struct(F.col("_n").alias("n"), F.col("point").alias("point"), F.col("_norm").alias("norm"))).alias("_pivots"))
    near = F.array_max(F.transform("_pivots", lambda p: F.struct(_cosine(F.col("point"), p["point"], F.col("_norm") * p["norm"]).alias("s"), p["n"].alias("n"), p["point"].alias("point"))))
    homes = own.join(pivots, "user_id", "left").withColumn("_home", near).drop("_pivots")
    place = F.row_number().over(Window.partitionBy("user_id", "_home.n").orderBy("coi_pos", "coi_id"))
    cells = homes.withColumn("_part", F.floor((place - 1) / block)).withColumn("_angle", F.when(F.col("_norm") > 0, F.acos("_home.s")).otherwise(F.lit(math.pi)))
    blocks = cells.groupBy("user_id", F.coalesce("_home.n", F.lit(0)).alias("n"), "_part").agg(F.first("_home.point").alias("pivot"), F.max("_angle").alias("radius"), F.collect_list(item).alias("items"))
    return blocks.select("user_id", F.struct("n", "_part").alias("b"), F.coalesce("pivot", F.element_at("items", 1)["point"]).alias("pivot"), "radius", "items")


def nearest_in_blocks(documents: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys of documents (which have user_id and embedding) and _best, their users' most similar interest.

    A document first looks through the block whose pivot is nearest, then through those only that can hold a closer one: no
    item of a block is nearer to a document than the pivot's angle less the block's radius.
    """
    heads = blocks.groupBy("user_id").agg(F.collect_list(F.struct("b", "pivot", "radius")).alias("_heads"))
    rows = documents.select(*keys, *[c for c in ("user_id", "embedding") if c not in keys]).withColumn("_norm", F.sqrt(dot(F.col("embedding"), F.col("embedding")))).join(heads, "user_id")

    def bound(h: Column) -> Column:
        angle = F.acos(_cosine(F.col("embedding"), h["pivot"], F.col("_norm") * F.sqrt(dot(h["pivot"], h["pivot"]))))
        most = F.when((F.col("_norm") == 0) | (h["radius"] >= angle), F.lit(1.0)).otherwise(F.cos(angle - h["radius"]))
        return F.struct((-angle).alias("near"), most.alias("most"), h["b"].alias("b"))

    rows = rows.withColumn("_heads", F.transform("_heads", bound)).withColumn("b", F.array_max("_heads")["b"])
    items = blocks.select("user_id", "b", "items")
    best = lambda frame: frame.join(items, ["user_id", "b"]).withColumn("_best", nearest(F.col("items"), F.col("embedding"), F.col("_norm"))).drop("items")
    first = best(rows)
    able = F.filter("_heads", lambda h: (h["b"] != F.col("b")) & (h["most"] >= F.col("_best.similarity") - 1e-9))
    more = best(first.withColumn("b", F.explode(F.transform(able, lambda h: h["b"]))).drop("_best"))
    both = first.select(*keys, "_best").unionByName(more.select(*keys, "_best"))
    return both.groupBy(*keys).agg(F.max("_best").alias("_best"))


def with_nearest_of_many(documents: DataFrame, interests: DataFrame, keys: list[str], most_listed: int = MOST_LISTED, block: int = 512) -> DataFrame:
    """As with_nearest; users with more than most_listed interests keep them in blocks, all others in arrays."""
    sizes = interests.groupBy("user_id").agg(F.count("*").alias("_n"))
    many = sizes.filter(F.col("_n") > most_listed).select("user_id")
    out = with_nearest(documents, interest_lists(interests.join(many, "user_id", "left_anti")))
    for p in ("pos", "neg"):
        own = interests.filter(F.col("polarity") == p).join(many, "user_id", "left_semi")
        found = nearest_in_blocks(documents.join(many, "user_id", "left_semi"), interest_blocks(own, block), keys)
        out = out.join(found, keys, "left").withColumn(f"_{p}", F.coalesce(f"_{p}", "_best")).drop("_best")
    return out


def assign(documents: DataFrame, interests: DataFrame) -> DataFrame:
    """documents with coi_id, pos_similarity, neg_similarity; null coi_id where a user has no positive interest."""
    return with_nearest(documents, interest_lists(interests)).select(
        *documents.columns, F.col("_pos.coi_id").alias("coi_id"), F.col("_pos.similarity").alias("pos_similarity"), F.coalesce("_neg.similarity", F.lit(NO_COI)).alias("neg_similarity")
    )


def has_enough(interests: DataFrame, config: Config) -> DataFrame:
    """-> user_id, enough."""
    n = lambda p: F.sum((F.col("polarity") == p).cast("int"))
    return interests.groupBy("user_id").agg(((n("pos") >= config.min_positive) & (n("neg") >= config.min_negative)).alias("enough"))


# --- the fold -----------------------------------------------------------------------------------


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    norm = np.linalg.norm(a) * np.linalg.norm(b)
    return 1.0 if norm == 0 else float(np.clip(a @ b / norm, -1, 1))


@dataclass
class Coi:
    id: str
    point: np.ndarray
    count: int = 1
    time: float = 0.0
    last_view: pd.Timestamp | None = None


def closest_of(cois: list[Coi], point: np.ndarray) -> tuple[int, float] | None:
    if not cois:
        return None
    s = [similarity(c.point, point) for c in cois]
    k = int(np.argmax(s))
    return k, s[k]


def react(cois: list[Coi], user_id: object, event_id: object, point: np.ndarray, at: pd.Timestamp, config: Config) -> Coi:
    """Shift the closest interest towards the point if it is near enough, else found a new one there."""
    found = closest_of(cois, point)
    if found and found[1] >= config.threshold:
        coi = cois[found[0]]
        coi.point = coi.point * (1 - config.shift_factor) + point * config.shift_factor
        coi.count += 1
        coi.last_view = at
        return coi
    cois.append(Coi(str(uuid.uuid5(uuid.NAMESPACE_OID, f"{user_id}/{event_id}")), point.copy(), last_view=at))
    return cois[-1]


def view(cois: list[Coi], point: np.ndarray, seconds: float) -> None:
    """Viewing time goes to the closest interest, however far; its last view stays."""
    found = closest_of(cois, point)
    if found:
        cois[found[0]].time += seconds


def fold(user_id: object, events: pd.DataFrame, pos: list[Coi], neg: list[Coi], config: Config) -> None:
    """events in order: event_id, kind (like, dislike, view), embedding, seconds, at."""
    for e in events.itertuples(index=False):
        point = np.asarray(e.embedding, float)
        if not np.isfinite(point).all():
            raise ValueError("vector is not finite")
        if e.kind == "like":
            react(pos, user_id, e.event_id, point, e.at, config)
        elif e.kind == "dislike":
            react(neg, user_id, e.event_id, point, e.at, config)
        elif e.kind == "view":
            view(pos, point, float(e.seconds or 0))


def to_rows(user_id: object, pos: list[Coi], neg: list[Coi]) -> pd.DataFrame:
    rows = [(user_id, p, k, c.id, c.point, c.count, c.time, c.last_view) for p, cois in (("pos", pos), ("neg", neg)) for k, c in enumerate(cois)]
    return pd.DataFrame(rows, columns=["user_id", "polarity", "coi_pos", "coi_id", "point", "view_count", "view_time", "last_view"])


def from_rows(rows: pd.DataFrame, polarity: str) -> list[Coi]:
    own = rows[rows["polarity"] == polarity].sort_values("coi_pos")
    return [Coi(r.coi_id, np.asarray(r.point, float), int(r.view_count), float(r.view_time), r.last_view) for r in own.itertuples(index=False)]


def learn(interests: DataFrame, events: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """The interests after the events (user_id, seq, event_id, kind, embedding, seconds, at), taken in order of seq.

    Ids of new interests follow from user and event, so that a task that runs again gives the same rows.
    """

    def of_user(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        pos, neg = from_rows(old, "pos"), from_rows(old, "neg")
        fold(key[0], new.sort_values("seq"), pos, neg, config)
        return to_rows(key[0], pos, neg)

    return interests.groupBy("user_id").cogroup(events.groupBy("user_id")).applyInPandas(of_user, INTERESTS)


def feedback_events(matched: DataFrame, keys: list[str]) -> DataFrame:
    """Matching documents as events: all positive ones first, each polarity in document order."""
    from .history import is_negative

    negative = is_negative()
    return matched.select(
        "user_id", F.struct(negative.cast("int").alias("n"), F.col("doc_pos").alias("p")).alias("seq"), F.concat_ws("/", *keys).alias("event_id"),
        F.when(negative, "dislike").otherwise("like").alias("kind"), "embedding", F.lit(0.0).alias("seconds"), "at",
    ).withColumn("seq", F.col("seq.n").cast("long") * F.lit(1 << 40) + F.col("seq.p"))


# --- merging ------------------------------------------------------------------------------------


def merge_closest(cois: list[Coi]) -> list[Coi]:
    """Merge the closest pair below MERGE_DISTANCE (ties by ids) until none is left; a merged one has the smaller id.

    Pairs wait in a heap under the numbers of their interests; a merged interest gets a new number, so that pairs of what
    is gone are known when they come up.
    """
    there = dict(enumerate(cois))
    waiting: list[tuple[float, str, str, int, int]] = []

    def meet(k: int, others: list[int]) -> None:
        if others:
            gaps = np.linalg.norm(np.stack([there[i].point for i in others]) - there[k].point, axis=1)
            for at in np.flatnonzero(gaps < MERGE_DISTANCE):
                low, high = sorted((there[k], there[others[at]]), key=lambda c: c.id)
                if low.id != high.id:
                    heapq.heappush(waiting, (float(gaps[at]), low.id, high.id, k, others[at]))

    for k in list(there):
        meet(k, list(range(k)))
    fresh = len(cois)
    while waiting:
        _, low, _, i, j = heapq.heappop(waiting)
        if i in there and j in there:
            pair = there.pop(i), there.pop(j)
            seen = [c.last_view for c in pair if c.last_view is not None]
            there[fresh] = Coi(low, (pair[0].point + pair[1].point) / 2, sum(c.count for c in pair), sum(c.time for c in pair), max(seen, default=None))
            meet(fresh, [k for k in there if k != fresh])
            fresh += 1
    return list(there.values())


def merge(interests: DataFrame) -> DataFrame:
    """Closest interests merged, user by user; only users who have a close pair are folded, the others stay."""
    from ..sources.scratch import materialize

    def of_user(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return to_rows(key[0], merge_closest(from_rows(rows, "pos")), merge_closest(from_rows(rows, "neg")))

    names = [c.split(" ")[0] for c in INTERESTS.split(", ")]
    rows = interests.select(*names)
    able = materialize(close_pairs(rows).select("user_id").distinct())
    merged = rows.join(able, "user_id", "left_semi").groupBy("user_id").applyInPandas(of_user, INTERESTS)
    place = F.row_number().over(Window.partitionBy("user_id", "polarity").orderBy("coi_pos")) - 1
    return merged.unionByName(rows.join(able, "user_id", "left_anti").withColumn("coi_pos", place.cast("int")).select(*names))


def append_remote(local: DataFrame, remote: DataFrame) -> DataFrame:
    """All local interests, then the remote ones whose id isn't there, in their order."""
    new = remote.join(local.select("user_id", "polarity", "coi_id"), ["user_id", "polarity", "coi_id"], "left_anti")
    n = local.groupBy("user_id", "polarity").agg((F.max("coi_pos") + 1).alias("_n"))
    moved = new.join(n, ["user_id", "polarity"], "left").withColumn("coi_pos", (F.col("coi_pos") + F.coalesce("_n", F.lit(0))).cast("int")).select(*local.columns)
    return local.unionByName(moved)


def synchronize(local: DataFrame, remote: DataFrame) -> DataFrame:
    return merge(append_remote(local, remote))


#: So many doubles of points are a group of close pairs at least, of one user and polarity; two groups meet in one call.
GROUP_VALUES = 1 << 19
#: Interests of a tile, of which two are compared at once; doubles of the pairs whose distances are worked out at once.
TILE, EXACT_VALUES = 1_024, 1 << 20


def _tiles(cells: np.ndarray, points: np.ndarray) -> list[tuple[int, int, np.ndarray, float]]:
    """start, stop, centre and radius of runs of the same cell, at most TILE long."""
    cuts = np.flatnonzero(np.diff(cells)) + 1
    found = []
    for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)], strict=True):
        for a in range(start, stop, TILE):
            own = points[a : min(a + TILE, stop)]
            centre = own.mean(axis=0)
            found.append((a, a + len(own), centre, float(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))))
    return found


def _close(a: np.ndarray, b: np.ndarray, below: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and distances of the pairs of two tiles that are nearer than below; same: of one tile, each pair once.

    A product of matrices finds them with room for its rounding; their distances are then summed up dimension by dimension.
    """
    norms = (a * a).sum(axis=1), (b * b).sum(axis=1)
    far = norms[0][:, None] + norms[1] - 2 * (a @ b.T) > below * below + 1e-12 * (a.shape[1] + 1) * (norms[0].max() + norms[1].max() + below * below)
    i, j = np.nonzero(np.triu(~far, 1) if same else ~far)
    step = max(1, EXACT_VALUES // max(1, a.shape[1]))
    for k in range(0, len(i), step):
        x, y = i[k : k + step], j[k : k + step]
        d = np.zeros(len(x))
        for c in range(a.shape[1]):
            d += (a[x, c] - b[y, c]) ** 2
        d = np.sqrt(d)
        near = d < below
        yield x[near], y[near], d[near]


def _close_in_groups(below: float, schema: pa.Schema) -> Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def compare(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, polarity, dim, group, met = (k.as_py() for k in key)
        rows = pa.Table.from_batches(list(batches))
        rows = rows.take(pc.sort_indices(rows, [("side", "ascending"), ("cell", "ascending")])).combine_chunks()
        ids, side, cells = rows["coi_id"].combine_chunks(), rows["side"].to_numpy(), rows["cell"].to_numpy()
        points = rows["point"].combine_chunks().flatten().to_numpy().reshape(len(ids), dim)
        first = int(np.searchsorted(side, 1))
        here = _tiles(cells[:first], points[:first])
        alone = group == met
        there = here if alone else [(x + first, y + first, *more) for x, y, *more in _tiles(cells[first:], points[first:])]
        with np.errstate(over="ignore", invalid="ignore"):
            for n, (a, a1, centre, radius) in enumerate(here):
                for b, b1, other, reach in there[n:] if alone else there:
                    # two balls with nothing between them closer than below; what isn't a number is compared
                    if np.linalg.norm(centre - other) - radius - reach > below + 1e-9 * (below + radius + reach + np.abs(centre).max(initial=0) + np.abs(other).max(initial=0)):
                        continue
                    for x, y, d in _close(points[a:a1], points[b:b1], below, a == b):
                        if len(d):
                            yield pa.record_batch([pa.array([user] * len(d), schema.field(0).type), pa.array([polarity] * len(d), schema.field(1).type), ids.take(pa.array(x + a)), ids.take(pa.array(y + b)), pa.array(d)], schema=schema)

    return compare


def _pairs_of_few(rows: DataFrame, below: float) -> DataFrame:
    """Pairs of users with no more interests than one pivot has: all of them are compared."""
    one, two = (rows.select("user_id", "polarity", "dim", F.col("coi_id").alias(i), F.col("point").alias(p)) for i, p in (("a", "pa"), ("b", "pb")))
    met = one.join(two, ["user_id", "polarity", "dim"]).filter("a < b").withColumn("distance", l2_distance(F.col("pa"), F.col("pb")))
    return met.filter(F.col("distance") < below).select("user_id", "polarity", "a", "b", "distance")


def close_pairs(interests: DataFrame, below: float = MERGE_DISTANCE, most_pivots: int = 32, every: int = 64) -> DataFrame:
    """-> user_id, polarity, id0 < id1, distance of interests nearer to each other than ``below``.

    The interests of a user and polarity are dealt to pivots, some of them by a hash: one for each ``every``, at most
    most_pivots. Those at home with one pivot are a cell, or several by their distance from it. Two cells can hold a pair
    only if for every pivot their ranges of distances are nearer to each other than below. Neighbouring cells are a group
    of bounded size; interests are sent to the pairs of groups where a cell can meet one, and compared there by products of
    matrices, tile by tile. Points that aren't finite are near nothing.
    """
    from ..sources.scratch import materialize

    key = ["user_id", "polarity", "dim"]
    fine = F.coalesce(is_finite(F.col("point")), F.lit(False)) & F.col("user_id").isNotNull() & F.col("polarity").isNotNull() & F.col("coi_id").isNotNull()
    few = interests.filter(fine).select("user_id", "polarity", F.size("point").alias("dim"), "coi_id", F.transform("point", lambda x: x.cast("double")).alias("point"))
    sizes = few.groupBy(*key).agg(F.least(F.lit(most_pivots), F.ceil(F.count("*") / every)).cast("int").alias("k"))
    # the bound by a number is passed on to the tasks before the shuffle
    placed = few.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("coi_id"), "coi_id"))).filter(F.col("n") <= most_pivots)
    pivots = placed.join(sizes.filter("k > 1"), key).filter("n <= k").groupBy(*key).agg(F.collect_list("point").alias("pivots"))
    # left joins, so that Spark broadcasts the small tables or none, and never the interests
    rows = materialize(few.join(pivots, key, "left").withColumn("gaps", F.transform("pivots", lambda p: l2_distance(F.col("point"), p))).drop("pivots"))

    many = rows.filter("gaps is not null").withColumn("home", F.array_position("gaps", F.array_min("gaps")).cast("int")).withColumn("gap", F.array_min("gaps"))
    room = F.greatest(F.lit(1), F.floor(F.lit(GROUP_VALUES) / F.greatest("dim", F.lit(1))))
    homes = many.groupBy(*key, "home").agg(F.ceil(F.count("*") / room).alias("slices"), F.min("gap").alias("low"), F.max("gap").alias("high"))
    width = F.greatest(F.lit(below), (F.col("high") - F.col("low")) / F.col("slices"))
    cut = many.join(homes, [*key, "home"], "left").withColumn("slice", F.least(F.col("slices") - 1, F.floor((F.col("gap") - F.col("low")) / width))).drop("slices", "low", "high", "gap")
    ends = [f(F.get("gaps", F.lit(i))).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(most_pivots)]
    slices = cut.groupBy(*key, "home", "slice").agg(F.count("*").alias("n"), *ends)
    ranges = F.array(*[F.struct(F.col(f"low{i}").alias("low"), F.col(f"high{i}").alias("high")) for i in range(most_pivots)])
    slices = slices.select(*key, "home", "slice", "n", F.ceil(F.col("n") / room).alias("parts"), ranges.alias("ranges"))
    # a slice that is too large, as copies are in one place, is dealt out by a hash
    cells = slices.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    along = Window.partitionBy(*key).orderBy(F.col("ranges")[0]["low"], "home", "slice", "part")
    before = F.coalesce(F.sum(F.col("n") / F.col("parts")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    cells = materialize(cells.select(*key, "home", "slice", "part", "parts", "ranges", F.row_number().over(along).alias("cell"), F.floor(before / room).alias("grp")))

    one, two = (cells.select(*key, F.struct("home", "slice", "part").alias(f"at{s}"), F.col("cell").alias(f"cell{s}"), F.col("grp").alias(f"g{s}"), F.col("ranges").alias(f"r{s}")) for s in (0, 1))

    def ruled_out(x: Column, y: Column) -> Column:
        gap, high = F.greatest(x["low"], y["low"]) - F.least(x["high"], y["high"]), F.greatest(x["high"], y["high"])
        return F.coalesce(~F.isnan(gap) & (gap > below + 1e-9 * (below + high)), F.lit(False))

    apart = F.exists(F.zip_with("r0", "r1", ruled_out), lambda x: x)
    able = one.join(two, key).filter((F.col("cell0") <= F.col("cell1")) & ~apart)
    ends = F.array(*[F.struct(F.col(f"at{s}").alias("at"), F.col(f"cell{s}").alias("cell"), F.when(F.col("g0") == F.col("g1"), 0).otherwise(s).alias("side")) for s in (0, 1)])
    sent = able.select(*key, F.col("g0").alias("i"), F.col("g1").alias("j"), F.explode(ends).alias("e")).select(*key, "i", "j", "e.at.*", "e.cell", "e.side").distinct()

    dealt = cut.join(slices.select(*key, "home", "slice", "parts"), [*key, "home", "slice"], "left").withColumn("part", F.pmod(F.xxhash64("coi_id"), "parts"))
    met = dealt.select(*key, "home", "slice", "part", "coi_id", "point").join(sent, [*key, "home", "slice", "part"], "left")
    pair = [*key, "i", "j"]
    kinds = rows.schema
    schema = T.StructType([kinds["user_id"], kinds["polarity"], *[T.StructField(c, kinds["coi_id"].dataType) for c in "ab"], T.StructField("distance", T.DoubleType())])
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = met.select(*pair, "side", "cell", "coi_id", "point").repartition(n, *pair).groupBy(*pair).applyInArrow(_close_in_groups(below, to_arrow_schema(schema)), schema)
    pairs = _pairs_of_few(rows.filter("gaps is null"), below).unionByName(found).filter("a != b")
    return pairs.select("user_id", "polarity", F.least("a", "b").alias("id0"), F.greatest("a", "b").alias("id1"), "distance")
