"""Vector, probability and time expressions on columns, computed in double precision inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rounding unit of single precision, which several formulas add to their denominators; a day.
EPSILON32 = 1.1920928955078125e-07
SECONDS_PER_DAY = 86400.0


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _double(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def is_finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def l2_norm(a: Column) -> Column:
    """Euclidean length; a vector that isn't finite is an error."""
    return F.when(is_finite(a), F.sqrt(dot(a, a))).otherwise(F.raise_error(F.lit("vector is not finite")).cast("double"))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle, within [-1, 1]; 1 if either vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms)))


def midpoint(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x.cast("double") + y.cast("double")) / 2)


def shift(point: Column, towards: Column, factor: float) -> Column:
    return F.zip_with(point, towards, lambda p, t: p.cast("double") * (1 - factor) + t.cast("double") * factor)


def softmax(a: Column) -> Column:
    high = F.array_max(_double(a))
    e = F.transform(a, lambda x: F.exp(x.cast("double") - high))
    # the sum is bound once, as the only element of an array
    return F.element_at(F.transform(F.array(_sum(e)), lambda total: F.transform(e, lambda x: x / total)), 1)


def kl_divergence(good: Column, other: Column) -> Column:
    """Of one distribution from another, both clamped to [epsilon, 1]."""
    clamp = lambda x: F.greatest(F.lit(EPSILON32), F.least(F.lit(1.0), x.cast("double")))
    return _sum(F.zip_with(good, other, lambda x, y: clamp(x) * F.ln(clamp(x) / clamp(y))))


def target_distribution(relevances: Column) -> Column:
    """Softmax of (n - i - 1) / n + relevance over a ranked list; null if no entry is relevant."""
    n = F.size(relevances)
    scores = F.transform(relevances, lambda r, i: (n - i - 1) / n.cast("double") + r.cast("double"))
    return F.when(F.exists(relevances, lambda r: r > 0), softmax(scores))


def decay(horizon_days: float, as_of: Column, last_view: Column) -> Column:
    """Decay of an interest since it was last seen: 1 just now, 0 from the horizon on; a time to come counts as now."""
    horizon = F.exp(F.lit(-0.1 * horizon_days))
    seconds = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(last_view.cast("timestamp"))) / 1e6
    days = F.exp(F.greatest(seconds, F.lit(0.0)) * (-0.1 / SECONDS_PER_DAY))
    return F.greatest(F.lit(0.0), (horizon - days) / (horizon - 1 - EPSILON32))


def nan_lowest_desc(x: Column) -> list[Column]:
    """Sort keys: descending, NaN (and null) last."""
    return [F.coalesce(F.isnan(x), F.lit(True)).asc(), x.desc()]


def nan_highest(x: Column) -> list[Column]:
    """Sort keys: ascending, NaN (and null) last, as the highest."""
    return [(F.isnan(x) | x.isNull()).asc(), x.asc()]


def finite(x: Column, what: str = "relevance") -> Column:
    """The number, which must be finite; anything else is an error."""
    x = x.cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x).otherwise(F.raise_error(F.lit(f"{what} is not finite")).cast("double"))


def whole_days(seconds: Column) -> Column:
    """A duration as it is stored: its whole days, the rest is cut off."""
    return F.floor(seconds / SECONDS_PER_DAY).cast("long")


def seconds_of_days(days: Column) -> Column:
    return days.cast("long") * int(SECONDS_PER_DAY)


def approx_equal(a: Column, b: Column, epsilon: float = 0.0, ulps: int = 2) -> Column:
    """Vectors of single precision that agree: each entry within epsilon or so many roundings, or both NaN."""

    def one(x: Column, y: Column) -> Column:
        gap, size = F.abs(x.cast("double") - y.cast("double")), F.greatest(F.abs(x.cast("double")), F.abs(y.cast("double")))
        # the distance of neighbours in single precision: 2 ** (exponent - 23), from 2 ** -149 on
        ulp = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(size, F.lit(1e-300)))) - 23, F.lit(-149)).cast("double"))
        return (F.isnan(x) & F.isnan(y)) | F.coalesce(x == y, F.lit(False)) | F.coalesce((gap <= epsilon) | (gap <= ulps * ulp), F.lit(False))

    return (F.size(a) == F.size(b)) & F.forall(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: one(z["x"], z["y"]))


def clean_key_phrase(text: Column) -> Column:
    """Symbols and punctuation become a space, runs of separators one space; trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\p{S}\p{P}]+\p{Z}*", " "), r"\p{Z}+", " "))
