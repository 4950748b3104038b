"""I-Match document fingerprints, with DataFrame functions only.

A document's terms are the distinct lower-cased words of its text. Over all documents every term's document frequency is
counted (by its 64-bit hash); the lexicon holds the terms of a band of inverse document frequencies. The lexicon is dealt
at random into subsets: tier t keeps one term in 4**t and deals those into 32 subsets. A fingerprint is, subset by subset,
the hash of the document's sorted terms in it, so that the sparse tiers, whose subsets hold about a term of the document
each, survive edits in the proportion of what is shared, and the dense ones only small edits. A text without any lexicon
term gets the digest of the text.

A term of the band is in a share of exp(-idf[1]) of the documents at least, so that the lexicon has at most exp(idf[1])
terms for each distinct term that a document has on average, whatever the number of documents. Terms meet it by a join,
which broadcasts up to BROADCAST_TERMS of them and shuffles beyond.

Cases: null and empty texts have the fingerprint of the empty text; equal texts have equal fingerprints, however long;
rows with a null id are left out; repeated ids are taken in the order of their texts, repeated rows after one another; a
lone document is its own successor; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

SUBSETS = 32
TIERS = 4
RANGES = 256
BUCKET_ROWS = 200
MOST_PARTS = 4_000
BROADCAST_TERMS = 2_000_000
_FOLD = "struct<subset:int,hash:bigint,done:array<int>>"


def terms(text: Column) -> Column:
    """64-bit hashes of the distinct words."""
    words = F.split(F.lower(text), r"[\s\p{Punct}]+")
    return F.array_remove(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def lexicon(docs: DataFrame, text_col: str, idf: tuple[float, float]) -> DataFrame:
    """-> term: those whose inverse document frequency is in the band."""
    n = docs.count()
    counts = docs.select(F.explode(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("term")).groupBy("term").count()
    return materialize(counts.filter(F.col("count").between(n * math.exp(-idf[1]), n * math.exp(-idf[0]))).select("term"))


def _subset(x: Column) -> Column:
    return F.shiftrightunsigned(x, 59).cast("int")


def _entry(acc: Column) -> Column:
    """The subset and 12 bits of the hash of its terms, in one number."""
    return acc["subset"] * 4096 + (F.pmod(acc["hash"], F.lit(4095)) + 1).cast("int")


def _digests(numbers: Column) -> Column:
    """An entry for each subset that has terms: one pass over the terms' numbers, sorted by subset."""

    def add(acc: Column, x: Column) -> Column:
        same = acc["subset"] == _subset(x)
        done = F.when(same | (acc["subset"] < 0), acc["done"]).otherwise(F.concat(acc["done"], F.array(_entry(acc))))
        return F.struct(_subset(x).alias("subset"), F.xxhash64(F.when(same, acc["hash"]).otherwise(F.lit(0).cast("long")), x).alias("hash"), done.alias("done")).cast(_FOLD)

    zero = F.struct(F.lit(-1).alias("subset"), F.lit(0).cast("long").alias("hash"), F.array().cast("array<int>").alias("done")).cast(_FOLD)
    return F.aggregate(F.sort_array(numbers), zero, add, lambda acc: F.when(acc["subset"] < 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(_entry(acc)))))


def with_slots(rows: DataFrame, numbers: str, name: str) -> DataFrame:
    """A column with the entries of each tier, from one with the numbers of the text's lexicon terms.

    A number has its subset in the top 5 bits and its level in the bits below.
    """
    out = rows.withColumn("_tier0", F.col(numbers))
    for t in range(1, TIERS):
        out = out.withColumn(f"_tier{t}", F.filter(f"_tier{t - 1}", lambda x: F.shiftright(x, 59 - 2 * t).bitwiseAND(F.lit(4**t - 1)) == 0))
    return out.withColumn(name, F.array(*[_digests(F.col(f"_tier{t}")) for t in range(TIERS)])).drop(*[f"_tier{t}" for t in range(TIERS)])


def as_string(slots: Column, digest: Column) -> Column:
    none = F.size(slots[0]) == 0
    return F.when(none, F.concat(F.lit("t:"), digest)).otherwise(F.array_join(F.transform(slots, lambda tier: F.array_join(F.transform(tier, lambda x: F.lower(F.lpad(F.hex(x), 5, "0"))), "")), "/"))


def with_likeness(rows: DataFrame, a: str, b: str, same: Column, name: str) -> DataFrame:
    """Equal share of the subsets that either has terms in, over the sparse tiers (all of them if none is sparse)."""
    subset = lambda x: F.shiftright(x, 12)
    tiers = [F.struct(F.size(F.array_union(F.transform(F.col(a)[t], subset), F.transform(F.col(b)[t], subset))).alias("n"), F.size(F.array_intersect(F.col(a)[t], F.col(b)[t])).alias("e")) for t in range(TIERS)]
    total = lambda f, most: F.aggregate("_tiers", F.lit(0), lambda acc, r: acc + F.when(r["n"] <= most, r[f]).otherwise(0))
    ratio = lambda most: F.when(total("n", most) > 0, total("e", most) / total("n", most))
    return rows.withColumn("_tiers", F.array(*tiers)).withColumn(name, F.when(same, F.lit(1.0)).otherwise(F.coalesce(ratio(2 * SUBSETS // 3), ratio(SUBSETS), F.lit(0.0)))).drop("_tiers")


def _numbered(rows: DataFrame, keys: list[str], texts: list[str], known: DataFrame, own: list[Column]) -> DataFrame:
    """One row for each of the rows, by keys: own, and the numbers of each text's lexicon terms, n0, n1 and so on."""
    if known.count() <= BROADCAST_TERMS:
        known = F.broadcast(known)
    each = rows.select(*keys, *own, F.posexplode(F.array(*[terms(F.col(t)) for t in texts])).alias("_which", "_terms"))
    kept = [c for c in each.columns if c not in ("_which", "_terms", *keys)]
    each = each.select(*[c for c in each.columns if c != "_terms"], F.posexplode_outer("_terms").alias("_at", "term"))
    met = each.join(known.withColumn("_known", F.lit(True)), "term", "left").withColumn("_x", F.when(F.col("_known"), F.xxhash64("term", F.lit(7))))
    # one row of each takes along what is its own; the others stay if their term is known
    lead = (F.col("_which") == 0) & (F.coalesce("_at", F.lit(0)) == 0)
    slim = met.filter(lead | F.col("_x").isNotNull()).select(*keys, "_which", "_x", *[F.when(lead, F.col(c)).alias(c) for c in kept])
    numbers = [F.collect_list(F.when(F.col("_which") == k, F.col("_x"))).alias(f"n{k}") for k in range(len(texts))]
    return slim.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in kept], *numbers)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", idf: tuple[float, float] = (1.6, 6.2)) -> DataFrame:
    """-> id, slots, fingerprint of each distinct (id, text): the general interface."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("id is not null")
    own = _numbered(rows.withColumn("digest", F.sha2("text", 256)), ["id", "digest"], ["text"], lexicon(rows, "text", idf), [])
    return with_slots(own, "n0", "slots").select(F.col("id").alias(id_col), "slots", as_string(F.col("slots"), F.col("digest")).alias("fingerprint"))


def _longs(values: list[int]) -> Column:
    """A constant array."""
    return F.split(F.lit(",".join(map(str, values)) or "0"), ",").cast("array<bigint>")


def _bucket(id_: Column, bounds: list[int], parts: int) -> Column:
    """A number that never falls as the id grows: the quantile range of the id, cut into parts of equal width."""
    starts = _longs(bounds)
    k = F.size(F.filter(starts, lambda b: b <= id_)) - 1
    lo, hi = F.element_at(starts, k + 1).cast("double"), F.element_at(starts, F.least(k + 2, F.lit(len(bounds)))).cast("double")
    part = F.when(hi > lo, F.floor((id_.cast("double") - lo) / F.when(hi > lo, hi - lo) * parts)).otherwise(0)
    return k.cast("long") * parts + F.least(F.greatest(part.cast("long"), F.lit(0).cast("long")), F.lit(parts - 1).cast("long"))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """-> bucket, k, id, text, after: the text of the next row by id (ties by text), after the last the first's.

    Rows are dealt into ranges of ids, between RANGES quantiles and finer where there are more rows; each range's first
    row is also sent to the range before it (there without a text after), so that no task sees more than ranges and their
    successors. Of rows with one key k goes by id and text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("id is not null")
    stats = rows.agg(F.percentile_approx("id", [i / RANGES for i in range(RANGES)] + [1.0], 100_000).alias("q"), F.min("id").alias("lo"), F.count("*").alias("n")).first()
    bounds = sorted({stats["lo"] or 0, *(stats["q"] or [])})
    parts = max(1, min(MOST_PARTS, stats["n"] // (RANGES * BUCKET_ROWS)))
    rows = rows.withColumn("bucket", _bucket(F.col("id"), bounds, parts))
    # at most (RANGES + 2) * MOST_PARTS buckets; the one before each follows within its quantile range, or from the ranges' ends
    firsts = materialize(rows.groupBy("bucket").agg(F.min("id").alias("id")).withColumn("range", F.floor(F.col("bucket") / parts)), narrow=True)
    ends = [r["last"] for r in firsts.groupBy("range").agg(F.max("bucket").alias("last")).orderBy("range").collect()]  # at most RANGES + 2
    at = F.size(F.filter(_longs([e // parts for e in ends]), lambda r: r <= F.col("range")))
    before = F.coalesce(F.lag("bucket").over(Window.partitionBy("range").orderBy("bucket")), F.element_at(_longs(ends[-1:] + ends[:-1]), at))
    back = firsts.select("id", before.alias("bucket"))
    sent = rows.drop("bucket").join(F.broadcast(back), "id")
    both = rows.withColumn("tail", F.lit(0)).unionByName(sent.withColumn("tail", F.lit(1))).repartition("bucket")
    order = Window.partitionBy("bucket").orderBy("tail", "id", "text")
    return both.select("bucket", F.row_number().over(order).alias("k"), "id", "text", F.when(F.col("tail") == 0, F.lead("text").over(order)).alias("after"))


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", idf: tuple[float, float] = (1.6, 6.2)) -> DataFrame:
    """-> id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half replaced by the beginning of the next document.
    """
    known = lexicon(docs.filter(F.col(id_col).isNotNull()), text_col, idf)
    n, text, after = F.length("text"), F.col("text"), F.col("after")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), n - half), F.substring(after, F.lit(1), half))
    # a bucket's last row is another's first: it has no text after, and lends its numbers only
    rows = with_next(docs, id_col, text_col).withColumn("edited", edited)
    own = ["id", n.cast("long").alias("n_chars"), F.sha2("text", 256).alias("digest"), F.sha2("edited", 256).alias("edited_sha256"), (text == after).alias("as_next")]
    full = _numbered(rows, ["bucket", "k"], ["text", "edited"], known, own)
    full = with_slots(with_slots(full, "n0", "slots"), "n1", "edited_slots").drop("n0", "n1")
    full = full.withColumn("next_slots", F.lead("slots").over(Window.partitionBy("bucket").orderBy("k"))).filter("edited_sha256 is not null")
    full = with_likeness(full, "slots", "edited_slots", F.col("digest") == F.col("edited_sha256"), "near_edited")
    full = with_likeness(full, "slots", "next_slots", F.col("as_next"), "near_next")
    return full.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", as_string(F.col("slots"), F.col("digest")).alias("fingerprint"),
        as_string(F.col("edited_slots"), F.col("edited_sha256")).alias("edited_fingerprint"), "near_edited", "near_next",
    )
