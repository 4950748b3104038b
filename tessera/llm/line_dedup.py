"""Removal of repeated runs of lines, by a suffix array over the line ids of all documents.

The array is made by distributed prefix doubling. A suffix is a place (id, line number); its rank at depth 1 is that of
its line's id, a 128-bit hash, among all ids in order. A suffix's rank at depth 2d is that of the pair of its own rank and
the rank of the suffix d lines on, which a join brings next to it; each round sorts the distinct pairs by ranges, which
puts the suffixes in their order by the first 2d lines. Suffixes whose pair occurs once are in their final place and leave:
no run of theirs that is longer can be repeated. The doubling stops at ``min_lines`` (the last step may overlap).

The suffixes that are left with equal ranks are the intervals whose longest common prefix is min_lines at least. All but
the earliest of an interval (smaller id, or earlier in the document) are repeats. A longer repeated run is the union of
its runs of min_lines lines, so that the union of a document's repeats is its maximal removed runs. Where ``long_words``
is given, a line of more words than that counts at depth 1 too.

Only distinct pairs are sorted. A line that a large share of the places have is counted before it is shuffled, and its
places get their rank from several copies of it.

Cases: a null id leaves the row out; null text is left as it is, empty text has one empty line; repeated rows (same id
and text) are one place, so that they don't remove each other; rows with the same id and different texts are documents
one after another, in the order of their texts' hashes; lines are what stands between line feeds, compared whole, however
long; other columns are kept, but input columns n_lines, n_removed and n_runs give way to those of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import VERSION, bound_batches, join_keys, materialize, partitions, tidy, with_versions

_SPACE = "[ \\t\\n\\x0B\\f\\r]+"


def _lines(texts: DataFrame, long_words: int | None) -> DataFrame:
    """-> id, pos, a, b (the line's id), long: whether the line has more than long_words words."""
    each = texts.filter("text is not null").select("id", "base", F.posexplode(F.split("text", "\n", -1)).alias("k", "line"))
    line = F.col("line")
    words = F.size(F.filter(F.split(line, _SPACE), lambda w: w != ""))
    long_ = F.lit(False) if long_words is None else F.when(F.length(line) > 2 * long_words, words > long_words).otherwise(False)
    return each.select("id", (F.col("base") + F.col("k")).alias("pos"), F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"), long_.alias("long"))


def _ranked(keys: DataFrame, on: list[str]) -> DataFrame:
    """Distinct keys with their numbers in order: sorted by ranges, counted on within each."""
    return materialize(keys.repartitionByRange(partitions(keys.sparkSession), *on).sortWithinPartitions(*on).withColumn("rank", F.monotonically_increasing_id()), narrow=True)


def _tied(rows: DataFrame, on: list[str], *more: Column) -> DataFrame:
    """rows (id, pos, keys) whose keys occur several times, with n and their ranks."""
    keys = _ranked(rows.groupBy(*on).agg(F.count("*").alias("n"), *more).filter("n > 1"), on)
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return join_keys(rows, keys, on, F.xxhash64("id", "pos"), total)


def _first() -> Column:
    return F.min(F.struct("id", "pos")).alias("first")


def _doubled(tied: DataFrame, step: int) -> DataFrame:
    """(id, pos, r1, r2) of the suffixes that have another tied one step lines on."""
    on = tied.select("id", (F.col("pos") - step).alias("pos"), F.col("rank").alias("r2"))
    return tied.select("id", "pos", F.col("rank").alias("r1")).join(on, ["id", "pos"])


def late_places(texts: DataFrame, min_lines: int, long_words: int | None = None) -> DataFrame:
    """texts (id, text) -> id, pos, size: runs of size lines that occur before."""
    texts, repeats = with_versions(texts)
    rows = _lines(texts, long_words)
    late = F.struct("id", "pos") != F.col("first")
    places = lambda tied, size: tied.filter(late).select("id", "pos", F.lit(size).alias("size"))
    found = None
    if long_words is not None and min_lines > 1:
        found = places(_tied(rows.filter("long"), ["a", "b"], _first()), 1)
    tied, depth = _tied(rows, ["a", "b"], *([_first()] if min_lines == 1 else [])), 1
    while depth < min_lines:
        tied = tied.select("id", "pos", "rank")
        tied = materialize(tied.distinct() if repeats and depth == 1 else tied, narrow=True)
        step = min(depth, min_lines - depth)
        depth += step
        tied = _tied(materialize(_doubled(tied, step), narrow=True), ["r1", "r2"], *([_first()] if depth == min_lines else []))
    return places(tied, min_lines) if found is None else places(tied, min_lines).unionByName(found)


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines of their late runs; runs are doubled places and a mark of those of one line, in pairs."""
    for b in batches:
        kept, n_lines, n_removed, n_runs = [], [], [], []
        for text, late in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if text is None:
                rows = (None, 0, 0, 0)
            elif not late.is_valid or not len(late):
                rows = (text, text.count("\n") + 1, 0, 0)
            else:
                lines = text.split("\n")
                gone = np.zeros(len(lines) + 1, np.int64)
                pos, size = (late.values.field(k).to_numpy() for k in ("pos", "size"))
                np.add.at(gone, pos, 1)
                np.add.at(gone, pos + size, -1)
                out = np.cumsum(gone)[:-1] > 0
                rows = ("\n".join(x for x, o in zip(lines, out, strict=True) if not o), len(lines), int(out.sum()), int((np.diff(np.concatenate([[0], out.astype(np.int8)])) == 1).sum()))
            for x, y in zip((kept, n_lines, n_removed, n_runs), rows, strict=True):
                x.append(y)
        more = [pa.array(kept, pa.string()), *(pa.array(x, pa.int64()) for x in (n_lines, n_removed, n_runs))]
        yield pa.RecordBatch.from_arrays([*b.columns[2:], *more], names=[*b.schema.names[2:], "_kept", "_n_lines", "_n_removed", "_n_runs"])


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, long_words: int | None = None) -> DataFrame:
    """docs with the kept text in place of the text, and n_lines, n_removed, n_runs; lines of over long_words words also count alone."""
    bound_batches(docs.sparkSession)
    rows = docs.filter(F.col(id_col).isNotNull())
    texts = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    version = F.floor(F.col("pos") / VERSION)
    late = late_places(texts, min_lines, long_words)
    packed = late.groupBy("id", version.alias("version")).agg(F.collect_list(F.struct(F.pmod("pos", F.lit(VERSION)).alias("pos"), "size")).alias("late"))
    packed = materialize(packed.withColumnRenamed("id", "_id").withColumnRenamed("version", "_version"), narrow=True)
    others = [c for c in docs.columns if c != text_col]
    plain = rows.select(F.col(text_col).alias("_text"), F.col(id_col).cast("long").alias("_id"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    based, _ = with_versions(plain.select(F.col("_id").alias("id"), F.col("_text").alias("text"), F.struct("*").alias("_row")))
    plain = based.select("_row.*", F.floor(F.col("base") / VERSION).alias("_version"))
    # by shuffle at any size: a broadcast that fits small tables would only change the plan where it counts
    full = plain.join(packed.hint("merge"), ["_id", "_version"], "left").select("_text", "late", *[f"c{i}" for i in range(len(others))])
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in full.schema[2:]] + ["_kept string, _n_lines long, _n_removed long, _n_runs long"])
    out = full.mapInArrow(tidy(_cutter), schema)
    own = [F.col("_kept").alias(c) if c == text_col else F.col(f"c{others.index(c)}").alias(c) for c in docs.columns if c not in ("n_lines", "n_removed", "n_runs")]
    return out.select(*own, *[F.col(f"_{c}").alias(c) for c in ("n_lines", "n_removed", "n_runs")])


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2) -> DataFrame:
    """-> id, n_lines, n_removed, n_runs, kept_sha256 (of the kept text; null text counts as empty)."""
    out = remove_repeated_lines(docs.select(id_col, text_col), id_col, text_col, min_lines)
    return out.select(id_col, "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("kept_sha256"))
