"""Audit of how far sources of a language differ in their words: sums of absolute differences of smoothed term shares.

A term is a run of letters A-Z, a-z and characters beyond ASCII, A-Z lower-cased. A language keeps the terms that occur in
at least ``least_docs`` of its documents. A group (language, source) gives a kept term the share
p = 1 + floor(10**9 (count + 5) / (N + 5 V)), an integer, and the language gives it q from its own counts.

The difference of two groups is summed over all kept terms, also those that neither has, by a heavy-light split:

A pair of groups starts with the number of kept terms times the difference of their shares of a missing term.

* **Heavy** terms, present in many groups, go into dense numpy tiles: a tile is a block of terms against two blocks of
  sources, filled with the groups' shares of a missing term and then with what there is. Its sum replaces the start of
  those of its terms that one of the sources has.
* **Light** terms are sparse, and only change the start. What a group's own light terms change against a group without them depends on their shares alone, so
  that a histogram of shares, handled in the tile, is enough. Where both groups have a term, its posting list of at most
  ``light_groups`` groups gives a correction to each pair of them, summed in the task.

Both sums are integers and are added exactly. A term is heavy if its posting list has over light_groups groups or over half
of the language's, where pairs of the list cost more than the tile's row. Nothing is dropped on either way.

Documents are counted in the tasks before anything is shuffled; a (language, source, term) is one row from then on, so that
a source with a third of all rows is no larger than its vocabulary. Tiles are bounded in terms, sources and rows.

Cases: null text, language and source are empty strings; groups without terms and languages without kept terms have their
rows, with value 0; every row is a document, also with a null or repeated id; very long texts count whole; an empty table
gives no rows; other columns don't matter. Counts of words are exact below 10**18.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, chunks, class_spans, lowered, materialize, spread, text_bytes, tidy

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
#: Rows that a task holds before it adds up and passes on what it has counted.
HELD = 400_000
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _terms(data: np.ndarray, off: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms in order, as numbers of distinct ones, and each one's row."""
    inside = _LETTER[data]
    start, end, row = class_spans(inside, off)
    ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    letters = np.ascontiguousarray(lowered(data[inside]))
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(letters)).dictionary_encode(), row


def _added(parts: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return sums.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(_COUNTS.names)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> occurrences and documents by lang, source and term, added up as far as HELD rows reach."""
    held: list[pa.Table] = []
    size = 0
    for b in batches:
        langs, sources = b.column(0), b.column(1)
        seen: dict[tuple, int] = {}
        group = np.array([seen.setdefault(k, len(seen)) for k in zip(langs.to_pylist(), sources.to_pylist(), strict=True)], np.int64)
        names = list(seen)
        data, off = text_bytes(b.column(2))
        for i, j in chunks(off):
            terms, row = _terms(data[off[i] : off[j]], off[i : j + 1] - off[i])
            k = len(terms.dictionary)
            if not k:
                continue
            each, n = np.unique(row * k + terms.indices.to_numpy().astype(np.int64), return_counts=True)
            key, where = np.unique(group[i:j][each // k] * k + each % k, return_inverse=True)
            own = key // k
            held.append(pa.table([
                pa.array([names[g][0] for g in range(len(names))], pa.string()).take(pa.array(own)), pa.array([names[g][1] for g in range(len(names))], pa.string()).take(pa.array(own)),
                terms.dictionary.take(pa.array(key % k)).cast(pa.string()), pa.array(np.bincount(where, n).astype(np.int64)), pa.array(np.bincount(where).astype(np.int64)),
            ], schema=_COUNTS))
            size += len(key)
            if size > HELD:
                held = [_added(held)]
                size = held[0].num_rows
                if size > HELD // 2:
                    yield from held[0].to_batches(max_chunksize=50_000)
                    held, size = [], 0
    if held:
        yield from _added(held).to_batches(max_chunksize=50_000)


def _share(n: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(10**9 (n + 5) / (total + 5 terms)), exactly; null without terms."""
    wide = lambda c: c.cast("decimal(18,0)")
    top = F.lit(1_000_000_000).cast("decimal(10,0)") * wide(F.col(n) + 5 if isinstance(n, str) else n + 5)
    below = wide(F.col(total) + 5 * F.col(terms))
    return F.when(F.col(terms) > 0, F.call_function("div", top, below) + 1)


# --- tiles and postings -------------------------------------------------------------------------

_PAIRS = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("v", pa.int64())])


def _one_sided(of: np.ndarray, z_of: np.ndarray, at: np.ndarray, p: np.ndarray, m: np.ndarray, z: np.ndarray) -> np.ndarray:
    """For source of[at] with m light terms of share p, and each source with z: what they have more than the starting difference."""
    out = np.zeros((len(of), len(z)), np.int64)
    for i in range(0, len(at), 4096):
        a, own = at[i : i + 4096], p[i : i + 4096, None]
        np.add.at(out, a, m[i : i + 4096, None] * (np.abs(own - z) - np.abs(z_of[a][:, None] - z)))
    return out


def _tile(t: pa.Table) -> pa.Table:
    """Rows of a tile -> partial sums of its pairs: groups' own rows (0), shares of heavy terms (1), histograms of light ones (2)."""
    kind, idx, p, m = (t.column(c).to_numpy() for c in ("kind", "idx", "p", "m"))
    lang, i, j, side = (t.column(c)[0].as_py() for c in ("lang", "i", "j", "side"))
    own = kind == 0
    order = np.argsort(idx[own])
    ids, z = idx[own][order], p[own][order]
    at = np.searchsorted(ids, idx)
    left, right = np.flatnonzero(ids // side == i), np.flatnonzero(ids // side == j)
    apart = np.abs(z[left][:, None] - z[right])
    out = m[own].max(initial=0) * apart
    heavy = kind == 1
    if heavy.any():
        code = t.column("term").filter(pa.array(heavy)).combine_chunks().dictionary_encode()
        dense = np.repeat(z[:, None], len(code.dictionary), axis=1)
        dense[at[heavy], code.indices.to_numpy()] = p[heavy]
        for row, s in enumerate(left):
            out[row] += np.abs(dense[right] - dense[s]).sum(axis=1)
        out -= len(code.dictionary) * apart
    sparse = kind == 2
    for one, other, turned in ((left, right, False), (right, left, True)):
        mine = sparse & np.isin(at, one)
        if mine.any():
            more = _one_sided(one, z[one], np.searchsorted(one, at[mine]), p[mine], m[mine], z[other])
            out += more.T if turned else more
    a, b = (x.ravel() for x in np.meshgrid(ids[left], ids[right], indexing="ij"))
    keep = a < b
    return pa.table([pa.array([lang] * int(keep.sum()), pa.string()), pa.array(a[keep]), pa.array(b[keep]), pa.array(out.ravel()[keep])], schema=_PAIRS)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists of light terms (lang, groups, p, z) -> corrections of the pairs that share a term, added up by batch."""
    for b in batches:
        langs = b.column(0).dictionary_encode()
        lang, lists = langs.indices.to_numpy().astype(np.int64), b.column(1)
        size, off = lists.value_lengths().to_numpy(), lists.offsets.to_numpy()
        idx, p, z = (lists.values.field(k).to_numpy() for k in ("idx", "p", "z"))
        found: list[pa.Table] = []
        for k in np.unique(size[size > 1]):
            x, y = np.triu_indices(k, 1)
            rows = np.flatnonzero(size == k)
            step = max(1, 1_000_000 // len(x))
            for s in range(0, len(rows), step):
                some = rows[s : s + step]
                at = off[some][:, None] + np.arange(k)
                u, v = at[:, x].ravel(), at[:, y].ravel()
                more = np.abs(p[u] - p[v]) - np.abs(p[u] - z[v]) - np.abs(p[v] - z[u]) + np.abs(z[u] - z[v])
                names = langs.dictionary.take(pa.array(np.repeat(lang[some], len(x))))
                found.append(_sum_pairs([pa.table([names, pa.array(np.minimum(idx[u], idx[v])), pa.array(np.maximum(idx[u], idx[v])), pa.array(more)], schema=_PAIRS)]))
        if found:
            yield from _sum_pairs(found).to_batches(max_chunksize=50_000)


def _sum_pairs(parts: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(parts).group_by(["lang", "a", "b"]).aggregate([("v", "sum")])
    return sums.select(["lang", "a", "b", "v_sum"]).rename_columns(_PAIRS.names)


# --- the audit ----------------------------------------------------------------------------------


def _counted(docs: DataFrame, text_col: str, lang_col: str, source_col: str, least_docs: int, light_groups: int) -> tuple[DataFrame, DataFrame]:
    """Kept terms by group (lang, idx, source, term, n, q_n, heavy, leads), and groups (lang, source, idx, size)."""
    names = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(names(lang_col).alias("lang"), names(source_col).alias("source"), F.col(f"`{text_col}`").alias("text"))
    by_lang = Window.partitionBy("lang")
    groups = rows.select("lang", "source").distinct().withColumn("size", F.count("*").over(by_lang)).withColumn("idx", F.row_number().over(by_lang.orderBy("source")).cast("long") - 1)
    groups = materialize(groups, narrow=True)
    counts = rows.mapInArrow(tidy(_counter), "lang string, source string, term string, n long, docs long")
    term = Window.partitionBy("lang", "term")
    sums = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    sums = sums.withColumns({"lang_docs": F.sum("docs").over(term), "q_n": F.sum("n").over(term), "k": F.count("*").over(term), "leads": F.row_number().over(term.orderBy("source")) == 1})
    kept = sums.filter(F.col("lang_docs") >= least_docs).join(groups, ["lang", "source"])
    heavy = (F.col("k") > light_groups) | (2 * F.col("k") > F.col("size"))
    return materialize(kept.select("lang", "idx", "source", "term", "n", "q_n", heavy.alias("heavy"), "leads")), groups


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, top: int = 50, light_groups: int = 256, side: int = 128, tile_terms: int = 512) -> DataFrame:
    """-> lang, source, part, item, value, rank: differences from each other source, and the terms with the largest excess over the language."""
    bound_batches(docs.sparkSession)
    kept, groups = _counted(docs, text_col, lang_col, source_col, least_docs, light_groups)
    langs = kept.groupBy("lang").agg(F.count_if("leads").alias("terms"), F.sum("n").alias("lang_n"), F.count_if(F.col("leads") & F.col("heavy")).alias("n_heavy"))
    of_group = kept.groupBy("lang", "idx").agg(F.sum("n").alias("group_n"))
    spread_over = kept.filter(~F.col("heavy")).groupBy("lang", "idx", "n").count().groupBy("lang").agg(F.count("*").alias("n_hist"))
    zero = lambda *cs: {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in cs}
    groups = groups.join(langs, "lang", "left").join(spread_over, "lang", "left").join(of_group, ["lang", "idx"], "left").withColumns(zero("terms", "lang_n", "n_heavy", "n_hist", "group_n"))
    tiles = F.greatest(F.lit(1), F.ceil(F.col("n_heavy") / tile_terms), F.ceil(F.col("n_hist") / (64 * tile_terms)))
    z = F.coalesce(_share(F.lit(0), "group_n", "terms"), F.lit(0).cast("long"))
    groups = materialize(groups.withColumns({"tiles": tiles.cast("int"), "z": z, "blocks": F.ceil(F.col("size") / side).cast("int")}), narrow=True)
    shares = kept.join(groups.select("lang", "idx", "terms", "group_n", "lang_n", "z", "tiles", "blocks"), ["lang", "idx"])
    shares = shares.withColumns({"p": _share("n", "group_n", "terms"), "q": _share("q_n", "lang_n", "terms")})

    # pairs of sources
    none, no_term = F.lit(0).cast("long"), F.lit(None).cast("string")
    chunk = lambda *by: F.pmod(F.xxhash64(*by), F.col("tiles")).cast("int")
    parts = groups.select("lang", "idx", "blocks", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("chunk"), F.lit(0).alias("kind"), no_term.alias("term"), F.col("z").alias("p"), "terms")
    parts = parts.select("lang", "idx", "blocks", "chunk", "kind", "term", "p", F.when(F.col("chunk") == 0, F.col("terms")).otherwise(none).alias("m"))
    dense = shares.filter("heavy").select("lang", "idx", "blocks", chunk("term").alias("chunk"), F.lit(1).alias("kind"), "term", "p", none.alias("m"))
    light = shares.filter(~F.col("heavy"))
    hist = light.groupBy("lang", "idx", "blocks", "tiles", "p").agg(F.count("*").alias("m"))
    hist = hist.select("lang", "idx", "blocks", chunk("idx", "p").alias("chunk"), F.lit(2).alias("kind"), no_term.alias("term"), "p", "m")
    rows = parts.unionByName(dense).unionByName(hist)
    own = F.floor(F.col("idx") / side).cast("int")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("lang", F.least(own, "other").alias("i"), F.greatest(own, "other").alias("j"), F.lit(side).alias("side"), "chunk", "kind", "idx", "term", "p", "m")
    pair_type = "lang string, a long, b long, v long"
    sums = rows.groupBy("lang", "i", "j", "chunk").applyInArrow(_tile, pair_type)
    lists = light.groupBy("lang", "term").agg(F.collect_list(F.struct("idx", "p", "z")).alias("groups")).filter(F.size("groups") > 1)
    fixes = lists.select("lang", "groups").mapInArrow(_postings, pair_type)
    pairs = materialize(sums.unionByName(fixes).groupBy("lang", "a", "b").agg(F.sum("v").alias("value")), narrow=True)
    both = pairs.unionByName(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    named = lambda key, name: groups.select("lang", F.col("idx").alias(key), F.col("source").alias(name))
    both = both.join(named("a", "source"), ["lang", "a"]).join(named("b", "item"), ["lang", "b"])
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    both = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))

    # terms
    over = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return both.unionByName(over.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top))
