"""Language identification by words first, then by character n-grams.

A word seen in training scores its log frequency in every language. An unseen word falls back to its character n-grams
(the word between two marks): the longest length of which any n-gram is known scores the mean of those; a word without a
known letter scores nothing. A text's language has the largest sum. Its score is that language's share after softmax of
the means by word, so that it tells how much a word of the text is of the language, whatever the text's length: texts of
words that no language has, score low.

Training reads a bounded sample of the labelled rows (``sample_rows`` and ``lang_rows``, chosen by a hash of the id, so
that any number of rows trains alike) and learns every word and n-gram of it. The model holds an entry's languages alone,
so that it grows with the sample, not with the product of entries and languages. Prediction reads the text alone.

Cases: null texts and texts without a letter are ``und`` with score 0; a text of unknown letters gets the language first
in order with an even share; ties go to the language first in order; rows with null language don't train; without any
labelled row everything is ``und``; null ids stay (their row is predicted like any other), and so do repeated rows; very
long texts are read whole; input columns lang_pred and score give way to those of the result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bound_batches, materialize, mix, powers, spread, tidy

LENGTHS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
BROADCAST_LANGS = 100_000
_MARK = 0x110000
_CACHE: dict[str, np.ndarray] = {}


def _kinds(codes: np.ndarray) -> np.ndarray:
    """1 for the code points that are letters, 2 for marks, which combine with letters; else 0. Looked up once each."""
    if "kinds" not in _CACHE:
        _CACHE["kinds"] = np.full(0x110000, 9, np.uint8)
    table = _CACHE["kinds"]
    kinds = table[codes]
    if (new := np.unique(codes[kinds == 9])).size:
        table[new] = ["LM".find(unicodedata.category(chr(c))[0]) + 1 for c in new.tolist()]
        kinds = table[codes]
    return kinds


def _hashes(codes: np.ndarray) -> np.ndarray:
    p, _ = powers(len(codes))
    h = np.empty(len(codes) + 1, U64)
    h[0] = 0
    np.cumsum((codes.astype(U64) * U64(0x9E3779B97F4A7C15) ^ U64(0xD6E8FEB86659FD93)) * p[: len(codes)], out=h[1:])
    return h


def _span(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = powers(len(h))
    return mix((h[end] - h[start]) * inv[start] + (end - start).astype(U64))


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points of the texts, and start, end and row of each run of letters and marks with a letter."""
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds(codes)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], kind > 0, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    letters = np.append(0, np.cumsum(kind == 1))
    proper = letters[end] > letters[start]
    start, end = start[proper], end[proper]
    begins = np.append(0, np.cumsum([len(t) + 1 for t in low]))
    return codes, start, end, np.searchsorted(begins, start, side="right") - 1


def _marked(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words one after another, each between two marks: hashes of the beginnings, where each word begins, and its length."""
    size = end - start + 2
    begin = np.cumsum(size) - size
    padded = np.full(size.sum(), _MARK, np.uint32)
    src, w = spread(start, end)
    padded[src - start[w] + begin[w] + 1] = codes[src]
    return _hashes(padded), begin, size


def _grams(h: np.ndarray, begin: np.ndarray, size: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of some marked words, and each one's word; single characters leave the marks out."""
    lo, hi = (begin[at] + 1, begin[at] + size[at] - 1) if n == 1 else (begin[at], begin[at] + size[at] - n + 1)
    s, which = spread(lo, hi)
    return _span(h, s, s + n), at[which]


@dataclass
class Table:
    """Entries of one kind: sorted hashes, and for each its languages with what they add to the languages' defaults."""

    keys: np.ndarray
    first: np.ndarray
    lang: np.ndarray
    more: np.ndarray
    default: np.ndarray

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of those of the hashes that are known, and which they are."""
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == h)
        return at[hit], hit


@dataclass
class Model:
    """Tables for words (0) and each n-gram length."""

    langs: list[str]
    tables: dict[int, Table]

    def _scores(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of distinct words: the kind that tells each (-1: none), and (word, language, share of an entry) beyond its defaults."""
        kind = np.full(len(h), -1, np.int64)
        parts = []

        def add(table: Table, at: np.ndarray, word: np.ndarray, weight: np.ndarray) -> None:
            e, which = spread(table.first[at], table.first[at + 1])
            parts.append((word[which], table.lang[e], table.more[e] * weight[which]))

        at, hit = self.tables[0].look(h)
        kind[hit] = 0
        add(self.tables[0], at, hit, np.ones(len(hit)))
        todo = np.flatnonzero(kind < 0)
        hh, begin, size = _marked(codes, start[todo], end[todo])
        for n in LENGTHS:
            open_ = np.flatnonzero((kind[todo] < 0) & (size >= n))
            if not len(open_) or n not in self.tables:
                continue
            g, word = _grams(hh, begin, size, open_, n)
            at, hit = self.tables[n].look(g)
            word = word[hit]
            hits = np.bincount(word, minlength=len(todo))
            kind[todo[hits > 0]] = n
            add(self.tables[n], at, todo[word], 1 / hits[word])
        return kind, *(np.concatenate(x) for x in zip(*parts, strict=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        codes, start, end, row = words_of(texts)
        has = np.bincount(row, minlength=len(texts)) > 0
        if not self.langs or not has.any():
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        h = _span(_hashes(codes), start, end)
        _, index, back = np.unique(h, return_index=True, return_inverse=True)
        kind, word, lang, more = self._scores(codes, start[index], end[index], h[index])
        k = len(self.langs)
        total = np.zeros((len(texts), k))
        for n, table in self.tables.items():
            total += np.bincount(row[kind[back] == n], minlength=len(texts))[:, None] * table.default
        # each text's distinct words with their numbers, and what their languages have more than the default
        pair, n = np.unique(row.astype(np.int64) * len(index) + back, return_counts=True)
        order = np.argsort(word, kind="stable")
        bounds = np.searchsorted(word[order], np.arange(len(index) + 1))
        of = pair % len(index)
        e, which = spread(bounds[of], bounds[of + 1])
        e = order[e]
        total += np.bincount(pair[which] // len(index) * k + lang[e], more[e] * n[which], minlength=len(texts) * k).reshape(-1, k)
        total = np.round(total, 9)  # so that equal sums are ties
        best = total.argmax(axis=1)
        mean = total / np.maximum(np.bincount(row[kind[back] >= 0], minlength=len(texts)), 1)[:, None]
        share = 1 / np.exp(mean - mean[np.arange(len(best)), best][:, None]).sum(axis=1)
        return [self.langs[i] if ok else UNKNOWN for i, ok in zip(best, has, strict=True)], np.where(has, share, 0.0)


def _pieces(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < limit):
            size += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def _entries(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Words (0) and n-grams of some texts: kind, hashes and numbers."""
    codes, start, end, _ = words_of(texts)
    h, index, n = np.unique(_span(_hashes(codes), start, end), return_index=True, return_counts=True)
    yield 0, h, n
    hh, begin, size = _marked(codes, start[index], end[index])
    for k in LENGTHS:
        g, word = _grams(hh, begin, size, np.flatnonzero(size >= k), k)
        u, inverse = np.unique(g, return_inverse=True)
        yield k, u, np.bincount(inverse, n[word], minlength=len(u)).astype(np.int64)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("entry", pa.int64()), ("n", pa.int64())])
    for b in batches:
        names, texts = np.array(b.column(0).to_pylist(), object), b.column(1).to_pylist()
        for lang in sorted(set(names)):
            own = [texts[i] for i in np.flatnonzero(names == lang)]
            for i, j in _pieces(own):
                for kind, h, n in _entries(own[i:j]):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h)), pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64)), pa.array(n)], schema=schema)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 8_000, lang_rows: int = 500) -> Model:
    """Learned on about sample_rows rows in equal parts, or lang_rows for each language if that is more; a language with fewer gives all."""
    bound_batches(labelled.sparkSession)
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = materialize(rows.groupBy(F.col(lang_col).alias("_lang")).agg(F.count("*").alias("_rows")), narrow=True)
    n_langs = sizes.count()
    most = max(lang_rows, sample_rows // max(n_langs, 1))
    part = F.floor(F.lit(most * (1 << 30)) / F.col("_rows")).cast("long")  # of 1 << 30; all rows of a language that has no more
    if n_langs <= BROADCAST_LANGS:
        sizes = F.broadcast(sizes)
    chosen = rows.select(lang_col, text_col, F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)).alias("_u")).join(sizes, F.col(lang_col) == F.col("_lang"))
    chosen = chosen.filter(F.col("_u") < part).select(lang_col, text_col)
    counts = chosen.mapInArrow(tidy(_counter), "lang string, kind int, entry long, n long").groupBy("lang", "kind", "entry").agg(F.sum("n").alias("n"))
    t = counts.toArrow()  # entries of the sample
    if not t.num_rows:
        return Model([], {})
    names, lang = np.unique(t.column("lang").to_numpy().astype(str), return_inverse=True)
    kind, entry, n = (t.column(c).to_numpy() for c in ("kind", "entry", "n"))
    tables = {}
    for k in sorted(set(kind.tolist())):
        own = np.flatnonzero(kind == k)
        own = own[np.lexsort((lang[own], entry[own].view(np.uint64)))]
        keys, first = np.unique(entry[own].view(np.uint64), return_index=True)
        base = np.log(np.bincount(lang[own], n[own], minlength=len(names)).clip(1) + 0.5 * len(keys))
        tables[k] = Table(keys, np.append(first, len(own)), lang[own], np.log(n[own] + 0.5) - np.log(0.5), np.log(0.5) - base)
    return Model(names.tolist(), tables)


def predict_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score; other columns stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # read once by each worker; the training sample bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            langs, scores = [], []
            for i, j in _pieces(texts):
                p, s = sent.value.predict(texts[i:j])
                langs += p
                scores.append(s)
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    names = [c for c in docs.columns if c != text_col]
    plain = docs.select(F.col(text_col).alias("_text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema] + ["lang_pred string", "score double"])
    out = plain.mapInArrow(tidy(run), fields)
    own = [F.col("_text").alias(text_col) if c == text_col else F.col(f"c{names.index(c)}").alias(c) for c in docs.columns if c not in ("lang_pred", "score")]
    return out.select(*own, "lang_pred", "score")


def held_out(id_col: str):
    """A fifth of the ids, by the CRC-32 of their decimal text."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """-> id, held_out, lang_pred, score, learned from the rows that aren't held out."""
    model = train(docs.filter(~held_out(id_col)), id_col, text_col, lang_col)
    out = predict_languages(docs.select(id_col, text_col), model, id_col, text_col)
    return out.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "lang_pred", "score")
