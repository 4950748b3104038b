"""Best-fit-decreasing packing of tokenized documents into sequences.

Best fit looks at lengths only, so that one histogram of lengths (at most ``capacity`` of them) decides everything: the
driver packs counts instead of documents, from the longest length down, each time into the tightest open bins, which a
segment tree over the remaining capacities finds in logarithmic time. The outcome is what best-fit decreasing gives
document by document. The plan says for each length which ranks go to which bins. Every task counts its pieces of a length
as it cuts them; where a task's ranks begin follows from the counts of the tasks before it, so that pieces are neither
sorted nor dealt out by length, and a length that most pieces have is no one's work alone.

Cases: a null id leaves the row out; null and empty texts are packed as the end id alone; repeated rows are packed as
often as they come; an empty table gives no rows; other columns are not read. Very long texts are cut into full pieces.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, chunks, materialize, prefix_hashes, runs, span_hashes, spread, text_bytes, tidy, word_spans

BROADCAST_COUNTS = 1_000_000


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True


def split_ends(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with up to three stops after an ASCII letter become two: a letter before a stop always ends a token."""
    cut = end.copy()
    for _ in range(3):
        cut -= (cut - 1 > start) & _STOP[data[cut - 1]]
    two = (cut < end) & _LETTER[data[cut - 1]] if len(cut) else np.zeros(0, bool)
    at = np.cumsum(1 + two) - 1  # each word's last part
    n = int(at[-1]) + 1 if len(at) else 0
    s, e, r = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
    s[at], e[at], r[at] = np.where(two, cut, start), end, row
    s[at[two] - 1], e[at[two] - 1], r[at[two] - 1] = start[two], cut[two], row[two]
    return s, e, r


def lower_plain(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, but in words with other bytes than ASCII (they may compose) or with < (a special token)."""
    odd = np.append(0, np.cumsum((data >= 128) | (data == 60)))
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    keep = np.flatnonzero(odd[end] > odd[start])
    at, _ = spread(start[keep], end[keep])
    low[at] = data[at]
    return low


def _merge(*tables: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Tables of columns, the first of them sorted, as one."""
    if not tables:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    columns = [np.concatenate(c) for c in zip(*tables, strict=True)]
    order = np.argsort(columns[0], kind="stable")
    return tuple(c[order] for c in columns)


class WordTokenizer:
    """Ids of words, each tokenized once and remembered (up to a bound).

    For lower-casing tokenizers whose tokens never cross white space nor the border between letters and stops: the ids
    of a text are those of its words, one after another.
    """

    def __init__(self, path: str, most: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.clear()

    def clear(self) -> None:
        #: Sorted hashes with places and numbers of their ids: of most words, and of those met lately.
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.known, self.late = none, none
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        ids, counts = [], []
        for i in range(0, len(words), 5000):
            text = [w.decode("utf-8", "replace") for w in words[i : i + 5000]]
            e = self.tokenizer.encode(" ".join(text), add_special_tokens=False)
            start = np.append(0, np.cumsum([len(t) + 1 for t in text]))
            begin = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids))
            counts.append(np.bincount(np.searchsorted(start, begin, side="right") - 1, minlength=len(text)))
            ids.append(np.array(e.ids, np.uint32))
        new, n = np.concatenate(ids), np.concatenate(counts)
        if self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(new), self.used), np.uint32)])
        self.ids[self.used : self.used + len(new)] = new
        at = self.used + np.cumsum(n) - n
        self.used += len(new)
        self.late = _merge(self.late, (hashes, at, n.astype(np.int32)))
        if len(self.late[0]) > 60_000:
            self.known, self.late = _merge(self.known, self.late), _merge()

    def _look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of each word; place -1 if it isn't known."""
        first, n = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for known, at, count in (self.known, self.late):
            if len(known):
                k = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[k] == hashes
                first[hit], n[hit] = at[k[hit]], count[k[hit]]
        return first, n

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, one after another, and each row's number of them."""
        rows = len(off) - 1
        start, end, row = split_ends(data, *word_spans(data, off))
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        h = span_hashes(prefix_hashes(lower_plain(data, start, end)), start, end)
        distinct, index, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known[0]) > self.most:
            self.clear()
        first, n = self._look(distinct)
        fresh = np.flatnonzero(first < 0)
        if len(fresh):
            raw = data.tobytes()
            self._learn(distinct[fresh], [raw[s:e] for s, e in zip(start[index[fresh]].tolist(), end[index[fresh]].tolist(), strict=True)])
            first[fresh], n[fresh] = self._look(distinct[fresh])
        first, n = first[back], n[back]
        places, _ = spread(first, first + n)
        return self.ids[places], np.bincount(row, weights=n, minlength=rows).astype(np.int64)


_KEPT: dict[str, WordTokenizer] = {}


def kept_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer with all words this worker has met, in this task or before."""
    if path not in _KEPT:
        _KEPT[path] = WordTokenizer(path)
    return _KEPT[path]


# --- the plan -----------------------------------------------------------------------------------


class FirstAtLeast:
    """A segment tree over 0..n that tells the smallest marked value of at least v."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.any = [False] * (2 * self.size)

    def mark(self, v: int, on: bool) -> None:
        v += self.size
        self.any[v] = on
        while v > 1:
            v //= 2
            self.any[v] = self.any[2 * v] or self.any[2 * v + 1]

    def find(self, v: int) -> int | None:
        v += self.size
        if self.any[v]:
            return v - self.size
        while v > 1 and not (v % 2 == 0 and self.any[v + 1]):
            v //= 2
        if v <= 1:
            return None
        v += 1
        while v < self.size:
            v = 2 * v if self.any[2 * v] else 2 * v + 1
        return v - self.size


@dataclass
class Plan:
    """Row by row: ranks from ``rank`` on of ``length`` go to bins from ``bin`` on, ``each`` per bin, from ``offset`` on."""

    length: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    n_bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.length * (1 << 40) + self.rank
        at = np.searchsorted(key, length * (1 << 40) + rank, side="right") - 1
        k = rank - self.rank[at]
        return self.bin[at] + k // self.each[at], self.offset[at] + k % self.each[at] * length


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """counts: how many pieces have each length of 1..capacity."""
    tree = FirstAtLeast(capacity)
    open_: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> (first bin, bins)
    rows, n_bins = [], 0

    def put(room: int, first: int, bins: int) -> None:
        if room and bins:
            if not open_.setdefault(room, []):
                tree.mark(room, True)
            open_[room].append((first, bins))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.find(length)
            if room is None:
                room, first, bins = capacity, n_bins, -(-left // (capacity // length))
                n_bins += bins
            else:
                first, bins = open_[room].pop()
                if not open_[room]:
                    tree.mark(room, False)
            each = room // length
            full = min(bins, left // each)
            rest = min(left - full * each, each) if full < bins else 0
            rows.append((length, rank, first, each, capacity - room))
            put(room - each * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            put(room, first + full + bool(rest), bins - full - bool(rest))
            taken = full * each + rest
            left, rank = left - taken, rank + taken
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*(a[:, k] for k in range(5)), n_bins)


# --- over a table -------------------------------------------------------------------------------


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = None
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            tokenizer = tokenizer or kept_tokenizer(path)
            data, off = text_bytes(b.column(1))
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in chunks(off):
                flat, n = tokenizer.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                flat = np.insert(flat, np.cumsum(n), np.uint32(end_id)).astype("<u4")
                n = n + 1
                base = np.cumsum(n) - n
                piece, row = spread(np.zeros(j - i, np.int64), -(-n // capacity))
                start = piece * capacity
                length = np.minimum(n[row] - start, capacity)
                at = base[row] + start
                raw = memoryview(flat).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                first, group = runs(length[order])
                k = np.empty(len(length), np.int64)
                k[order] = np.arange(len(length)) - first[group]
                k += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                cols = [pa.array(ids[i:j][row]), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(k), task, np.int32)), pa.array(k)]
                names = ["id", "piece", "start", "length", "ids_crc32", "task", "k"]
                if with_ids:
                    cols.append(pa.array([flat[a : a + m].tolist() for a, m in zip(at.tolist(), length.tolist(), strict=True)], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _placer(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, before, k = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "before", "k"))
            bins, offset = plan.place(length, before + k)
            keep = [i for i, c in enumerate(b.schema.names) if c not in ("before", "k")]
            cols = [b.column(i) for i in keep] + [pa.array(bins), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(cols, names=[b.schema.names[i] for i in keep] + ["sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """-> id, piece, start, length, ids_crc32, sequence_id, offset (with_ids: also ids)."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    more = ", ids array<int>" if with_ids else ""
    schema = f"id long, piece int, start long, length long, ids_crc32 long{more}"
    numbered = f"id long, piece int, start long, length long, ids_crc32 long, task int, k long{more}"
    pieces = materialize(texts.mapInArrow(tidy(_pieces(tokenizer_path, capacity, end_id, with_ids)), numbered))
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = materialize(counts.select("length", "task", "n", before.alias("before")))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    starts = counts.select("length", "task", "before")
    if counts.count() <= BROADCAST_COUNTS:
        starts = F.broadcast(starts)
    placed = pieces.join(starts, ["length", "task"]).select(*[f.strip().split(" ")[0] for f in schema.split(", ")], "before", "k")
    return placed.mapInArrow(tidy(_placer(best_fit_decreasing(totals, capacity))), f"{schema}, sequence_id long, offset long").withColumnRenamed("id", id_col)
