"""Removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every string of ``length`` bytes is assigned to the smallest hash among its 32-byte substrings (leftmost on ties), its
anchor, which depends on the string alone. So equal strings share an anchor, and anchors deal the work into blocks that
are independent of each other. The strings of one anchor occurrence overlap and make one stretch of text:

1. Stretches equal as a whole: all but the earliest are repeats throughout.
2. Where one anchor has different stretches, the earliest of each goes into its block's transform. From the empty
   string's interval on, breadth first, every interval is extended backward by every byte before it; an interval of
   strings of length l + 1 sets the common prefix at its right border to l if none is set. Values so come in increasing
   order, and the expansion stops at the minimum length: borders without a value join suffixes with at least that much
   in common, whose later starts are repeats.

An anchor with very many different stretches (a passage that many documents share, each going on in its own way) would
be one block's work: its strings are dealt on by their own hash, which again depends on the string alone, into as many
blocks as their bytes ask for once every string stands alone, the most that this can come to. Pieces that are equal as a
whole are settled as stretches are, in the task that cuts them and again in the block, so that a string which all
stretches share isn't one block's work either.

Cases: a null id leaves the row out; null and empty texts have no bytes and the hash of nothing; repeated rows (same id
and text) are one place, so that they don't remove each other, and each gets the same result; rows with the same id and
different texts are documents one after another, in the order of their texts' hashes; texts of any length a string
column holds are cut in overlapping windows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, VERSION, batch, bound_batches, chunks, deal, materialize, mix, partitions, prefix_hashes, runs, span_hashes, spans_of, spread, text_bytes, tidy, unpack, with_versions

GRAM = 32
_POS = U64((1 << 28) - 1)
#: Bytes of a text that are looked at together, and of one anchor's stretches from which its strings are dealt on.
WINDOW = 1 << 26
HOT_BYTES = 1 << 21
#: Bytes of such an anchor's pieces that are held to be settled before they go on.
HELD_BYTES = 1 << 23
BROADCAST_ROWS = 1_000_000


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w neighbours, from prefix and suffix minima of blocks of w."""
    n = len(a) - w + 1
    full = np.full(-(-len(a) // w) * w, np.iinfo(a.dtype).max, a.dtype)
    full[: len(a)] = a
    blocks = full.reshape(-1, w)
    front = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], front[w - 1 : w - 1 + n])


def stretches(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, stretch hash, row, first start (in the row) and last start less first, of every anchor occurrence."""
    gram = min(GRAM, length)
    size = np.diff(off)
    long_ = np.flatnonzero(size >= length)
    none = np.zeros(0, np.int64)
    if not len(long_):
        return none.view(U64), none.view(U64), none, none, none
    h = prefix_hashes(data)
    at = np.arange(len(data) - gram + 1)
    g = span_hashes(h, at, at + gram)
    least = sliding_min((g & ~_POS) | at.astype(U64), length - gram + 1)
    starts, row = spread(off[long_], off[long_] + size[long_] - length + 1)
    anchor = (least[starts] & _POS).astype(np.int64)
    first, _ = runs(anchor * 2 + (row & 1))
    lo, hi, row = starts[first], starts[np.append(first[1:], len(starts)) - 1], long_[row[first]]
    return g[anchor[first]], span_hashes(h, lo, hi + length), row, lo - off[row], hi - lo


def _width(length: int) -> type:
    """What a stretch's last start less its first fits in."""
    return np.uint8 if length - min(GRAM, length) < 1 << 8 else np.uint32


def _windows(data: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """Row range, bytes and offsets of the pieces of a batch, and the start of the bytes in their text: every string is in one."""
    for i, j in chunks(off):
        part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        for at in range(0, max(len(part), 1), WINDOW):
            if len(part) <= WINDOW:
                yield i, j, part, o, 0
            else:  # one text
                some = part[at : at + WINDOW + length - 1]
                yield i, j, some, np.array([0, len(some)], np.int64), at


def _settled(g: np.ndarray, s: np.ndarray, ids: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the rows by stretch and place, without repeated places; marks of the first of each stretch and of its anchor."""
    order = np.lexsort((lo, ids, s, g))
    g, s, ids, lo = g[order], s[order], ids[order], lo[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (ids[1:] != ids[:-1]) | (lo[1:] != lo[:-1])
    order, g, s = order[new], g[new], s[new]
    anchor = np.ones(len(g), bool)
    anchor[1:] = g[1:] != g[:-1]
    first = anchor.copy()
    first[1:] |= s[1:] != s[:-1]
    return order, first, anchor


def _mapper(length: int, n_parts: int, place: type):
    schema = pa.schema([("part", pa.int32()), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush():
            g, s, ids, lo, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            # a stretch's earliest place here is compared with others' elsewhere; the rest are repeats whatever is found there
            order, first, _ = _settled(g, s, ids, lo)
            own, late = order[first], order[~first]
            blocks = list(deal((g[own] >> U64(40)) % U64(n_parts), n_parts, [g[own], s[own], ids[own], lo[own].astype(place), n[own].astype(_width(length))]))
            blocks += [(-1 - p, v) for p, v in deal(mix(ids[late].view(U64)) % U64(n_parts), n_parts, [ids[late], lo[late].astype(np.int64), n[late].astype(np.int64) + length])]
            return batch(schema, [p for p, _ in blocks], [b for _, b in blocks])

        for b in batches:
            data, off = text_bytes(b.column(1))
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            base = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j, part, o, at in _windows(data, off, length):
                g, s, row, lo, n = stretches(part, o, length)
                held.append((g, s, ids[i:j][row], lo + at + base[i:j][row], n))
                if sum(len(x[0]) for x in held) >= 400_000:
                    yield flush()
        if held:
            yield flush()

    return run


#: kind 0: a repeat, bytes [start, start + size); 1: the earliest of a stretch whose anchor has others, with the anchor's key
_SPANS = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("id", pa.int64()), ("start", pa.int64()), ("size", pa.int64())])


def _reducer(length: int, place: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        for b in batches:
            part = b.column(0).to_numpy()
            blobs += [b.column(1)[int(i)].as_py() for i in np.flatnonzero(part >= 0)]
            ids, lo, size = unpack((b.column(1)[int(i)].as_py() for i in np.flatnonzero(part < 0)), [np.int64] * 3)
            yield batch(_SPANS, np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int64), ids, lo, size)
        g, s, ids, lo, n = unpack(blobs, [U64, U64, np.int64, place, _width(length)])
        del blobs
        order = np.argsort(g)
        same = np.zeros(len(g), bool)
        same[1:] = g[order][1:] == g[order][:-1]
        same[:-1] |= same[1:]
        order = order[same]
        if not len(order):
            return
        g, s, ids, lo, size = g[order], s[order], ids[order], lo[order].astype(np.int64), n[order].astype(np.int64) + length
        order, first, anchor = _settled(g, s, ids, lo)
        g, ids, lo, size = g[order], ids[order], lo[order], size[order]
        r = np.flatnonzero(~first)
        yield batch(_SPANS, np.zeros(len(r), np.int32), np.zeros(len(r), np.int64), ids[r], lo[r], size[r])
        group = np.cumsum(anchor) - 1
        mixed = np.bincount(group, weights=first)[group] > 1
        r = np.flatnonzero(first & mixed)
        yield batch(_SPANS, np.ones(len(r), np.int32), g[r].view(np.int64), ids[r], lo[r], size[r])

    return run


# --- the transform ------------------------------------------------------------------------------


def suffix_order(text: np.ndarray, string: np.ndarray) -> np.ndarray:
    """Suffixes of strings, each ended by a 0 of its own (they rank by string), ordered by prefix doubling."""
    n = len(text)
    ends = np.flatnonzero(text == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # bytes before the end
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(U64)
    key = np.zeros(n, U64)
    for k in range(8):
        key = key << U64(8) | np.where(left > k, padded[k : k + n], U64(0))
    order = np.lexsort((np.where(left < 8, string, 0), key))
    new = np.ones(n, bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (left[order][1:] < 8)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    depth = 8
    while True:
        tied = np.bincount(rank, minlength=n)[rank] > 1
        some = np.flatnonzero(tied)
        if not len(some):
            break
        key2 = rank[some].astype(U64) << U64(32) | rank[some + depth].astype(U64)
        o = np.argsort(key2, kind="stable")
        some, key2 = some[o], key2[o]
        old = rank[some]
        starts, group = runs(old)
        place = old + np.arange(len(some)) - starts[group]
        fresh, which = runs(key2)
        rank[some] = place[fresh][which]
        depth *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, threshold: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it; -1 where it is threshold or more."""
    n = len(text)
    bwt = text[order - 1]  # the byte before; before the first string stands an end
    by = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by] = np.arange(n)
    lcp = np.full(n + 1, -1, np.int64)
    n_ends = int((text == 0).sum())
    lcp[: n_ends + 1] = 0
    lcp[n] = 0
    # strings of one symbol: each byte's suffixes, and each end alone
    symbols, counts = np.unique(text, return_counts=True)
    right = np.cumsum(counts)
    rb = np.concatenate([right[symbols > 0], np.arange(1, n_ends + 1)])
    lb = np.concatenate([(right - counts)[symbols > 0], np.arange(n_ends)])
    lcp[rb] = 0
    level = 1
    while level < threshold and len(lb):
        i, g = spread(lb, rb)
        c = bwt[i]
        keep = c > 0
        i, g, c = i[keep], g[keep], c[keep].astype(np.int64)
        key = g * 256 + c
        o = np.argsort(key, kind="stable")
        fresh, _ = runs(key[o])
        to = lf[i[o]]
        lb, rb = to[fresh], to[np.append(fresh[1:], len(to)) - 1] + 1 if len(to) else to
        open_ = lcp[rb] < 0
        lb, rb = lb[open_], rb[open_]
        lcp[rb] = level
        level += 1
    return lcp[:n]


def repeated_starts(parts: list[bytes], ids: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, start) of every string of length bytes in the parts that also starts earlier in them."""
    sizes = np.array([len(p) + 1 for p in parts])
    # UTF-8 has no byte above 0xF4, so that every byte plus one leaves 0 free
    text = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8) + np.uint8(1)
    string = np.repeat(np.arange(len(parts)), sizes)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = suffix_order(text, string)
    lcp = common_prefixes(text, order, length)
    joined = lcp < 0
    group = np.cumsum(~joined)
    many = joined.copy()
    many[:-1] |= joined[1:]
    at = order[many]
    group, where, start = group[many], ids[string[at]], starts[string[at]] + inside[at]
    o = np.lexsort((start, where, group))
    group, where, start = group[o], where[o], start[o]
    later = np.zeros(len(group), bool)
    later[1:] = group[1:] == group[:-1]
    # one place can stand in two stretches only if it is the same start, which is no repeat of itself
    first = np.flatnonzero(~later)
    head = np.maximum.accumulate(np.where(~later, np.arange(len(group)), 0)) if len(group) else first
    later &= (where != where[head]) | (start != start[head])
    return where[later], start[later]


#: size 0: a stretch or piece for its key's transform; else a repeat, bytes [start, start + size)
_CUT = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("text", pa.binary())])


class Settler:
    """The earliest place of each piece (key, text), and the later ones, which are repeats throughout."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.first: dict[tuple[int, bytes], tuple[int, int]] = {}
        self.repeats: list[tuple[int, int, int]] = []
        self.bytes = 0

    def add(self, key: int, text: bytes, place: tuple[int, int]) -> None:
        now = self.first.setdefault((key, text), place)
        if now is place:
            self.bytes += len(text)
        elif now != place:  # a repeated row has the same place
            self.first[key, text] = min(now, place)
            self.repeats.append((*max(now, place), len(text)))


def _deal_on(raw: bytes, parts: int, length: int) -> list[tuple[int, int, int]]:
    """(block, first byte, end) of the runs of strings of a stretch whose hashes are of the same block."""
    data = np.frombuffer(raw, np.uint8)
    at = np.arange(len(data) - length + 1)
    block = (span_hashes(prefix_hashes(data), at, at + length) % U64(parts)).astype(np.int64)
    first, _ = runs(block)
    return [(int(block[i]), i, j - 1 + length) for i, j in spans_of(first, len(block))]


def _cutter(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The stretches asked of each document; those of anchors in several blocks by the blocks of their strings."""
        dealt = Settler()

        def settled():
            # repeats need no block: any key of their own will do
            late = [(int(mix(np.array([i], np.int64).view(U64)).view(np.int64)[0]), i, s, n, None) for i, s, n in dealt.repeats]
            out = [*late, *((k, *place, 0, text) for (k, text), place in dealt.first.items())]
            dealt.clear()
            return batch(_CUT, *([x[c] for x in out] for c in range(5)))

        for b in batches:
            data, off = text_bytes(b.column(1))
            raw = data.tobytes()
            ids, base = b.column(0).to_pylist(), b.column(2).to_numpy()
            out: list[tuple] = []
            for k, want in enumerate(b.column(3).to_pylist()):
                for w in want:
                    if w["start"] // VERSION != base[k] // VERSION:
                        continue
                    at = off[k] + w["start"] - base[k]
                    text = raw[at : at + w["size"]]
                    if w["parts"] == 1:
                        out.append((w["key"], ids[k], w["start"], 0, text))
                        continue
                    keys = mix(np.array([w["key"]], np.int64).view(U64) + np.arange(1, w["parts"] + 1, dtype=U64)).view(np.int64)
                    for p, i, j in _deal_on(text, w["parts"], length):
                        dealt.add(int(keys[p]), text[i:j], (ids[k], w["start"] + i))
                    if dealt.bytes + 24 * len(dealt.repeats) >= HELD_BYTES:
                        yield settled()
            yield batch(_CUT, *([x[c] for x in out] for c in range(5)))
        yield settled()

    return run


def _expander(length: int, limit: int = 1 << 17):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors arrive in order; as many as fit in limit bytes share a transform, and one anchor is never split."""
        held, last = Settler(), None

        def spans(ids, start, size):
            return batch(_SPANS, np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int64), ids, start, size)

        def work():
            yield spans(*([x[c] for x in held.repeats] for c in range(3)))
            ids, starts = (np.array([p[c] for p in held.first.values()], np.int64) for c in range(2))
            ids, start = repeated_starts([text for _, text in held.first], ids, starts, length)
            yield spans(ids, start, np.full(len(ids), length))
            held.clear()

        for b in batches:
            late = b.filter(pc.greater(b.column(3), 0))
            if late.num_rows:
                yield spans(late.column(1), late.column(2), late.column(3))
            for k, i, s, t in zip(*(c.to_pylist() for c in b.filter(pc.equal(b.column(3), 0)).select(["key", "id", "start", "text"]).columns), strict=True):
                if held.bytes >= limit and k != last:
                    yield from work()
                held.add(k, t, (i, s))
                last = k
        if held.first:
            yield from work()

    return run


# --- results ------------------------------------------------------------------------------------


def union_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the spans."""
    o = np.argsort(start, kind="stable")
    start, end = start[o], np.maximum.accumulate(end[o])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:], len(start)) - 1]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of one partition by document, as packed maximal runs."""
    schema = pa.schema([("id", pa.int64()), ("spans", pa.binary())])
    cols = [[b.column(k).to_numpy() for b in batches_] for batches_ in [list(batches)] for k in range(3)]
    ids, start, size = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)
    o = np.lexsort((start, ids))
    ids, start, end = ids[o], start[o], (start + size)[o]
    first, _ = runs(ids)
    out = []
    for i, j in spans_of(first, len(ids)):
        out.append(np.stack(union_spans(start[i:j], end[i:j]), 1).tobytes())
    yield batch(schema, ids[first], out)


def _keeper(with_text: bool):
    """The documents without their removed runs, or digests of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_bytes(b.column(1))
            raw = data.tobytes()
            base, rows = b.column(3).to_numpy(), []
            for k, spans in enumerate(b.column(2)):
                text, cut = raw[off[k] : off[k + 1]], np.frombuffer(spans.as_py() or b"", np.int64).reshape(-1, 2)
                cut = cut[cut[:, 0] // VERSION == base[k] // VERSION] - base[k]
                if len(cut):
                    edges = [0, *cut.ravel().tolist(), len(text)]
                    kept = b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
                else:
                    kept = text
                rows.append((len(text), len(text) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None, cut.ravel().tolist() if with_text else None))
            n, r, s, sha, text, cut = zip(*rows, strict=True) if rows else [()] * 6
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(sha, pa.string())]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols += [pa.array(text, pa.string()), pa.array(cut, pa.list_(pa.int64()))]
                names += ["kept_text", "removed"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, with_text: bool = False) -> DataFrame:
    """-> id, n_bytes, n_removed, n_spans, kept_sha256 (with_text: also kept_text and removed, flat [start, end) pairs).

    Removes each byte covered by a string of ``length`` bytes that also starts earlier: in a smaller id, or before in
    the same document. Strings are judged on the input.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    texts, repeats = with_versions(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null"))
    place = np.int64 if repeats else np.uint32
    n_parts = min(60_000, 4 * partitions(spark))
    blocks = texts.mapInArrow(tidy(_mapper(length, n_parts, place)), "part int, blob binary")
    found = materialize(blocks.repartition(F.pmod("part", F.lit(n_parts))).mapInArrow(tidy(_reducer(length, place)), "kind int, key long, id long, start long, size long"))
    mixed = found.filter("kind = 1")
    alone = F.sum((F.col("size") - length + 1) * length)  # bytes of the strings, each by itself
    hot = mixed.groupBy("key").agg(F.sum("size").alias("bytes"), alone.alias("alone")).filter(F.col("bytes") > HOT_BYTES)
    hot = materialize(hot.select("key", F.greatest(F.ceil(F.col("alone") / HOT_BYTES), F.lit(2)).cast("int").alias("parts")))
    if hot.count() <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    asked = mixed.join(hot, "key", "left").groupBy("id").agg(F.collect_list(F.struct("key", "start", "size", F.coalesce("parts", F.lit(1)).alias("parts"))).alias("want"))
    cut = texts.join(asked, "id").select("id", "text", "base", "want").mapInArrow(tidy(_cutter(length)), "key long, id long, start long, size long, text binary")
    late = cut.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_expander(length)), "kind int, key long, id long, start long, size long")
    spans = found.filter("kind = 0").select("id", "start", "size").unionByName(late.select("id", "start", "size"))
    merged = materialize(spans.repartition("id").mapInArrow(tidy(_merge), "id long, spans binary"))
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string, removed array<long>" if with_text else "")
    out = texts.join(merged, "id", "left").select("id", "text", "spans", "base").mapInArrow(tidy(_keeper(with_text)), schema)
    return out.withColumnRenamed("id", id_col)
