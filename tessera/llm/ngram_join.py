"""N-gram Jaccard join by universe partition: exact set-similarity components of documents.

A document's set holds the hashes of its distinct n-word shingles. The universe of shingles is dealt by hash into
segments, as many as a size band's largest possible difference plus one, so that two similar sets agree on a segment
(pigeonhole). Every set indexes its segment subsets, and for a few segments of each band also the one-deletion
neighbourhoods. A probing set spends the levels its own size asks for: subsets with few elements (the long postings)
are skipped where the band leaves slack, or paid for by probing a neighbourhood (which counts for two). Candidates are
verified by their exact sets.

Nothing expands a group of copies: equal sets are one entry; a subset with many sets is tied to its first set, and only
sets that are still in different components after that, and that sizes and parity bitmaps don't rule out, are paired, in
rounds: each set with its closest partners first, then, with what is left, more of them (``_cross``). The sets outside a
subset's largest component meet all its sets in blocks, a task for each two blocks, so that no subset is one task's work.

Cases: a null id leaves the row out; null, empty or wordless text has the empty set, which links with nothing; repeated
rows and equal sets are linked, rows with the same id and different texts are documents of that id; very long texts are
read whole; an empty table gives no rows; columns other than the id and the text are not read. Thresholds from just
above 0 to below 1 lose nothing. Sets are compared by 64-bit shingle hashes, and two sets are the same if their 64-bit
fingerprints and sizes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, batch, bound_batches, chunks, deal, join_keys, materialize, mix, partitions, runs, spans_of, spread, text_bytes, tidy, unpack, word_hashes
from .components import connected_components

BROADCAST_IDS = 1_000_000
SMALL_GROUP = 8
#: Rounds over the subsets with many sets: so many of the closest partners of each set first, then so many times as many
#: (None: all that are left).
CLOSEST = (2, 8)
#: Sets in a block of a subset: a sixteenth of the subset within these. Smaller subsets are one block, so that nothing is
#: copied for them.
BLOCK = (8192, 65_536)
ANSWERS, ASKS, BOTH = 0, 1, 2
_STEPS = mix(np.arange(1, 65, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of each row's distinct shingles, ordered by row and hash, and the sets' sizes."""
    w, row = word_hashes(data, off)
    rows = len(off) - 1
    words = np.bincount(row, minlength=rows)
    first = np.cumsum(words) - words
    full = np.flatnonzero(np.arange(len(w)) - first[row] + n <= words[row]) if len(w) else np.zeros(0, np.int64)
    h = np.zeros(len(full), U64)
    for k in range(n):
        h += w[full + k] * _STEPS[k]
    r = row[full]
    h = mix(h + U64(n))
    short = np.flatnonzero((words > 0) & (words < n))
    if len(short):
        at, which = spread(first[short], first[short] + words[short])
        s = np.zeros(len(short), U64)
        np.add.at(s, which, w[at] * _STEPS[at - first[short][which]])
        h, r = np.concatenate([h, mix(s + words[short].astype(U64))]), np.concatenate([r, short])
    order = np.argsort(h)
    order = order[np.argsort(r[order].astype(np.uint16), kind="stable")]
    h, r = h[order], r[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return r, h, np.bincount(r, minlength=rows)


class Bands:
    """Size bands, their numbers of segments, and what a set of some size has to probe."""

    def __init__(self, num: int, den: int, ratio: float = 1.4):
        self.num, self.den = num, den
        low = [1]
        while low[-1] < 1 << 40:
            low.append(max(low[-1] + 1, int(np.ceil(low[-1] * max(ratio, 1.05 * den / num)))))
        self.low = np.array(low, np.int64)
        top = self.low[1:] - 1
        self.segments = self.most(top, top * den // num) + 1

    def most(self, a, b):
        """The largest symmetric difference of similar sets of these sizes."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def of(self, size):
        return np.searchsorted(self.low, size, side="right") - 1

    def least_partner(self, size):
        return -(-size * self.num // self.den)

    @staticmethod
    def deletable(m: int) -> int:
        """Segments of a band whose one-deletion neighbourhoods are indexed."""
        return max(1, m // 32)


def _band_rows(band: int, bands: Bands, own: bool, size: np.ndarray, fp: np.ndarray, h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and fingerprints for one band: index rows (bit 1) and probe rows (bit 0). d: each shingle's set."""
    m = int(bands.segments[band])
    p = bands.deletable(m)
    salt = U64((band + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    e = mix(h ^ salt)
    seg = ((e >> U64(40)) * U64(m) >> U64(24)).astype(np.int64)
    value = mix(e + salt)
    flat = d * m + seg
    sums = np.zeros(len(size) * m, U64)
    np.add.at(sums, flat, value)
    counts = np.bincount(flat, minlength=len(sums)).reshape(len(size), m)
    segs = mix(np.arange(1, m + 1, dtype=U64) * U64(0xA0761D6478BD642F) + salt)
    exact = mix(sums.reshape(len(size), m) + segs) & ~U64(3)

    # Levels: every segment costs one, a promoted one counts two, a skipped one none; least is what the size asks for.
    least = bands.most(np.minimum(size, bands.low[band + 1] - 1), size) + 1
    slack = m - least
    usable = counts[:, :p] >= 2
    want = np.clip((counts <= 1).sum(1) - slack, 0, usable.sum(1))
    promoted = usable & (np.cumsum(usable, axis=1) <= want[:, None])
    cost = np.minimum(counts, 250).astype(np.uint8)
    cost[:, :p][promoted] = 255
    order = np.argsort(cost, axis=1, kind="stable")
    skip = np.zeros(counts.shape, dtype=bool)
    np.put_along_axis(skip, order, np.arange(m)[None, :] < (slack + promoted.sum(1))[:, None], axis=1)

    keys, sets = [], []
    who = np.broadcast_to(np.arange(len(size))[:, None], counts.shape)
    if own:
        keys.append((exact | U64(2) | (~skip).astype(U64)).ravel())
        sets.append(who.ravel())
    else:
        keys.append((exact | U64(1))[~skip])
        sets.append(who[~skip])
    near = np.flatnonzero(seg < p)
    pays = promoted[d[near], seg[near]]
    if not own:
        near, pays = near[pays], pays[pays]
    gone = mix(sums[flat[near]] - value[near] + segs[seg[near]]) & ~U64(3)
    keys.append(gone | (U64(2) if own else U64(0)) | pays.astype(U64))
    sets.append(d[near])
    return np.concatenate(keys), fp[np.concatenate(sets)]


def signatures(row: np.ndarray, h: np.ndarray, size: np.ndarray, fp: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """All index and probe rows of some sets."""
    keys, sets = [np.zeros(0, U64)], [np.zeros(0, fp.dtype)]
    at = np.cumsum(size) - size
    band = bands.of(size)
    reach = bands.of(np.maximum(bands.least_partner(size), 1))
    for b in np.unique(np.concatenate([band, reach])):
        if bands.segments[b] < 2:
            continue  # similar sets of these sizes are equal
        for own, which in ((True, (band == b) & (size > 0)), (False, (band > b) & (reach <= b) & (size > 0))):
            rows = np.flatnonzero(which)
            # a slice of the rows at a time bounds the matrix of segments
            step = max(1, 2_000_000 // int(bands.segments[b]))
            for i in range(0, len(rows), step):
                some = rows[i : i + step]
                e, d = spread(at[some], at[some] + size[some])
                k, s = _band_rows(int(b), bands, own, size[some], fp[some], h[e], d)
                keys.append(k)
                sets.append(s)
    return np.concatenate(keys), np.concatenate(sets)


def fingerprints(row: np.ndarray, h: np.ndarray, size: np.ndarray) -> np.ndarray:
    s = np.zeros(len(size), U64)
    np.add.at(s, row, mix(h ^ U64(0x8BB84B93962EACC9)))
    return mix(s + size.astype(U64)).view(np.int64)


def _mapper(n: int, bands: Bands, n_parts: int):
    schema = pa.schema([("part", pa.int32()), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        rows, count = [], 0

        def flush(last: bool = False):
            nonlocal held, rows, count
            if not count or not (last or count >= 600_000):
                return
            key, fp = (np.concatenate(x) if x else np.zeros(0, U64) for x in held)
            blocks = list(deal((key >> U64(40)) % U64(n_parts), n_parts, [key, fp.view(np.int64)])) if len(key) else []
            # documents ride along in blocks of their own, told apart by the sign of the part
            ids, size, f = (np.concatenate(x) for x in zip(*rows, strict=True))
            blocks += [(-1 - p, b) for p, b in deal(mix(ids.view(U64)) % U64(n_parts), n_parts, [ids, size, f])]
            yield batch(schema, [p for p, _ in blocks], [b for _, b in blocks])
            held, rows, count = [[], []], [], 0

        for b in batches:
            data, off = text_bytes(b.column(1))
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in chunks(off):
                row, h, size = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], n)
                fp = fingerprints(row, h, size)
                fresh = np.zeros(len(fp), bool)
                fresh[np.unique(fp, return_index=True)[1]] = True  # copies within a block index once
                key, f = signatures(row[fresh[row]], h[fresh[row]], np.where(fresh, size, 0), fp, bands)
                held[0].append(key)
                held[1].append(f)
                rows.append((ids[i:j], size.astype(np.int64), fp))
                count += len(key) + j - i
                yield from flush()
        yield from flush(True)

    return run


_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64())])


def _pairs_of(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs of one part, and (key, set) of the subsets with many sets."""
    none = np.zeros(0, np.int64)
    k = key >> U64(2)
    order = np.argsort(k)
    k = k[order]
    same = np.zeros(len(k), bool)
    same[1:] = k[1:] == k[:-1]
    same[:-1] |= same[1:]
    order = order[same]
    order = order[np.lexsort((fp[order], key[order] >> U64(2)))]
    k, f, flag = key[order] >> U64(2), fp[order], (key[order] & U64(3)).astype(np.uint8)
    if not len(k):
        return none, none, none, none
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (f[1:] != f[:-1])
    at = np.flatnonzero(new)
    k, f, flag = k[at], f[at], np.bitwise_or.reduceat(flag, at)
    starts, group = runs(k)
    size = np.diff(np.append(starts, len(k)))
    pairs = []
    small = size[group] <= SMALL_GROUP
    for gap in range(1, SMALL_GROUP):
        i = np.flatnonzero(small[:-gap] & (group[:-gap] == group[gap:])) if len(k) > gap else none
        ok = ((flag[i] & 1) & (flag[i + gap] >> 1)) | ((flag[i] >> 1) & (flag[i + gap] & 1))
        i = i[ok > 0]
        pairs.append(np.stack([f[i], f[i + gap]], 1))
    rest = np.flatnonzero(~small & (np.arange(len(k)) != starts[group]))
    pairs.append(np.stack([f[starts[group[rest]]], f[rest]], 1))
    p = np.concatenate(pairs)
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    keep = np.ones(len(p), bool)
    keep[1:] = (p[1:] != p[:-1]).any(1)
    p = p[keep]
    many = np.flatnonzero(~small)
    return p[:, 0], p[:, 1], k[many].astype(np.int64), f[many]


def _reducer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's blocks, together: as much as the shuffle's partitions are wide."""
    blobs: list[bytes] = []
    for b in batches:
        part = b.column(0).to_numpy()
        got = b.column(1)
        blobs += [got[int(i)].as_py() for i in np.flatnonzero(part >= 0)]
        ids, size, fp = unpack((got[int(i)].as_py() for i in np.flatnonzero(part < 0)), [np.int64] * 3)
        yield batch(_FOUND, np.zeros(len(ids), np.int32), ids, size, fp)
    key, fp = unpack(blobs, [U64, np.int64])
    del blobs
    a, b, k, f = _pairs_of(key, fp)
    yield batch(_FOUND, np.full(len(a), 1, np.int32), a, b, np.zeros(len(a), np.int64))
    yield batch(_FOUND, np.full(len(k), 2, np.int32), k, f, np.zeros(len(k), np.int64))


# --- parity bitmaps: a lower bound of the difference of two sets, without their texts ------------


def bitmap(h: np.ndarray) -> bytes:
    """Parity of the hashes that fall on each of about twice as many bits as the set has members."""
    bits = 1 << max(6, int(2 * len(h) - 1).bit_length())
    at = (mix(h ^ U64(0xE7037ED1A0B428DB)) & U64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _fold(m: np.ndarray) -> np.ndarray:
    return m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]


def _matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint64).reshape(len(blobs), -1)


def least_difference(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Differing bits of each pair's bitmaps, the longer one folded: at most the sets' difference."""
    out = np.zeros(len(a), np.int64)
    widths = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    for wa, wb in np.unique(widths, axis=0):
        at = np.flatnonzero((widths == (wa, wb)).all(1))
        x, y = _matrix([a[i] for i in at]), _matrix([b[i] for i in at])
        while x.shape[1] > y.shape[1]:
            x = _fold(x)
        while y.shape[1] > x.shape[1]:
            y = _fold(y)
        out[at] = np.bitwise_count(x ^ y).sum(1)
    return out


def _sketcher(n: int):
    """Texts whose sets are the ones looked for (a repeated id may have other texts too), with the sets' bitmaps."""
    schema = pa.schema([("fp", pa.int64()), ("n", pa.int64()), ("text", pa.string()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_bytes(b.column(2))
            fp, bits = [np.zeros(0, np.int64)], []
            for i, j in chunks(off):
                row, h, size = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], n)
                fp.append(fingerprints(row, h, size))
                at = np.append(0, np.cumsum(size))
                bits += [bitmap(h[at[x] : at[x + 1]]) for x in range(j - i)]
            own = pa.array(np.concatenate(fp) == b.column(0).to_numpy())
            yield batch(schema, b.column(0), b.column(1), b.column(2), bits).filter(own)

    return run


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _sieve(num: int, den: int):
    """Pairs (a, b, na, nb, bits of both) whose bitmaps leave the similarity possible."""
    most = Bands(num, den).most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            a, b, na, nb = (t.column(k).to_numpy() for k in range(4))
            ok = least_difference(t.column(4).to_pylist(), t.column(5).to_pylist()) <= most(na, nb)
            yield batch(_PAIRS, a[ok], b[ok])

    return run


def _folded(blobs: list[bytes], words: int) -> np.ndarray:
    m = _matrix(blobs)
    while m.shape[1] > words:
        m = _fold(m)
    return m


def _partners(num: int, den: int, q: tuple[np.ndarray, ...], m: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, member, gap) of the pairs of other components that sizes and bitmaps leave possible; q, m: comp, n, bits."""
    most = Bands(num, den).most
    width = [np.array([len(x) // 8 for x in side[2]], np.int64) for side in (q, m)]
    for wq in np.unique(width[0]):
        i = np.flatnonzero(width[0] == wq)
        for wm in np.unique(width[1]):
            j = np.flatnonzero(width[1] == wm)
            if num * q[1][i].min() > den * m[1][j].max() or num * m[1][j].min() > den * q[1][i].max():
                continue
            words = int(min(wq, wm))
            x, y = (_folded([side[2][k] for k in at], words) for side, at in ((q, i), (m, j)))
            # a part of the bitmaps differs no more than all of it: most pairs need no further look
            head, top = -(-words // 4), int(most(q[1][i].max(), m[1][j].max()))
            step = max(1, 2_000_000 // (len(j) * words))
            for s in range(0, len(i), step):
                some = i[s : s + step]
                part = np.zeros((len(some), len(j)), np.uint32)
                for w in range(head):
                    part += np.bitwise_count(x[s : s + step, w][:, None] ^ y[:, w][None, :])
                a, b = np.nonzero(part <= top)
                gap = part[a, b].astype(np.int64) + np.bitwise_count(x[s + a, head:] ^ y[b, head:]).sum(1, dtype=np.int64)
                na, nb = q[1][some[a]], m[1][j[b]]
                ok = (gap <= most(na, nb)) & (num * na <= den * nb) & (num * nb <= den * na) & (q[0][some[a]] != m[0][j[b]])
                yield some[a[ok]], j[b[ok]], gap[ok]


#: Pairs that a task of two blocks holds before it keeps the closest ones only, or passes them on.
HELD_PAIRS = 1_000_000


def _closest(found: list[tuple[np.ndarray, ...]], names: np.ndarray, most_each: int) -> tuple[tuple[np.ndarray, ...], bool]:
    """(query, member, gap): each query's closest partners (ties by name), and whether there were more."""
    q, m, gap = (np.concatenate(x) for x in zip(*found, strict=True))
    o = np.lexsort((names[m], gap, q))
    starts, group = runs(q[o])
    near = np.arange(len(o)) - starts[group] < most_each
    o = o[near]
    return (q[o], m[o], gap[o]), not near.all()


def _cross(num: int, den: int, most_each: int | None):
    """Pairs (fingerprints) of the sets of two blocks of a subset, the asking ones with those that answer.

    most_each keeps each asking set's closest partners; a subset where that left some out is named in a row of its own.
    """
    schema = pa.schema([*_PAIRS, ("sig", pa.int64())])

    def passed(found: list, mine: np.ndarray, theirs: np.ndarray) -> Iterator[pa.RecordBatch]:
        for q, m, _ in found:
            x, y = mine[q], theirs[m]
            yield batch(schema, np.minimum(x, y), np.maximum(x, y), pa.nulls(len(x), pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        t = pa.Table.from_batches(held)
        sig, i, j, role, fp, comp, n = (t.column(c).to_numpy() for c in ("sig", "i", "j", "role", "fp", "comp", "n"))
        # one array: from chunks, each take would join all of them again
        bits = t.column("bits").cast(pa.large_binary()).combine_chunks()
        order = np.lexsort((fp, j, i, sig))
        new = np.ones(len(order), bool)
        new[1:] = (sig[order][1:] != sig[order][:-1]) | (i[order][1:] != i[order][:-1]) | (j[order][1:] != j[order][:-1])
        left: set[int] = set()
        for s, e in spans_of(np.flatnonzero(new), len(order)):
            at = order[s:e]
            who = [at[role[at] != ANSWERS], at[role[at] != ASKS]]
            if not len(who[0]) or not len(who[1]):
                continue
            sides = [(comp[w], n[w], bits.take(pa.array(w)).to_pylist()) for w in who]
            mine, theirs = fp[who[0]], fp[who[1]]
            found, size = [], 0
            for part in _partners(num, den, *sides):
                found.append(part)
                size += len(part[0])
                if size < HELD_PAIRS:
                    continue
                if most_each is None:
                    yield from passed(found, mine, theirs)
                    found, size = [], 0
                else:
                    kept, more = _closest(found, theirs, most_each)
                    found, size = [kept], len(kept[0])
                    if more:
                        left.add(int(sig[at[0]]))
            if found and most_each is not None:
                kept, more = _closest(found, theirs, most_each)
                found = [kept]
                if more:
                    left.add(int(sig[at[0]]))
            if found:
                yield from passed(found, mine, theirs)
        yield batch(schema, pa.nulls(len(left), pa.int64()), pa.nulls(len(left), pa.int64()), list(left))

    return run


def _blocks(many: DataFrame, comps: DataFrame, bits: DataFrame) -> DataFrame:
    """many (sig, fp) -> sig, i, j, role, fp, comp, n, bits: what the tasks of two blocks each compare.

    A subset whose sets are all in one component has no rows. Sets outside the largest component ask: in their block i
    they go to every block j, and every set of block j to every block i.
    """
    placed = materialize(many.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("sig", "fp", F.coalesce("component", "fp").alias("comp")), narrow=True)
    sizes = placed.groupBy("sig", "comp").agg(F.count("*").alias("c"))
    open_ = materialize(sizes.groupBy("sig").agg(F.sum("c").alias("n"), F.max_by("comp", "c").alias("main"), F.count("*").alias("comps")).filter("comps > 1"), narrow=True)
    total = open_.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = F.greatest(F.lit(BLOCK[0]), F.least(F.lit(BLOCK[1]), F.col("n") / 16))
    blocks = open_.select("sig", "n", "main", F.ceil(F.col("n") / size).cast("int").alias("blocks"))
    rows = join_keys(placed, blocks, ["sig"], F.xxhash64("fp"), total).drop("n").join(bits, "fp")
    asks = F.col("comp") != F.col("main")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp", "sig"), F.col("blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own"))
    spot = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), role.cast("int").alias("role"))
    spots = F.concat(
        F.array(spot(F.col("own"), F.col("own"), F.when(asks, BOTH).otherwise(ANSWERS))), F.transform(others, lambda x: spot(x, F.col("own"), F.lit(ANSWERS))),
        F.transform(F.when(asks, others).otherwise(F.array().cast("array<int>")), lambda x: spot(F.col("own"), x, F.lit(ASKS))),
    )
    return rows.select("sig", "fp", "comp", "n", "bits", F.explode(spots).alias("s")).select("sig", "s.i", "s.j", "s.role", "fp", "comp", "n", "bits").repartition(partitions(many.sparkSession), "sig", "i", "j")


def _verifier(n: int, num: int, den: int):
    """Links among the pairs, by the exact sets of both texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (b.column(k).to_numpy() for k in (0, 1))
            sets: dict[int, np.ndarray] = {}
            for ids, col in ((a, b.column(2)), (c, b.column(3))):
                some = np.unique(ids, return_index=True)[1]
                some = np.array([i for i in some if int(ids[i]) not in sets], np.int64)
                data, off = text_bytes(col.take(pa.array(some, pa.int64())))
                for i, j in chunks(off):
                    _, h, size = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], n)
                    at = np.append(0, np.cumsum(size))
                    sets.update((int(ids[some[x]]), h[at[x - i] : at[x - i + 1]]) for x in range(i, j))
            ok = np.zeros(len(a), bool)
            for k, (x, y) in enumerate(zip(a, c, strict=True)):
                x, y = sets[int(x)], sets[int(y)]
                inter = len(np.intersect1d(x, y, assume_unique=True))
                ok[k] = den * inter >= num * (len(x) + len(y) - inter)
            yield batch(_PAIRS, a[ok], c[ok])

    return run


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """-> id, n_shingles, component_id: sets link when den * |intersection| >= num * |union|."""
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).filter("_id is not null")
    bands = Bands(num, den)
    n_parts = min(60_000, 4 * partitions(spark))
    blocks = texts.mapInArrow(tidy(_mapper(n, bands, n_parts)), "part int, blob binary")
    found = materialize(blocks.repartition(partitions(spark), F.pmod("part", F.lit(n_parts))).mapInArrow(tidy(_reducer), "kind int, a long, b long, c long"))
    documents = found.filter("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("n"), F.col("c").alias("fp"))
    sets = materialize(documents.filter("n > 0").groupBy("fp", "n").agg(F.min("id").alias("doc"), F.count("*").alias("copies")), narrow=True)
    pairs = found.filter("kind = 1").select("a", "b").distinct()
    many = found.filter("kind = 2").select(F.col("a").alias("sig"), F.col("b").alias("fp"))

    fps = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).unionByName(many.select("fp")).distinct()
    needed = sets.join(fps, "fp", "left_semi")
    if needed.count() <= BROADCAST_IDS:
        needed = F.broadcast(needed)
    some = texts.join(needed, texts["_id"] == needed["doc"]).select("fp", "n", "_text")
    some = materialize(some.mapInArrow(tidy(_sketcher(n)), "fp long, n long, text string, bits binary"))

    def verified(able: DataFrame) -> DataFrame:
        ends = able.select(F.col("a").alias("fp")).unionByName(able.select(F.col("b").alias("fp"))).distinct()
        if ends.count() <= BROADCAST_IDS:
            ends = F.broadcast(ends)
        own = some.join(ends, "fp", "left_semi")
        side = lambda x: own.select(F.col("fp").alias(x), F.col("text").alias(f"t{x}"))
        return materialize(able.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb").mapInArrow(tidy(_verifier(n, num, den)), "a long, b long"))

    side = lambda x: some.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"{den} * least(na, nb) >= {num} * greatest(na, nb)")
    tested = materialize(sized.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(tidy(_sieve(num, den)), "a long, b long"), narrow=True)
    comps = connected_components(verified(tested))
    most_each, bits = CLOSEST[0], some.select("fp", "n", "bits")
    while True:
        cross = materialize(_blocks(many, comps, bits).mapInArrow(tidy(_cross(num, den, most_each)), "a long, b long, sig long"))
        fresh = materialize(cross.filter("sig is null").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), narrow=True)
        more = verified(fresh)
        if more.limit(1).count():
            # what is known goes on as its stars
            comps = connected_components(more.unionByName(comps.filter("node <> component").toDF("a", "b")))
        left = cross.filter("sig is not null").select("sig").distinct()
        if not left.limit(1).count():
            break
        tested = tested.unionByName(fresh)
        many = many.join(left, "sig", "left_semi")
        most_each = None if CLOSEST[1] is None else most_each * CLOSEST[1]

    class_of = materialize(sets.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("class", F.coalesce("component", "fp")), narrow=True)
    least = materialize(class_of.groupBy("class").agg(F.min("doc").alias("component_id"), F.count("*").alias("n")), narrow=True)
    total = sets.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    named = join_keys(class_of.select("class", "fp", F.col("n").alias("size"), "copies"), least, ["class"], F.col("fp"), total)
    named = materialize(named.select("fp", "size", "component_id", F.col("copies").alias("n")), narrow=True)
    plain = documents.filter("n > 0").withColumnRenamed("n", "size")
    out = join_keys(plain, named, ["fp", "size"], F.xxhash64("id"), total).select("id", "size", "component_id")
    none = documents.filter("n = 0").select("id", F.col("n").alias("size"), F.col("id").alias("component_id"))
    return out.unionByName(none).select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id")
