"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation that balances binary codes is learned on a bounded sample (``sample``): principal axes, then alternately the
codes of the rotated sample and the rotation that fits them best. Every vector gets ``tables`` substrings of bits or more
(from several rotations where one has too few), as many as it takes for pairs at the threshold to be missed with a
probability of at most MISS, which is measured on the sample; substrings get shorter where MOST_TABLES of them don't do,
down to one bit, which compares all pairs (``exact``). Two vectors meet if some substring differs in at most one bit. Of
such substrings one half is equal, so a code goes to one bucket for each half of each substring.

Codes and ids alone travel to the buckets, which tell the vectors that have a partner there within the Hamming radius
of FAR of the sample's pairs at the threshold. Only those vectors follow to rerank: cosines in double precision, a pair
counted where its first substring qualifies, so that it counts once. A bucket with many codes is dealt into blocks, a
task for each two of them.

Equal vectors are one entry with a multiplicity. Within a bucket, links are counted and merged into local components;
only these leave it, a row or two for each vector, never pairs.

Cases: vectors that are null, zero or hold null or non-finite components link with nothing, not even equal ones;
vectors of different lengths don't link; equal vectors all link; rows with a null id are left out; repeated ids are
vectors of their own in the counts and share a row (the largest number of links, the smallest component); floats are
compared as floats, all other numbers as doubles; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, join_keys, materialize, runs, spans_of
from .components import connected_components

TABLES = 6
MOST_TABLES = 64
ROWS = 256
#: Bound of the share of pairs at the threshold that no substring brings together, and the pairs it is measured on.
MISS = 0.01
PAIRS = 4000
#: Share of such pairs beyond the Hamming radius; codes of a bucket in one block; hot buckets that are broadcast.
FAR = 0.001
BLOCK = 8_000
BROADCAST_KEYS = 1_000_000


def learn_rotation(x: np.ndarray, bits: int, seed: int, rounds: int = 30) -> np.ndarray:
    """[dimension, bits]: the axes whose signs are the code."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    bits = min(bits, d)
    _, vectors = np.linalg.eigh(x.T @ x)
    w = vectors[:, ::-1][:, :bits]
    v = x @ w
    r, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
    for _ in range(rounds):
        u, _, t = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ t).T
    return w @ r


def pairs_at(x: np.ndarray, cosine: float, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the sample and partners at a cosine, away in random directions and in those of the sample's differences."""
    rng = np.random.default_rng(seed)
    a = x[rng.integers(len(x), size=PAIRS)]
    out = []
    for u in (rng.standard_normal(a.shape), x[rng.integers(len(x), size=PAIRS)] - x[rng.integers(len(x), size=PAIRS)]):
        u = u - np.einsum("ij,ij->i", u, a)[:, None] * a
        size = np.linalg.norm(u, axis=1)
        some = size > 1e-6
        out.append((a[some], cosine * a[some] + math.sqrt(max(0.0, 1 - cosine * cosine)) * u[some] / size[some, None]))
    return out[0], out[1]


class Coder:
    """Normalised, centred vectors to substrings of bits; ``miss`` bounds the share of pairs at the cosine that share none."""

    def __init__(self, sample: np.ndarray, width: int, tables: int = TABLES, cosine: float = 0.9):
        sample = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.mean = sample.mean(axis=0)
        pairs = [p for p in pairs_at(sample, cosine) if len(p[0])]
        while True:
            axes, seed, most, self.width, self.tables = [], 0, tables, width, tables
            while True:
                while sum(a.shape[1] for a in axes) < width * most:
                    axes.append(learn_rotation(sample - self.mean, width * tables, seed))
                    seed += 1
                self.tables = most
                self.axes = np.concatenate(axes, axis=1)[:, : width * most]
                missed = self._missed(pairs)
                if missed[-1] <= MISS or most >= MOST_TABLES:
                    break
                most = min(MOST_TABLES, most + tables)
            if missed[-1] <= MISS or width == 1:
                break
            width -= 1
        self.tables = max(min(tables, most), int(np.argmax(missed <= MISS)) + 1)
        self.axes, self.miss = self.axes[:, : width * self.tables], float(missed[self.tables - 1])
        far = [np.bitwise_count(self.encode(a) ^ self.encode(b)).sum(axis=1) for a, b in pairs]
        self.radius = width * self.tables if width == 1 or not far else max(int(np.quantile(x, 1 - FAR, method="higher")) for x in far) + 1

    def _missed(self, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The share of pairs missed by the first table, by the first two, and so on, and three standard errors; the worst kind's."""
        out = np.zeros(self.tables)
        for a, b in pairs:
            met = np.logical_or.accumulate(_popcount_le1(self.encode(a) ^ self.encode(b)), axis=1)
            miss = 1 - met.mean(axis=0)
            out = np.maximum(out, miss + 3 * np.sqrt(miss * (1 - miss) / len(a)))
        return out

    def encode(self, x: np.ndarray) -> np.ndarray:
        signs = ((x - self.mean) @ self.axes >= 0).reshape(len(x), self.tables, self.width)
        return (signs << np.arange(self.width)).sum(axis=2).astype(self.kind)

    @property
    def kind(self) -> type:
        return np.uint16 if self.width <= 16 else np.uint32


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # neither squares overflow nor underflow
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _coded(coder: Coder, dim: int):
    """Codes of vectors, and the keys of the buckets they go to: table, half and what that half is."""
    schema = pa.schema([("rep", pa.int64()), ("codes", pa.binary()), ("keys", pa.list_(pa.int64()))])
    low = coder.width // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            codes = coder.encode(_unit(x))
            wide = codes.astype(np.int64)
            keys = np.stack([(np.int64(2 * t + side) << 32) | half for t in range(coder.tables) for side, half in ((0, wide[:, t] >> low), (1, wide[:, t] & ((1 << low) - 1)))], axis=1)
            rows, n = keys.shape
            listed = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * n), pa.array(keys.ravel()))
            yield batch(schema, b.column(0), [c.tobytes() for c in codes], listed)

    return run


def _popcount_le1(x: np.ndarray) -> np.ndarray:
    return x & (x - x.dtype.type(1)) == 0


def _meetings(key: int, block: np.ndarray, codes: np.ndarray, low: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and marks of the pairs of a bucket that count here: within the radius, met in no earlier table.

    Where the rows are of two blocks, only pairs across them.
    """
    table, side = key >> 33, (key >> 32) & 1
    other = codes[:, table] & ((1 << low) - 1) if side == 0 else codes[:, table] >> low
    words = np.zeros((len(codes), -(-codes.shape[1] * codes.itemsize // 8) * 8 // codes.itemsize), codes.dtype)
    words[:, : codes.shape[1]] = codes
    words = words.view(np.uint64)
    across = block.min() != block.max()
    order = np.argsort(other, kind="stable")
    starts, _ = runs(other[order])
    place = {int(other[order[s]]): (s, e) for s, e in spans_of(starts, len(order))}
    for c, (s, e) in place.items():
        mates = [place[c ^ (1 << j)] for j in range(32) if c < c ^ (1 << j) and c ^ (1 << j) in place]
        spans = ([(s, e)] if side == 0 else []) + mates
        if not spans:
            continue
        cols = np.concatenate([order[a:z] for a, z in spans])
        for i in range(s, e, ROWS):
            rows = order[i : min(i + ROWS, e)]
            far = np.zeros((len(rows), len(cols)), np.uint16)
            for w in range(words.shape[1]):
                far += np.bitwise_count(words[rows, w][:, None] ^ words[cols, w][None, :])
            hit = far <= radius
            if side == 0:  # equal substrings: each pair once
                hit[:, : e - s] &= np.arange(e - s)[None, :] > np.arange(i - s, i - s + len(rows))[:, None]
            if across:
                hit &= block[rows][:, None] != block[cols][None, :]
            x, y = np.nonzero(hit)
            for t in range(table):
                if not len(x):
                    break
                late = ~_popcount_le1(codes[rows[x], t] ^ codes[cols[y], t])
                x, y = x[late], y[late]
            if len(x):
                hit[:] = False
                hit[x, y] = True
                a, b = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
                yield rows[a], cols[b], hit[np.ix_(a, b)]


def _groups(batches: Iterator[pa.RecordBatch], coder: Coder) -> Iterator[tuple[pa.Table, int, np.ndarray, np.ndarray, np.ndarray]]:
    """The table of a partition; and key, rows, blocks and codes of each two blocks of a bucket."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    key, i, j, block = (t.column(c).to_numpy() for c in ("key", "i", "j", "block"))
    codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), coder.kind).reshape(-1, coder.tables)
    order = np.lexsort((j, i, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (i[order][1:] != i[order][:-1]) | (j[order][1:] != j[order][:-1])
    for s, e in spans_of(np.flatnonzero(new), len(order)):
        if e - s > 1:
            at = order[s:e]
            yield t, int(key[at[0]]), at, block[at], codes[at]


def _partnered(coder: Coder):
    """The rows that meet another in their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, key, at, block, codes in _groups(batches, coder):
            met = np.zeros(len(at), bool)
            for rows, cols, _ in _meetings(key, block, codes, coder.width // 2, coder.radius):
                met[rows] = met[cols] = True
            yield from t.take(pa.array(at[met])).combine_chunks().to_batches()

    return run


def _linked(coder: Coder, dim: int, threshold: float):
    """Weighted links of each vector of a bucket, and its local component, over the pairs that count here."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, key, at, block, codes in _groups(batches, coder):
            own = t.take(pa.array(at)).combine_chunks()
            rep, mult = own.column("rep").to_numpy(), own.column("mult").to_numpy().astype(float)
            unit = _unit(own.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            links, label = np.zeros(len(at)), np.arange(len(at))
            for rows, cols, hit in _meetings(key, block, codes, coder.width // 2, coder.radius):
                hit &= unit[rows] @ unit[cols].T >= threshold
                links[rows] += hit @ mult[cols]
                links[cols] += mult[rows] @ hit
                for k in np.flatnonzero(hit.any(axis=1)):
                    some = label[cols[hit[k]]]
                    if (some != label[rows[k]]).any():
                        merge = np.unique(np.append(some, label[rows[k]]))
                        label[np.isin(label, merge)] = merge[0]
            some = np.flatnonzero(links > 0)
            yield batch(schema, rep[some], rep[label[some]], links[some].astype(np.int64))

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (key, rep, codes) for the pairs of blocks of their bucket: i <= j, block: the row's own."""
    sizes = rows.groupBy("key").count().filter(F.col("count") > BLOCK)
    hot = materialize(sizes.select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    if hot.count() <= BROADCAST_KEYS:
        hot = F.broadcast(hot)
    blocks = F.coalesce("blocks", F.lit(1))
    out = rows.join(hot, "key", "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    out = out.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return out.select("key", F.least("block", "_with").alias("i"), F.greatest("block", "_with").alias("j"), "block", "rep", "codes").repartition("key", "i", "j")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, sample: int = 20_000, tables: int = TABLES, width: int | None = None, exact: bool = False) -> DataFrame:
    """-> id, n_links, component_id, kept: one row per id; width: of the substrings at most, else by the number of vectors.

    exact: substrings of one bit, by which all pairs meet, in blocks.
    """
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v")).filter("id is not null")
    fine = F.coalesce(F.size("v") > 0, F.lit(False)) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("v", lambda c: c != 0)
    good = rows.filter(fine)
    # a class of equal vectors has a number of its own, as an id may have several vectors
    classes = materialize(good.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("mult")).withColumn("dim", F.size("v")).withColumn("rep", F.monotonically_increasing_id()))
    place = "key long, i int, j int, block int, rep long, codes binary"
    found = None
    for dim, n in [(r["dim"], r["count"]) for r in classes.groupBy("dim").count().collect()]:  # one row per length of vectors
        own = classes.filter(F.col("dim") == dim)
        part = min(1.0, sample / n)
        chosen = own.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(part * (1 << 30)) + (part == 1)).select("v").toArrow()
        x = chosen.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
        if not len(x):
            x = np.ones((1, dim))
        coder = Coder(x, 1, 1, threshold) if exact else Coder(x, width or min(28, max(6, int(math.log2(n + 1)) - 5)), tables, threshold)
        coded = own.select("rep", "v").mapInArrow(_coded(coder, dim), "rep long, codes binary, keys array<long>")
        asked = materialize(_dealt(coded.select(F.explode("keys").alias("key"), "rep", "codes")).mapInArrow(_partnered(coder), place))
        with_vectors = asked.join(own.select("rep", "mult", "v"), "rep").repartition("key", "i", "j")
        got = with_vectors.mapInArrow(_linked(coder, dim, threshold), "a long, b long, links long")
        found = got if found is None else found.unionByName(got)
    if found is None:
        return rows.groupBy("id").agg(F.lit(0).cast("long").alias("n_links")).select(F.col("id").alias(id_col), "n_links", F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = materialize(found)
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    comps = connected_components(found.select("a", "b")).withColumnRenamed("node", "rep")
    placed = materialize(classes.select("rep", "least", "mult").join(comps, "rep", "left").withColumn("component", F.coalesce("component", "rep")).join(counts, "rep", "left"))
    named = materialize(placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    placed = materialize(join_keys(placed, named, ["component"], F.col("rep"), placed.count()).select("rep", "component_id", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links")))
    # a vector that very many rows have meets its class in several tasks
    own = classes.select("v", F.col("mult").alias("n"), "rep").join(placed, "rep").drop("rep")
    members = join_keys(good, own, ["v"], F.xxhash64("id"), good.count())
    info = members.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("id").distinct().join(info, "id", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
