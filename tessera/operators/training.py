"""Training over stored samples: dense numbers, epochs ordered by a keyed permutation, one job for each epoch.

Samples are stored with numbers from 0 on, in order of their ids. An epoch's order is a permutation of the numbers that is
computed, not sorted: a number's place, and so its batch, follows from the number, the seed and the epoch alone. Barrier
tasks then hold a share of the samples each, in order of batches; batch by batch they exchange their sums of gradients and
take the same step, so that an epoch is one job over one scan, whatever the number of its batches.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .listnet import Controller, ListNet, MiniBatchSgd, _sums, evaluate

_GOLDEN, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
ROUNDS = 6


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = x * _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Permutation:
    """A keyed permutation of the numbers below n, and its inverse.

    A Feistel network permutes the numbers of an even number of bits, fewer than four times n of them; a number that is
    sent beyond n goes on through the network until it is back below.
    """

    n: int
    seed: int = 0
    epoch: int = 0

    def _bits(self) -> int:
        return max(1, (max(self.n - 1, 1).bit_length() + 1) // 2)

    def _keys(self) -> list[np.uint64]:
        base = np.uint64((self.seed * 0x1_0000_0001 + self.epoch) % (1 << 64))
        return list(_scrambled(np.arange(1, ROUNDS + 1, dtype=np.uint64) ^ _scrambled(np.array([base ^ _M2]))))

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = np.asarray(x, np.int64)
        if ((x < 0) | (x >= self.n)).any():
            raise IndexError(f"numbers must be below {self.n}")
        half = np.uint64(self._bits())
        mask = (np.uint64(1) << half) - np.uint64(1)
        keys = self._keys()[::-1] if back else self._keys()
        out, todo = x.astype(np.uint64), np.arange(len(x))
        while len(todo):
            left, right = out[todo] >> half, out[todo] & mask
            for k in keys:
                if back:
                    left, right = right ^ (_scrambled(left ^ k) & mask), left
                else:
                    left, right = right, left ^ (_scrambled(right ^ k) & mask)
            out[todo] = (left << half) | right
            todo = todo[out[todo] >= self.n]
        return out.astype(np.int64)

    def place(self, number: np.ndarray) -> np.ndarray:
        """Where in the epoch a number comes."""
        return self._walk(number, False)

    def number(self, place: np.ndarray) -> np.ndarray:
        """Which number comes at a place."""
        return self._walk(place, True)


# --- stored samples -----------------------------------------------------------------------------


def numbered(rows: DataFrame, key: str, name: str = "number") -> DataFrame:
    """rows with dense numbers from 0 in order of the key: sorted by ranges, whose sizes are counted, one row a range."""
    sorted_ = rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("_k", F.monotonically_increasing_id())
    sorted_ = materialize(sorted_.withColumn("_part", F.shiftright("_k", 33)))
    before, starts = 0, []
    for r in sorted_.groupBy("_part").count().orderBy("_part").collect():  # one row a partition
        starts.append((r["_part"], before))
        before += r["count"]
    placed = sorted_.join(F.broadcast(rows.sparkSession.createDataFrame(starts, "_part long, _before long")), "_part")
    return placed.select(*rows.columns, (F.col("_before") + F.col("_k").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def split_sizes(n: int, evaluation: float) -> tuple[int, int]:
    """How many samples train and how many evaluate; a share that leaves none where it should is an error."""
    if not n:
        raise ValueError("an empty store can't be used for training")
    tiny = float(np.finfo(np.float32).tiny)
    if not 0 <= evaluation <= 1 or 0 < evaluation < tiny:
        raise ValueError(f"no share for evaluation: {evaluation}")
    held = int(np.floor(n * evaluation + 0.5))
    if held == n and evaluation < 1:
        raise ValueError(f"with a share of {evaluation} for evaluation no samples are left for training")
    if not held and evaluation > 0:
        raise ValueError(f"with a share of {evaluation} there are no samples for evaluation")
    return n - held, held


def batch_size_of(size: int, n: int) -> int:
    """0 is one batch of all."""
    if size > n:
        raise ValueError(f"the batch size {size} is larger than the number of samples {n}")
    return size or n


@dataclass(frozen=True)
class SampleStore:
    """Samples by number: a table in the order of its numbers, so that reading some of them reads their row groups only."""

    spark: SparkSession
    path: str
    n: int

    @classmethod
    def write(cls, samples: DataFrame, path: str) -> SampleStore:
        rows = numbered(samples, "sample_id")
        rows.repartitionByRange("number").sortWithinPartitions("number").write.mode("overwrite").parquet(path)
        return cls.open(samples.sparkSession, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SampleStore:
        return cls(spark, path, spark.read.parquet(path).count())

    def rows(self, start: int = 0, end: int | None = None) -> DataFrame:
        """Samples with numbers from start up to end."""
        return self.spark.read.parquet(self.path).filter(F.col("number").between(start, (self.n if end is None else end) - 1))

    def get(self, numbers: list[int]) -> DataFrame:
        """Samples of some numbers; one beyond the store is an error."""
        for k in numbers:
            if not 0 <= k < self.n:
                raise IndexError(f"sample {k} is out of bounds, there are {self.n}")
        return self.spark.read.parquet(self.path).filter(F.col("number").isin([int(k) for k in numbers]))

    def batch(self, k: int, size: int, order: Permutation) -> DataFrame:
        """The samples of a batch of an epoch; past the last whole batch it is empty."""
        numbers = order.number(np.arange(k * size, (k + 1) * size)) if (k + 1) * size <= order.n else []
        return self.get([int(x) for x in numbers])

    def chunks(self, n: int, size: int, batch_size: int = 0) -> list[tuple[int, int]]:
        """The first n samples in stretches of so many, for training apart; stretches without a whole batch are left out."""
        if not size:
            raise ValueError("the chunk size must not be 0")
        own = batch_size_of(batch_size, size)
        found = [(i, min(i + size, n)) for i in range(0, n, size) if min(i + size, n) - i >= own]
        if not found:
            raise ValueError("an empty store can't be used for training")
        return found


def _places(order: Permutation):
    @F.pandas_udf("long")
    def place(number: pd.Series) -> pd.Series:
        return pd.Series(order.place(number.to_numpy()))

    return place


# --- one job an epoch ---------------------------------------------------------------------------


def _pack(x: np.ndarray) -> str:
    return base64.b64encode(x.astype(np.float64).tobytes()).decode()


def _unpack(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), np.float64)


def _epoch(net: ListNet, optimizer: MiniBatchSgd, batches: int, every: int):
    """The task of an epoch: rows (_batch, inputs, target) in order of batches -> batch, cost and, now and then, the network."""
    params = net.params

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import BarrierTaskContext

        context, own = BarrierTaskContext.get(), ListNet(params)
        rest, done, found = None, False, []
        for b in range(batches):
            mine = []
            while True:  # the rows of this batch, which may end within a frame
                if rest is None and not done:
                    rest = next(frames, None)
                    done = rest is None
                if rest is None:
                    break
                now = rest[rest["_batch"] == b]
                if len(now):
                    mine.append(now)
                rest = rest[rest["_batch"] > b]
                if len(rest):
                    break
                rest = None
            x = own.flat().size
            sums = np.zeros(x + 2)
            for f in mine:
                g, cost = own.sums(np.array([np.stack(v) for v in f["inputs"]], float), np.stack(f["target"]).astype(float))
                sums += np.concatenate([g, [cost, len(f)]])
            total = np.sum([_unpack(m) for m in context.allGather(_pack(sums))], axis=0)
            own = optimizer.apply(own, total[:x] / total[-1])
            if context.partitionId() == 0:
                keep = b + 1 == batches or (every and (b + 1) % every == 0)
                found.append((b, total[-2] / total[-1], own.flat().tolist() if keep else None))
        if found:
            yield pd.DataFrame(found, columns=["batch", "cost", "net"])

    return run


def train_by_epochs(samples: DataFrame, n: int, epochs: int = 1, batch_size: int = 32, rate: float = 0.1, seed: int = 0, net: ListNet | None = None, evaluation: DataFrame | None = None, controller: Controller | None = None, optimizer: MiniBatchSgd | None = None, tasks: int | None = None) -> tuple[ListNet, list[float]]:
    """Mini-batch descent over samples numbered from 0 to n - 1; an incomplete last batch of an epoch is dropped.

    tasks run at the same time, at most as many as there are slots; a batch needs no more than a few, as each one's sum of
    gradients goes to all the others.
    """
    spark = samples.sparkSession
    net, controller, optimizer = net or ListNet.random(seed), controller or Controller(), optimizer or MiniBatchSgd(rate)
    size, costs = batch_size_of(batch_size, n), []
    batches = n // size
    tasks = min(tasks or 8, spark.sparkContext.defaultParallelism, size)
    controller.start(net)
    for epoch in range(epochs):
        place = _places(Permutation(n, seed, epoch))
        dealt = samples.select(place("number").alias("_place"), "inputs", "target").withColumn("_batch", F.floor(F.col("_place") / size)).filter(F.col("_batch") < batches)
        shares = dealt.repartition(tasks, F.pmod("_place", F.lit(tasks))).sortWithinPartitions("_place").select("_batch", "inputs", "target")
        every = controller.every if controller.dump else 0
        rows = shares.mapInPandas(_epoch(net, optimizer, batches, every), "batch int, cost double, net array<double>", barrier=True).collect()  # one row a batch, and the networks that are dumped
        for r in sorted(rows, key=lambda r: r["batch"]):
            net = ListNet.of_flat(np.array(r["net"])) if r["net"] is not None else net
            controller.batch_done(epoch, r["batch"], net, r["cost"])
        if evaluation is not None:
            costs.append(evaluate(net, evaluation))
        if not controller.epoch_done(epoch, net, costs[-1] if costs else None):
            break
    return net, costs


def train_by_batches(store: SampleStore, n: int, epochs: int, batch_size: int, rate: float, seed: int = 0) -> ListNet:
    """The same with a job for each batch, whose samples are read by number; for small stores and to compare with."""
    net, optimizer, size = ListNet.random(seed), MiniBatchSgd(rate), batch_size_of(batch_size, n)
    for epoch in range(epochs):
        for b in range(n // size):
            g, _, k = _sums(net, store.batch(b, size, Permutation(n, seed, epoch)))
            net = optimizer.apply(net, g / k)
    return net
