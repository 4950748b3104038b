"""A list-wise ranking network: scores by document, then softmax over groups of ten. Inference, training, federation.

Weights are a few thousand numbers, held by the driver and sent along with the tasks; samples stay distributed, and
gradients are summed per partition before they meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize

# Sizes of the network and of its groups.
N_FEATURES, N_DOCUMENTS, CHUNK = 50, 10, 5
EPSILON32 = np.float64(np.finfo(np.float32).eps)
SHAPES = {"dense1": (N_FEATURES, 48), "dense2": (48, 8), "scores": (8, 1), "prob_dist": (N_DOCUMENTS, N_DOCUMENTS)}


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def kl_divergence(good: np.ndarray, other: np.ndarray) -> float:
    good, other = np.clip(good, EPSILON32, 1), np.clip(other, EPSILON32, 1)
    return float((good * np.log(good / other)).sum())


def he_normal(shape: tuple[int, int], rng: np.random.Generator) -> np.ndarray:
    """Normal with deviation sqrt(2 / inputs), drawn again beyond two deviations."""
    x = rng.standard_normal(shape)
    while (far := np.abs(x) > 2).any():
        x[far] = rng.standard_normal(far.sum())
    return x * np.sqrt(2 / shape[0])


@dataclass
class ListNet:
    """params: "<layer>/weights" [in, out] and "<layer>/bias" [out] for the layers of SHAPES."""

    params: dict[str, np.ndarray]

    def __post_init__(self) -> None:
        left = set(self.params) - {f"{k}/{p}" for k in SHAPES for p in ("weights", "bias")}
        if left:
            raise ValueError(f"parameters left over: {sorted(left)}")
        for k, shape in SHAPES.items():
            for name, want in ((f"{k}/weights", shape), (f"{k}/bias", shape[1:])):
                if name not in self.params:
                    raise ValueError(f"parameter missing: {name}")
                if self.params[name].shape != want:
                    raise ValueError(f"{name} has shape {self.params[name].shape}, not {want}")
                if not np.isfinite(self.params[name]).all():
                    raise ValueError(f"{name} is not finite")

    @classmethod
    def random(cls, seed: int = 0) -> ListNet:
        rng = np.random.default_rng(seed)
        return cls({f"{k}/weights": he_normal(s, rng) for k, s in SHAPES.items()} | {f"{k}/bias": np.zeros(s[1]) for k, s in SHAPES.items()})

    def _layer(self, name: str, x: np.ndarray) -> np.ndarray:
        return x @ self.params[f"{name}/weights"] + self.params[f"{name}/bias"]

    def document_scores(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(self._layer("dense1", x), 0)
        return self._layer("scores", np.maximum(self._layer("dense2", h), 0))[:, 0]

    def group_scores(self, scores: np.ndarray) -> np.ndarray:
        """Of up to ten document scores, the last one repeated to fill the group."""
        full = np.concatenate([scores, np.repeat(scores[-1], N_DOCUMENTS - len(scores))])
        return softmax(self._layer("prob_dist", full))[: len(scores)]

    def run(self, x: np.ndarray) -> np.ndarray:
        """Scores of a request's documents in rank order: the first five are grouped with each five that follow."""
        if x.shape[1] != N_FEATURES:
            raise ValueError(f"{N_FEATURES} features expected, not {x.shape[1]}")
        if not len(x):
            return np.zeros(0)
        s = self.document_scores(x)
        out = [self.group_scores(s[:N_DOCUMENTS])]
        for i in range(N_DOCUMENTS, len(s), CHUNK):
            out.append(self.group_scores(np.concatenate([s[:CHUNK], s[i : i + CHUNK]]))[CHUNK:])
        return np.concatenate(out)

    def gradients(self, x: np.ndarray, target: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Of the divergence from a sample's target, and that divergence."""
        p = self.params
        z1 = self._layer("dense1", x)
        y1 = np.maximum(z1, 0)
        z2 = self._layer("dense2", y1)
        y2 = np.maximum(z2, 0)
        s = self._layer("scores", y2)[:, 0]
        out = softmax(self._layer("prob_dist", s))
        d_out = (out - target) * ((out >= EPSILON32) & (out <= 1))
        d_s = p["prob_dist/weights"] @ d_out
        d2 = (d_s[:, None] @ p["scores/weights"].T) * ~np.signbit(z2)
        d1 = (d2 @ p["dense2/weights"].T) * ~np.signbit(z1)
        g = {
            "prob_dist/weights": np.outer(s, d_out), "prob_dist/bias": d_out,
            "scores/weights": y2.T @ d_s[:, None], "scores/bias": d_s.sum(keepdims=True),
            "dense2/weights": y1.T @ d2, "dense2/bias": d2.sum(axis=0),
            "dense1/weights": x.T @ d1, "dense1/bias": d1.sum(axis=0),
        }
        return g, kl_divergence(target, out)

    def sums(self, x: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
        """Sums of the gradients (flat) and divergences of samples: x [samples, documents, features], target [samples, documents]."""
        p = self.params
        z1 = self._layer("dense1", x)
        y1 = np.maximum(z1, 0)
        z2 = self._layer("dense2", y1)
        y2 = np.maximum(z2, 0)
        s = self._layer("scores", y2)[..., 0]
        out = softmax(self._layer("prob_dist", s))
        d_out = (out - target) * ((out >= EPSILON32) & (out <= 1))
        d_s = d_out @ p["prob_dist/weights"].T
        d2 = (d_s[..., None] * p["scores/weights"][:, 0]) * ~np.signbit(z2)
        d1 = (d2 @ p["dense2/weights"].T) * ~np.signbit(z1)
        wide = lambda a, b: np.tensordot(a, b, axes=(range(a.ndim - 1), range(b.ndim - 1)))
        g = {
            "prob_dist/weights": wide(s, d_out), "prob_dist/bias": d_out.sum(axis=0),
            "scores/weights": wide(y2, d_s[..., None]), "scores/bias": d_s.sum(keepdims=True).reshape(1),
            "dense2/weights": wide(y1, d2), "dense2/bias": d2.sum(axis=(0, 1)),
            "dense1/weights": wide(x, d1), "dense1/bias": d1.sum(axis=(0, 1)),
        }
        return ListNet(g).flat(), kl_divergence(target, out)

    def step(self, gradients: dict[str, np.ndarray], rate: float) -> ListNet:
        return ListNet({k: v - rate * gradients[k] for k, v in self.params.items()})

    def cost(self, x: np.ndarray, target: np.ndarray, cost: Callable[[np.ndarray, np.ndarray], float] = kl_divergence) -> float:
        return cost(target, softmax(self._layer("prob_dist", self.document_scores(x))))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.params[k].ravel() for k in sorted(self.params)])

    @classmethod
    def of_flat(cls, values: np.ndarray) -> ListNet:
        shapes = {f"{k}/weights": s for k, s in SHAPES.items()} | {f"{k}/bias": s[1:] for k, s in SHAPES.items()}
        params, at = {}, 0
        for k in sorted(shapes):
            n = int(np.prod(shapes[k]))
            params[k] = values[at : at + n].reshape(shapes[k])
            at += n
        return cls(params)


def merge_nets(nets: list[ListNet]) -> ListNet | None:
    return ListNet({k: np.mean([n.params[k] for n in nets], axis=0) for k in nets[0].params}) if nets else None


# --- over tables --------------------------------------------------------------------------------


def listnet_scores(features: DataFrame, net: ListNet, keys: list[str]) -> DataFrame:
    """features: keys, rank, features -> keys, rank, ltr_score, joined by rank.

    Document scores are made row by row where the rows are; a group of ten meets by a window over the request.
    """
    params = net.params

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = ListNet(params)
        for b in batches:
            x = np.stack(b["features"]) if len(b) else np.zeros((0, N_FEATURES))
            yield b.drop(columns="features").assign(s=own.document_scores(x))

    kinds = {f.name: f.dataType.simpleString() for f in features.schema}
    rows = features.select(*keys, "rank", "features").mapInPandas(score, ", ".join(f"{c} {kinds[c]}" for c in [*keys, "rank"]) + ", s double")
    lists = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "s"))).alias("l"))

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = ListNet(params)
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                s = np.array(row.s, float)
                g = [own.group_scores(s[:N_DOCUMENTS])] + [own.group_scores(np.concatenate([s[:CHUNK], s[i : i + CHUNK]]))[CHUNK:] for i in range(N_DOCUMENTS, len(s), CHUNK)]
                out.append(np.concatenate(g))
            yield b.drop(columns="s").assign(ltr=out)

    flat = lists.select(*keys, F.col("l.rank").alias("r"), F.col("l.s").alias("s"))
    done = flat.mapInPandas(groups, ", ".join(f"{c} {kinds[c]}" for c in keys) + f", r array<{kinds['rank']}>, ltr array<double>")
    return done.select(*keys, F.explode(F.arrays_zip("r", "ltr")).alias("z")).select(*keys, F.col("z.r").alias("rank"), F.col("z.ltr").alias("ltr_score"))


def prepare_inputs(samples: DataFrame) -> DataFrame:
    """Samples of ten documents: shorter ones are left out, longer ones cut."""
    return samples.filter(F.size("inputs") >= N_DOCUMENTS).withColumn("inputs", F.slice("inputs", 1, N_DOCUMENTS)).withColumn("target", F.slice("target", 1, N_DOCUMENTS))


def split_samples(samples: DataFrame, evaluation: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Training samples and, from the end of sample_id, the share for evaluation."""
    n = samples.count()
    at = n - round(n * evaluation)
    if at >= n:
        return samples, samples.limit(0)
    # ids by ranges, whose sizes are counted: the one at the split is read from its range
    ids = samples.select("sample_id").repartitionByRange("sample_id").sortWithinPartitions("sample_id").withColumn("_k", F.monotonically_increasing_id())
    ids = materialize(ids)
    for r in ids.groupBy(F.shiftright("_k", 33).alias("part")).count().orderBy("part").collect():  # one row a partition
        if at < r["count"]:
            bound = ids.filter(F.col("_k") == (r["part"] << 33) + at).first()["sample_id"]
            break
        at -= r["count"]
    return samples.filter(F.col("sample_id") < bound), samples.filter(F.col("sample_id") >= bound)


def _sums(net: ListNet, samples: DataFrame) -> tuple[np.ndarray, float, int]:
    """Sum of gradients, of costs, and number of samples: one row for each partition meets at the driver."""
    params = net.params

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, total, cost, n = ListNet(params), 0, 0.0, 0
        for b in batches:
            if len(b):
                g, c = own.sums(np.array([np.stack(v) for v in b["inputs"]], float), np.stack(b["target"]).astype(float))
                total, cost, n = total + g, cost + c, n + len(b)
        if n:
            yield pd.DataFrame({"g": [total], "cost": [cost], "n": [n]})

    got = samples.select("inputs", "target").mapInPandas(run, "g array<double>, cost double, n long").collect()
    if not got:
        return np.zeros(0), 0.0, 0
    return np.sum([r["g"] for r in got], axis=0), sum(r["cost"] for r in got), sum(r["n"] for r in got)


def evaluate(net: ListNet, samples: DataFrame) -> float:
    """Mean divergence; NaN without samples."""
    _, cost, n = _sums(net, samples)
    return cost / n if n else float("nan")


@dataclass
class MiniBatchSgd:
    """Steps against the mean gradient of a batch."""

    rate: float = 0.1

    def apply(self, net: ListNet, gradients: np.ndarray) -> ListNet:
        return net.step(ListNet.of_flat(gradients).params, self.rate)


@dataclass
class SampleSource:
    """Batches of samples, dealt anew for each epoch by a hash of their ids; an incomplete last batch is dropped.

    The order of an epoch is made by a sort over all partitions, whose rows are counted, not gathered; it is written, so
    that a batch is a filter over a table and not the plan of the whole order.
    """

    samples: DataFrame
    size: int = 32
    seed: int = 0

    def batches(self, epoch: int) -> Iterator[DataFrame]:
        n = self.samples.count()
        size = self.size or n
        if not n or n < size:
            return
        if n // size == 1:
            yield self.samples
            return
        u = F.xxhash64("sample_id", F.lit(self.seed), F.lit(epoch))
        sorted_ = self.samples.withColumn("_u", u).repartitionByRange("_u", "sample_id").sortWithinPartitions("_u", "sample_id").withColumn("_k", F.monotonically_increasing_id())
        sorted_ = materialize(sorted_.withColumn("_part", F.shiftright("_k", 33)))
        before, starts = 0, []
        for r in sorted_.groupBy("_part").count().orderBy("_part").collect():  # one row a partition
            starts.append((r["_part"], before))
            before += r["count"]
        placed = sorted_.join(F.broadcast(self.samples.sparkSession.createDataFrame(starts, "_part long, _before long")), "_part")
        dealt = materialize(placed.withColumn("_b", F.floor((F.col("_before") + F.col("_k").bitwiseAND(F.lit((1 << 33) - 1))) / size)).drop("_u", "_k", "_part", "_before"))
        for b in range(n // size):
            yield dealt.filter(F.col("_b") == b).drop("_b")


@dataclass
class Controller:
    """What is done around training: tell costs, dump networks every so many batches, stop early."""

    dump: Callable[[str, ListNet], None] | None = None
    every: int = 1
    tell: Callable[[str], None] | None = None

    def start(self, net: ListNet) -> None:
        if self.dump:
            self.dump("initial", net)

    def batch_done(self, epoch: int, batch: int, net: ListNet, mean_cost: float) -> None:
        if self.tell:
            self.tell(f"epoch {epoch} batch {batch}: mean cost {mean_cost:.6g}")
        if self.dump and (batch + 1) % self.every == 0:
            self.dump(f"{epoch}-{batch}", net)

    def epoch_done(self, epoch: int, net: ListNet, evaluation: float | None) -> bool:
        """Whether to go on."""
        if self.tell and evaluation is not None:
            self.tell(f"epoch {epoch}: evaluation cost {evaluation:.6g}")
        return True


def train(samples: DataFrame, epochs: int = 1, batch_size: int = 32, rate: float = 0.1, seed: int = 0, net: ListNet | None = None, evaluation: DataFrame | None = None, controller: Controller | None = None, optimizer: MiniBatchSgd | None = None) -> tuple[ListNet, list[float]]:
    """Mini-batch descent; each epoch deals the samples anew, an incomplete last batch is dropped, 0 takes all at once."""
    net, controller, optimizer = net or ListNet.random(seed), controller or Controller(), optimizer or MiniBatchSgd(rate)
    source, costs = SampleSource(samples, batch_size, seed), []
    controller.start(net)
    for epoch in range(epochs):
        for b, rows in enumerate(source.batches(epoch)):
            g, cost, k = _sums(net, rows)
            if k:
                net = optimizer.apply(net, g / k)
                controller.batch_done(epoch, b, net, cost / k)
        if evaluation is not None:
            costs.append(evaluate(net, evaluation))
        if not controller.epoch_done(epoch, net, costs[-1] if costs else None):
            break
    return net, costs


def _trainer(params: dict[str, np.ndarray], epochs: int, rate: float):
    def of_user(rows: pd.DataFrame) -> pd.DataFrame:
        own = ListNet(params)
        for _ in range(epochs):
            for r in rows.sort_values("sample_id").itertuples(index=False):
                g, _ = own.gradients(np.array([list(v) for v in r.inputs], float), np.asarray(r.target, float))
                own = own.step(g, rate)
        return pd.DataFrame({"net": [own.flat()]})

    return of_user


def train_federated(samples: DataFrame, user_col: str, rounds: int = 1, users: int = 10, epochs: int = 1, rate: float = 0.1, seed: int = 0, net: ListNet | None = None) -> ListNet:
    """Each round, some users train copies of the network on their own samples; their mean is the next network."""
    net = net or ListNet.random(seed)
    for k in range(rounds):
        chosen = samples.select(user_col).distinct().orderBy(F.xxhash64(user_col, F.lit(seed), F.lit(k)), user_col).limit(users)
        nets = samples.join(F.broadcast(chosen), user_col).groupBy(user_col).applyInPandas(_trainer(net.params, epochs, rate), "net array<double>").collect()  # at most ``users`` rows
        net = merge_nets([ListNet.of_flat(np.array(r["net"])) for r in nets]) or net
    return net
