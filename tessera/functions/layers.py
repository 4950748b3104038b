"""Dense and one-dimensional convolution layers, parameter files, and the key-phrase scorer built on them."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field

import numpy as np


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


class Params:
    """Named arrays, with scopes; every one has to be taken."""

    def __init__(self, arrays: dict[str, np.ndarray], scope: str = ""):
        self.arrays, self.scope = arrays, scope

    @classmethod
    def load(cls, path: str) -> Params:
        with np.load(path) as f:
            return cls({k: f[k] for k in f.files})

    def save(self, path: str) -> None:
        np.savez(path, **self.arrays)

    def to_bytes(self) -> bytes:
        """All arrays flattened: their number, then each one's name, shape and entries of single precision.

        Numbers are of 64 bits, little-endian; names, shapes and entries have their lengths before them.
        """
        out = [struct.pack("<Q", len(self.arrays))]
        for name, a in self.arrays.items():
            key = name.encode()
            out += [struct.pack("<Q", len(key)), key, struct.pack(f"<Q{a.ndim}Q", a.ndim, *a.shape), struct.pack("<Q", a.size), np.ascontiguousarray(a, "<f4").tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> Params:
        """Of flattened arrays; one whose entries aren't as many as its shape asks for is an error, and so is anything left over."""
        at, arrays = 0, {}

        def take(size: int) -> bytes:
            nonlocal at
            if size > len(data) - at:
                raise ValueError(f"{size} bytes expected, {len(data) - at} are left")
            at += size
            return data[at - size : at]

        number = lambda: struct.unpack("<Q", take(8))[0]
        for _ in range(number()):
            name = take(number()).decode()
            shape = [number() for _ in range(number())]
            size, expected = number(), math.prod(shape)
            if size != expected:
                raise ValueError(f"{name} has {size} entries, its shape {shape} asks for {expected}")
            if name in arrays:
                raise ValueError(f"{name} is there twice")
            arrays[name] = np.frombuffer(take(4 * size), "<f4").astype(float).reshape(shape)
        if at != len(data):
            raise ValueError(f"{len(data) - at} bytes are left over")
        return cls(arrays)

    def with_scope(self, name: str) -> Params:
        return Params(self.arrays, f"{self.scope}{name}/")

    def take(self, name: str, dimensions: int) -> np.ndarray:
        key = self.scope + name
        if key not in self.arrays:
            raise KeyError(f"parameter missing: {key}")
        a = self.arrays.pop(key)
        if a.ndim != dimensions:
            raise ValueError(f"{key} has {a.ndim} dimensions, not {dimensions}")
        return a

    def insert(self, name: str, value: np.ndarray) -> None:
        self.arrays[self.scope + name] = value

    def check_empty(self) -> None:
        if self.arrays:
            raise ValueError(f"parameters left over: {sorted(self.arrays)}")


def _finite(*arrays: np.ndarray) -> None:
    if not all(np.isfinite(a).all() for a in arrays):
        raise ValueError("parameters must be finite")


@dataclass
class Dense:
    weights: np.ndarray
    bias: np.ndarray
    activation: object = relu

    def __post_init__(self) -> None:
        if self.weights.ndim != 2 or self.bias.shape != self.weights.shape[1:]:
            raise ValueError("weights [in, out] and bias [out] don't fit")
        _finite(self.weights, self.bias)

    def run(self, x: np.ndarray) -> np.ndarray:
        return self.activation(x @ self.weights + self.bias)


@dataclass
class Conv1D:
    """weights [channels out, channels in, kernel]; without padding, dilation and groups."""

    weights: np.ndarray
    bias: np.ndarray
    activation: object = relu
    stride: int = 1

    def __post_init__(self) -> None:
        if self.weights.ndim != 3 or self.bias.shape != self.weights.shape[:1] or self.stride < 1:
            raise ValueError("weights [out, in, kernel] and bias [out] don't fit")
        _finite(self.weights, self.bias)

    def run(self, x: np.ndarray) -> np.ndarray:
        """[channels in, n] -> [channels out, (n - kernel) // stride + 1]."""
        k = self.weights.shape[2]
        if x.shape[0] != self.weights.shape[1] or x.shape[1] < k:
            raise ValueError("the input doesn't fit the kernel")
        windows = np.lib.stride_tricks.sliding_window_view(x, k, axis=1)[:, :: self.stride]
        return self.activation(np.einsum("oik,ink->on", self.weights, windows) + self.bias[:, None])


@dataclass
class PhraseScorer:
    """Scores of all runs of 1..5 words: one convolution for each length over the words' embeddings, then one dense layer."""

    convolutions: list[Conv1D]
    classifier: Dense
    lengths: tuple[int, ...] = field(default=(1, 2, 3, 4, 5))

    def scores(self, words: np.ndarray) -> np.ndarray:
        """[words, size] -> one score for each run, by length and position."""
        if len(words) < max(self.lengths):
            raise ValueError("not enough words")
        features = np.concatenate([c.run(words.T).T for c in self.convolutions])
        return self.classifier.run(features)[:, 0]

    @classmethod
    def random(cls, size: int, channels: int = 16, seed: int = 0) -> PhraseScorer:
        rng = np.random.default_rng(seed)
        conv = [Conv1D(rng.standard_normal((channels, size, k)) / np.sqrt(size * k), np.zeros(channels)) for k in (1, 2, 3, 4, 5)]
        return cls(conv, Dense(rng.standard_normal((channels, 1)), np.zeros(1), activation=lambda x: x))
