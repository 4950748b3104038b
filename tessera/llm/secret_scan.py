"""Secret scan: three patterns, and a battery of randomness tests with false-discovery control.

**Patterns**: an assignment to a password-like name, an access key, and a long lower-case hexadecimal run; leftmost
matches of each kind that don't overlap, then those of enough characters.

**Battery**. A candidate is a maximal run of at least ``least`` of A-Z a-z 0-9 + / _ -, whose encoding is the smallest
alphabet (ENCODINGS) that holds it. Three statistics look at it as symbols of that alphabet:

* chi-squared of the symbols' counts against uniform ones,
* the number of runs of symbols of a class (digits, capitals, small letters, signs; of an alphabet with one class, its halves),
* the correlation of each symbol's number with the next one's.

Under randomness their means and deviations are known; a candidate with one of them more than RANDOM_Z deviations off isn't
random. Against it stands ordinary text: the symbols' and pairs' counts of all texts, restricted to the alphabet, give what
each statistic would be for text of the same length (text in capitals is taken to be like text in small letters), and so three p-values for being that far on the side of randomness:
the mean and variance of chi-squared for multinomial counts, a binomial tail for the runs, Fisher's z for the correlation.
They are combined as by Cauchy, which holds for dependent tests. A short run in letters has no small p-value: it can't be
told from text.

**False discoveries**. Candidates are as many tests as a corpus has runs, and short ones are the most and the weakest. So
each class of lengths (half powers of two) is controlled on its own, by Benjamini and Hochberg's rule at level ``level``
over all candidates of the class in all documents. The rule needs only a histogram: p-values are rounded up to twentieths
of a power of ten, at most BINS of them for each class, whatever the corpus's size.

Cases: null text is empty; every row has a result, also one with a null or repeated id; very long texts are scanned whole;
ties of p-values share their decision; equal texts get equal spans; an empty table gives no rows; other columns don't
matter. Places are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, chunks, class_spans, materialize, text_bytes, tidy

#: In the order in which spans at the same place are listed; the battery's come last.
KINDS = ("assign", "access", "hex", "random")
# letters in either case are ASCII ones only
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SYMBOLS = _DIGITS + _UPPER + _LOWER + "+/_-"
#: Alphabets from the smallest on; an encoding's symbols are numbered in this order.
ENCODINGS: dict[str, str] = {
    "decimal": _DIGITS,
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "lower": _LOWER,
    "upper": _UPPER,
    "base32": "234567" + _UPPER,
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "letters": _UPPER + _LOWER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _DIGITS + _UPPER + _LOWER + "+/",
    "base64url": _DIGITS + _UPPER + _LOWER + "_-",
    "any": _SYMBOLS,
}
_CODE = np.full(256, len(_SYMBOLS), np.uint8)
_CODE[np.frombuffer(_SYMBOLS.encode(), np.uint8)] = np.arange(len(_SYMBOLS))
_N = len(_SYMBOLS)
#: For each encoding the number of each symbol, -1 outside; encodings that hold a symbol as bits.
_NUMBER = {name: np.array([a.find(c) for c in _SYMBOLS]) for name, a in ENCODINGS.items()}
_CLASS = np.array([0] * 10 + [1] * 26 + [2] * 26 + [3] * 4)


def _classes(name: str) -> np.ndarray:
    """The class of each number of an encoding, for the runs."""
    own = _CLASS[[_SYMBOLS.index(c) for c in ENCODINGS[name]]]
    return own if len(np.unique(own)) > 1 else (np.arange(len(own)) >= len(own) // 2).astype(int)


_RUN_CLASS = {name: _classes(name) for name in ENCODINGS}
#: The chance that two random symbols differ in class.
_RANDOM_CHANGE = {name: float(1 - ((np.bincount(c) / len(c)) ** 2).sum()) for name, c in _RUN_CLASS.items()}
_HOLDS = np.array([sum(1 << k for k, a in enumerate(ENCODINGS.values()) if c in a) for c in _SYMBOLS], np.int64)
_HEX = np.zeros(256, dtype=bool)
_HEX[np.frombuffer((_DIGITS + "abcdef").encode(), np.uint8)] = True

LEAST = 16
LEVEL = 0.01
RANDOM_Z = 4.0
STEP, BINS = 20, 1_000


def pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each symbol (or another byte, the last number) is followed by each, in all texts."""
    n = _N + 1
    total = np.zeros(n * n, np.int64)
    for b in batches:
        data, off = text_bytes(b.column(0))
        for i, j in chunks(off):
            code = _CODE[data[off[i] : off[j]]].astype(np.int64)
            pair = code[:-1] * n + code[1:]
            ends = off[i + 1 : j] - off[i] - 1
            total += np.bincount(pair, minlength=n * n)
            total -= np.bincount(pair[ends[(ends >= 0) & (ends < len(pair))]], minlength=n * n)  # no pair crosses texts
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "n"])


@dataclass(frozen=True)
class TextModel:
    """What text restricted to an alphabet is like: sums of powers of the symbols' shares, chance to change halves, correlation."""

    size: int
    s2: float
    s3: float
    change: float
    correlation: float


def text_models(pairs: np.ndarray) -> dict[str, TextModel]:
    """By encoding, from the counts of pairs; every symbol and pair is seen half a time more."""
    out = {}
    small = np.array([_SYMBOLS.find(c.lower()) for c in _SYMBOLS] + [_N])
    folded = np.zeros_like(pairs)
    np.add.at(folded, (small[:, None], small[None, :]), pairs)
    capitals = folded[np.ix_(small, small)]  # as if written in capitals
    as_is = pairs
    for name, alphabet in ENCODINGS.items():
        pairs = capitals if not set(alphabet) & set(_LOWER) and set(alphabet) & set(_UPPER) else as_is
        where = np.array([_SYMBOLS.index(c) for c in alphabet])
        size = len(where)
        share = pairs[where].sum(axis=1) + 0.5
        share = share / share.sum()
        both = pairs[np.ix_(where, where)] + 0.5 * np.outer(share, share)
        both = both / both.sum()
        own = _RUN_CLASS[name]
        v = np.arange(size, dtype=float)
        x, y = both.sum(axis=1), both.sum(axis=0)
        mx, my = x @ v, y @ v
        deviations = math.sqrt(max((x @ (v - mx) ** 2) * (y @ (v - my) ** 2), 1e-300))
        out[name] = TextModel(size, float((share**2).sum()), float((share**3).sum()), float(both[own[:, None] != own].sum()), float((v - mx) @ both @ (v - my) / deviations))
    return out


def _normal_below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


@lru_cache(maxsize=4096)
def _binomial(n: int, p: float) -> np.ndarray:
    """P(X <= k) for k up to n."""
    k = np.arange(n + 1)
    steps = np.concatenate([[0.0], np.log(np.arange(1, n + 1))]).cumsum()
    p = min(max(p, 1e-12), 1 - 1e-12)
    return np.minimum(np.exp(steps[n] - steps[k] - steps[n - k] + k * math.log(p) + (n - k) * math.log1p(-p)).cumsum(), 1.0)


def _changes(n: int, k: int, p: float, random: float) -> float:
    """P(k changes of n, or further to the side of random) if p is each one's chance; exact up to 4096."""
    if n > 4096:
        z = (k - n * p) / math.sqrt(n * p * (1 - p))
        return _normal_below(-z if p < random else z)
    if p >= random:
        return float(_binomial(n, p)[k])
    return float(_binomial(n, 1 - p)[n - k])  # the upper tail as the lower one of the other side, which keeps small values


def battery(codes: np.ndarray, models: dict[str, TextModel]) -> float:
    """The p-value of a run of symbols for being text, 1 if it isn't random either."""
    holds = int(np.bitwise_and.reduce(_HOLDS[codes]))
    name = list(ENCODINGS)[(holds & -holds).bit_length() - 1]
    m, v, n = models[name], _NUMBER[name][codes], len(codes)
    size = m.size
    squares = int((np.bincount(v, minlength=size) ** 2).sum())
    chi = size * squares / n - n
    own = _RUN_CLASS[name][v]
    changes = int((own[1:] != own[:-1]).sum())
    x = v - v.mean()
    spread_ = float(x @ x)
    r = float(x[1:] @ x[:-1]) / spread_ if spread_ else 1.0
    # as random symbols
    chance = _RANDOM_CHANGE[name]
    off = max(
        abs(chi - (size - 1)) / math.sqrt(2 * (size - 1) * (1 - 1 / n)),
        abs(changes - (n - 1) * chance) / math.sqrt((n - 1) * chance * (1 - chance)),
        abs(r + 1 / n) * math.sqrt(n),
    )
    if off > RANDOM_Z:
        return 1.0
    # as text
    mean = size * (1 + (n - 1) * m.s2) - n
    variance = (size / n) ** 2 * 2 * n * (n - 1) * (m.s2 + 2 * (n - 2) * m.s3 - (2 * n - 3) * m.s2**2)
    p = [1.0, 1.0, 1.0]
    if mean > size - 1 and variance > 0:
        p[0] = _normal_below((chi - mean) / math.sqrt(variance))
    p[1] = _changes(n - 1, changes, m.change, chance)
    if n > 4 and abs(m.correlation) > 0.05:
        z = (math.atanh(min(max(r, -0.999999), 0.999999)) - math.atanh(min(max(m.correlation, -0.999999), 0.999999))) * math.sqrt(n - 3)
        p[2] = _normal_below(z if m.correlation > 0 else -z)
    return cauchy(p)


def cauchy(p: list[float]) -> float:
    """The combined p-value of tests that may depend on each other."""
    total = 0.0
    for x in p:
        x = min(x, 0.99)
        total += 1 / (x * math.pi) if x < 1e-15 else math.tan((0.5 - x) * math.pi)
    total /= len(p)
    return 1 / (total * math.pi) if total > 1e15 else 0.5 - math.atan(total) / math.pi


def length_class(n: int) -> int:
    """The number of half powers of two in n."""
    return (n * n).bit_length() - 1


def p_bin(p: float) -> int:
    """The largest b with p <= 10 ** (-b / STEP)."""
    return min(int(-math.log10(p) * STEP), BINS) if p > 0 else BINS


def discoveries(counts: dict[tuple[int, int], int], level: float) -> dict[int, int]:
    """(length class, bin) -> candidates; to each class's least bin that Benjamini and Hochberg's rule takes, if any."""
    out: dict[int, int] = {}
    for c in {c for c, _ in counts}:
        own = sorted(((b, n) for (k, b), n in counts.items() if k == c), reverse=True)
        total, seen = sum(n for _, n in own), 0
        for b, n in own:
            seen += n
            if 10 ** (-b / STEP) <= level * seen / total:
                out[c] = b
    return out


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_RUN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("class", pa.int32()), ("bin", pa.int32())]))


def _patterns(text: str, lower: bytes) -> list[tuple[int, int, int]]:
    """Assignments and access keys."""
    out = []
    if any(k in lower for k in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    if b"akia" in lower:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out


def _runs(inside: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, end, row = class_spans(inside, off)
    long_ = end - start >= least
    return start[long_], end[long_], row[long_]


def _scanner(models: dict[str, TextModel], least: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_bytes(b.column(1))
            texts = b.column(1)
            found: list[list] = []
            runs: list[list] = []
            for i, j in chunks(off):
                part, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
                spans: list[list] = [[] for _ in range(j - i)]
                tests: list[list] = [[] for _ in range(j - i)]
                # a place in bytes is one in code points less the bytes within characters before it
                places = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                where = lambda byte, row, places=places, at=at: int(places[byte] - places[at[row]])
                for s, e, r in zip(*_runs(_HEX[part], at, LEAST_HEX), strict=True):
                    spans[r].append((where(s, r), 2, where(e, r)))
                code = _CODE[part]
                for s, e, r in zip(*_runs(code < _N, at, least), strict=True):
                    tests[r].append((where(s, r), where(e, r), length_class(int(e - s)), p_bin(battery(code[s:e], models))))
                lower = part.tobytes().lower()
                for r in range(j - i):
                    if at[r + 1] > at[r]:
                        own = lower[at[r] : at[r + 1]]
                        if any(k in own for k in _NAMES) or b"akia" in own:
                            spans[r] = sorted(spans[r] + _patterns(texts[i + r].as_py(), own))
                found += spans
                runs += tests
            as_rows = lambda rows, names: [[dict(zip(names, x, strict=True)) for x in r] for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(as_rows(found, ("start", "kind", "end")), _SPAN), pa.array(as_rows(runs, ("start", "end", "class", "bin")), _RUN)], names=["id", "base", "runs"])

    return scan


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, level: float = LEVEL) -> DataFrame:
    """-> id, base and spans: arrays of (start, kind, end) in order, kind a number of KINDS; spans has the battery's too."""
    spark = docs.sparkSession
    bound_batches(spark)
    text = F.col(f"`{text_col}`").alias("text")
    pairs = np.zeros((_N + 1) ** 2, np.int64)
    for r in docs.select(text).mapInArrow(tidy(pair_counts), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most (symbols + 1) ** 2 rows
        pairs[r["pair"]] = r["n"]
    models = text_models(pairs.reshape(_N + 1, _N + 1).astype(float))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, base array<struct<start:int,kind:int,end:int>>, runs array<struct<start:int,end:int,class:int,bin:int>>"
    scanned = materialize(docs.select(F.col(f"`{id_col}`").alias("id"), text).mapInArrow(tidy(_scanner(models, least)), schema))
    tests = scanned.select(F.explode("runs").alias("r")).groupBy("r.class", "r.bin").count()
    counts = {(r["class"], r["bin"]): r["count"] for r in tests.collect()}  # at most 62 (BINS + 1) rows
    taken = discoveries(counts, level)
    bound = F.create_map(*[F.lit(x) for item in ({0: BINS + 1} | taken).items() for x in item])
    found = F.filter("runs", lambda r: r["bin"] >= F.coalesce(F.try_element_at(bound, r["class"]), F.lit(BINS + 1)))
    more = F.transform(found, lambda r: F.struct(r["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), r["end"].alias("end")))
    return scanned.select(F.col("id").alias(id_col), "base", F.array_sort(F.concat("base", more)).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return scan_secrets(docs, id_col, text_col).select(id_col, *[n(k) for k in KINDS], F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
