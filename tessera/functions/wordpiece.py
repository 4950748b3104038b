"""WordPiece tokenization with byte offsets into the original text, and pluggable text encoders, as Arrow-batched UDFs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from itertools import chain
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The code point ranges that are isolated as words of their own, and the clean-ups of decoded English, in order.
CJK = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B920, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))
CONTRACTIONS = ((" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"), (" n't", "n't"), (" 'm", "'m"), (" do not", " don't"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re"))
_WHITE = " \t\n\r\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
_CHUNK, _SPACES = re.compile(f"[^{_WHITE}]+"), f"[{_WHITE}]+"
COLUMNS = ("ids", "type_ids", "tokens", "word_indices", "offsets", "special_tokens_mask", "attention_mask")
PART = {"ids": "array<int>", "type_ids": "array<int>", "tokens": "array<string>", "word_indices": "array<int>", "offsets": "array<struct<start:int,end:int>>", "special_tokens_mask": "array<int>", "attention_mask": "array<int>"}
ENCODING = f"{', '.join(f'{k} {t}' for k, t in PART.items())}, overflowing array<struct<{','.join(f'{k}:{t}' for k, t in PART.items())}>>"


def read_vocabulary(lines: Iterable[str]) -> dict[str, int]:
    """One token a line, its id the line's index; of repeated tokens the last counts."""
    vocab = {line.strip(): i for i, line in enumerate(lines)}
    if not vocab:
        raise ValueError("the vocabulary is empty")
    return vocab


@dataclass
class Encoding:
    ids: list[int] = field(default_factory=list)
    type_ids: list[int] = field(default_factory=list)
    tokens: list[str] = field(default_factory=list)
    word_indices: list[int | None] = field(default_factory=list)
    offsets: list[tuple[int, int]] = field(default_factory=list)
    special_tokens_mask: list[int] = field(default_factory=list)
    attention_mask: list[int] = field(default_factory=list)
    overflowing: list[Encoding] = field(default_factory=list)
    #: Where each of several joined sequences lies; one alone has none.
    ranges: list[tuple[int, int]] = field(default_factory=list)

    def add(self, id_: int, token: str, word: int | None, at: tuple[int, int], special: int = 0, attention: int = 1) -> None:
        for column, value in ((self.ids, id_), (self.type_ids, 0), (self.tokens, token), (self.word_indices, word), (self.offsets, at), (self.special_tokens_mask, special), (self.attention_mask, attention)):
            column.append(value)

    def joined(self, other: Encoding, growing_offsets: bool = False) -> Encoding:
        """Both, one behind the other: columns chained, the sequences' ranges moved, and every part with every part of the other.

        growing_offsets: the other's offsets go on from where the last one ends.
        """
        more = (self.offsets[-1][1] if self.offsets else 0) if growing_offsets else 0
        out = Encoding(*(getattr(self, c) + ([(s + more, e + more) for s, e in other.offsets] if c == "offsets" else getattr(other, c)) for c in COLUMNS))
        own = self.ranges or [(0, len(self.ids))]
        out.ranges = own + [(s + len(self.ids), e + len(self.ids)) for s, e in other.ranges or [(0, len(other.ids))]]
        late = [(a, b) for a in self.overflowing for b in (other, *other.overflowing)] + [(self, b) for b in other.overflowing]
        out.overflowing = [a.joined(b, growing_offsets) for a, b in late] or self.overflowing
        return out

    @classmethod
    def merge(cls, encodings: Iterable[Encoding], growing_offsets: bool = False) -> Encoding:
        """Several, one behind the other, from an empty one on."""
        out = cls()
        for e in encodings:
            out = out.joined(e, growing_offsets)
        return out

    def slice(self, i: int, j: int) -> Encoding:
        return Encoding(*(getattr(self, c)[i:j] for c in COLUMNS))


@dataclass
class WordPiece:
    """Normalise, split, look up greedily, truncate, frame with the special tokens, pad."""

    vocab: dict[str, int]
    cleanup: bool = True
    chinese: bool = False
    accents: bool = False
    lowercase: bool = True
    unknown: str = "[UNK]"
    prefix: str = "##"
    max_chars: int = 100
    cls: str = "[CLS]"
    sep: str = "[SEP]"
    pad: str = "[PAD]"
    max_length: int | None = None
    stride: int = 0
    padding: bool = True

    def __post_init__(self) -> None:
        self._known: dict[str, list] = {}
        self._known_ids: dict[str, list[int]] = {}
        self._spaced = _Spaced(self)
        self._longest = max(map(len, self.vocab))
        inner = {t.removeprefix(self.prefix): i for t, i in self.vocab.items() if t.startswith(self.prefix)}
        #: Tokens at a word's beginning and within it, each with the lengths to try by first character.
        self._outer, self._inner = (self.vocab, _lengths(self.vocab)), (inner, _lengths(inner))
        for name in (self.unknown, self.cls, self.sep, *([self.pad] if self.padding else [])):
            if name not in self.vocab:
                raise ValueError(f"the vocabulary lacks {name}")
        if not any(t.startswith(self.prefix) for t in self.vocab):
            raise ValueError(f"no token starts with {self.prefix}")
        if self.max_length is not None and (self.max_length < 2 or self.stride >= max(self.max_length - 2, 1)):
            raise ValueError("the length must leave room for two special tokens and be over the stride")

    def normalise(self, text: str) -> list[tuple[str, int, int]]:
        """(character, start, end) with byte offsets of what it stands for."""
        out, at = [], 0
        for c in text:
            start, at = at, at + len(c.encode("utf-8", "surrogatepass"))
            if self.cleanup:
                if c in "\t\n\r" or unicodedata.category(c) == "Zs":
                    c = " "
                elif c in "\0�" or unicodedata.category(c)[0] == "C":
                    continue
            out.append((c, start, at))
        if self.chinese:
            out = [x for c, s, e in out for x in ([(" ", s, e), (c, s, e), (" ", s, e)] if any(a <= ord(c) <= z for a, z in CJK) else [(c, s, e)])]
        if not self.accents:
            out = [(d, s, e) for c, s, e in out for d in unicodedata.normalize("NFD", c) if unicodedata.category(d) != "Mn"]
        if self.lowercase:
            out = [(d, s, e) for c, s, e in out for d in c.lower()]
        return out

    def words(self, text: str) -> list[list[tuple[str, int, int]]]:
        """Split at white space, which goes, and around punctuation, which stays."""
        words, now = [], []
        for x in self.normalise(text):
            c = x[0]
            punctuation = _punctuation(c)
            if c.isspace() or punctuation:
                if now:
                    words.append(now)
                now = []
                if punctuation:
                    words.append([x])
            else:
                now.append(x)
        return [*words, now] if now else words

    def pieces(self, word: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """The longest known beginning, again and again; one unknown token if some part has none or the word is too long."""
        whole = (self.unknown, word[0][1], word[-1][2])
        if len(word) > self.max_chars:
            return [whole]
        out, i, chars = [], 0, "".join(x[0] for x in word)
        while i < len(word):
            for j in range(min(len(word), i + self._longest), i, -1):
                t = (self.prefix if i else "") + chars[i:j]
                if t in self.vocab:
                    out.append((t, word[i][1], word[j - 1][2]))
                    i = j
                    break
            else:
                return [whole]
        return out

    def chunk_words(self, chunk: str) -> list[list[tuple[str, int, int]]]:
        """Tokens of the words of a text without white space, with offsets in it; remembered, as chunks come again."""
        if chunk not in self._known:
            if len(self._known) >= 200_000:
                self._known.clear()
            self._known[chunk] = [self.pieces(w) for w in self.words(chunk)]
        return self._known[chunk]

    def encode(self, text: str | None) -> Encoding:
        e, text = Encoding(), text or ""
        k, at, done = 0, 0, 0  # words; bytes and characters so far
        for m in _CHUNK.finditer(text):
            at += len(text[done : m.start()].encode("utf-8", "surrogatepass"))
            done = m.start()
            for word in self.chunk_words(m[0]):
                for t, s, z in word:
                    e.add(self.vocab[t], t, k, (at + s, at + z))
                k += 1
        parts = [e]
        if self.max_length is not None and len(e.ids) > (room := self.max_length - 2):
            step = room - self.stride
            starts = range(0, len(e.ids), step) if room else [0]
            parts = []
            for i in starts:
                parts.append(e.slice(i, i + room))
                if i + room >= len(e.ids):
                    break
        done = []
        for p in parts:
            f = Encoding()
            f.add(self.vocab[self.cls], self.cls, None, (0, 0), special=1)
            for k in range(len(p.ids)):
                f.add(p.ids[k], p.tokens[k], p.word_indices[k], p.offsets[k])
            f.add(self.vocab[self.sep], self.sep, None, (0, 0), special=1)
            while self.padding and self.max_length and len(f.ids) < self.max_length:
                f.add(self.vocab[self.pad], self.pad, None, (0, 0), special=1, attention=0)
            done.append(f)
        done[0].overflowing = done[1:]
        return done[0]

    def decode(self, encoding: Encoding, cleanup: bool = True) -> str:
        text = ""
        for t, special in zip(encoding.tokens, encoding.special_tokens_mask, strict=True):
            if special:
                continue
            text += t[len(self.prefix) :] if t.startswith(self.prefix) else (" " + t if text else t)
        if cleanup:
            for a, b in CONTRACTIONS:
                text = text.replace(a, b)
        return text

    def encode_column(self, text: Column) -> Column:
        """The encoding as a struct, in Arrow batches; overflowing has the other parts' structs."""

        def part(e: Encoding) -> dict:
            return {c: [{"start": i, "end": j} for i, j in e.offsets] if c == "offsets" else getattr(e, c) for c in PART}

        @F.pandas_udf(ENCODING)
        def run(texts: pd.Series) -> pd.DataFrame:
            rows = []
            for e in map(self.encode, texts):
                rows.append(part(e) | {"overflowing": [part(o) for o in e.overflowing]})
            return pd.DataFrame(rows, columns=[*PART, "overflowing"])

        return run(text)

    def word_ids(self, word: str) -> list[int]:
        """The ids of a normalised word's pieces."""
        if len(word) > self.max_chars:
            return [self.vocab[self.unknown]]
        out, i, (known, lengths) = [], 0, self._outer
        while i < len(word):
            for n in lengths.get(word[i], ()):
                if (x := known.get(word[i : i + n])) is not None:
                    out.append(x)
                    i, (known, lengths) = min(i + n, len(word)), self._inner
                    break
            else:
                return [self.vocab[self.unknown]]
        return out

    def chunk_ids(self, chunk: str) -> list[int]:
        """The ids of a text without white space; remembered, as chunks come again."""
        ids = self._known_ids.get(chunk)
        if ids is None:
            if len(self._known_ids) >= 200_000:
                self._known_ids.clear()
            ids = self._known_ids[chunk] = [x for w in chunk.translate(self._spaced).split(" ") if w for x in self.word_ids(w)]
        return ids

    def encode_ids(self, texts: pa.Array) -> pa.Array:
        """The ids of all parts of each text as in encode, without what else an encoding holds: lists of lists.

        Chunks between white space are looked up once for each different one of the batch, and all parts of all texts are
        laid out at once.
        """
        split = pc.split_pattern_regex(texts.fill_null(""), _SPACES)
        seen = split.flatten().dictionary_encode()
        ids = [self.chunk_ids(c) for c in seen.dictionary.to_pylist()]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        places = np.cumsum(counts) - counts
        which = seen.indices.to_numpy(zero_copy_only=False)
        n = counts[which]
        ends = np.append(0, np.cumsum(n))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum()))[_ranges(places[which], n)]
        offsets = split.offsets.to_numpy().astype(np.int64)
        starts = ends[offsets - offsets[0]]  # of each text's ids in flat

        size = np.diff(starts)
        room = None if self.max_length is None else self.max_length - 2
        step = room - self.stride if room else 1
        parts = np.ones(len(size), np.int64)
        if room:
            parts += np.maximum(-(-(size - room) // step), 0)
        of = np.repeat(np.arange(len(size)), parts)
        first = _ranges(np.zeros(len(size), np.int64), parts) * step
        own = size[of] - first if room is None else np.minimum(size[of] - first, room)
        width = np.maximum(own + 2, self.max_length) if self.padding and self.max_length else own + 2
        begin = np.append(0, np.cumsum(width))
        out = np.full(int(begin[-1]), self.vocab[self.pad] if self.padding else 0, np.int32)
        out[begin[:-1]] = self.vocab[self.cls]
        out[begin[:-1] + own + 1] = self.vocab[self.sep]
        out[_ranges(begin[:-1] + 1, own)] = flat[_ranges(starts[of] + first, own)]
        inner = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(out))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(parts)), pa.int32()), inner)

    def ids_column(self, text: Column) -> Column:
        """The ids of all parts, an array for each."""

        @F.arrow_udf("array<array<int>>")
        def run(texts: pa.Array) -> pa.Array:
            return self.encode_ids(texts)

        return run(text)


def _punctuation(c: str) -> bool:
    return unicodedata.category(c)[0] == "P" or (ord(c) < 128 and not c.isalnum() and not c.isspace() and c.isprintable())


class _Spaced(dict):
    """For str.translate: a character as the tokenizer normalises it, with its words between single spaces.

    Normalising looks at one character at a time, so that each is worked out once.
    """

    def __init__(self, tokenizer: WordPiece):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, code: int) -> str:
        found = [c for c, _, _ in self.tokenizer.normalise(chr(code))]
        self[code] = "".join(" " if c.isspace() else f" {c} " if _punctuation(c) else c for c in found)
        return self[code]


def _lengths(tokens: Iterable[str]) -> dict[str, list[int]]:
    """The lengths of the tokens that begin with a character, falling."""
    out: dict[str, set[int]] = {}
    for t in filter(None, tokens):
        out.setdefault(t[0], set()).add(len(t))
    return {c: sorted(n, reverse=True) for c, n in out.items()}


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range of n integers, one range after another."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


def word_starts(offsets: list[tuple[int, int]]) -> list[bool]:
    """Tokens that begin a word: they start behind the end of the one before, or at 0 with some extent."""
    ends = [0, *(e for _, e in offsets[:-1])]
    return [s > before or (s == 0 and e > 0) for (s, e), before in zip(offsets, ends, strict=True)]


def decode_words(text: str, encoding: Encoding) -> list[str]:
    """The original words of the tokens, by word index."""
    raw, spans = text.encode(), {}
    for w, (s, e) in zip(encoding.word_indices, encoding.offsets, strict=True):
        if w is not None:
            spans[w] = (min(spans[w][0], s), max(spans[w][1], e)) if w in spans else (s, e)
    return [raw[s:e].decode() for _, (s, e) in sorted(spans.items())]


def spoken_words(text: str, encoding: Encoding) -> list[str]:
    """The lower-cased words as white space parts them, punctuation included; one for each token that begins a word.

    The last word may go on in the parts that were cut off: it is taken whole.
    """
    raw = text.encode()
    spans: list[list[int]] = []
    for at, part in enumerate((encoding, *encoding.overflowing)):
        for s, e in part.offsets:
            if s == e:
                continue  # a special token
            if spans and s <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], e)
            elif at == 0:
                spans.append([s, e])
            else:
                return [raw[i:j].decode().lower() for i, j in spans]
    return [raw[i:j].decode().lower() for i, j in spans]


# --- patterns and ranges ------------------------------------------------------------------------


def find_matches(pattern: str | re.Pattern | Callable[[str], bool], text: str) -> list[tuple[tuple[int, int], bool]]:
    """The text from end to end as byte ranges, each with whether it is a match.

    A pattern is a text, a compiled expression or a predicate on characters, of which each match is one character.
    """
    if not text or pattern == "":
        return [((0, len(text.encode())), False)]
    if callable(pattern):
        found = [(i, i + 1) for i, c in enumerate(text) if pattern(c)]
    else:
        found = [m.span() for m in re.finditer(re.escape(pattern) if isinstance(pattern, str) else pattern, text)]
    edges = sorted({0, len(text), *(x for span in found for x in span)})
    matched = {i for i, _ in found}
    at = np.cumsum([0, *(len(c.encode("utf-8", "surrogatepass")) for c in text)])
    return [((int(at[i]), int(at[j])), i in matched) for i, j in zip(edges, edges[1:], strict=False)]


def to_original(aligned: list[tuple[str, int, int]], start: int, end: int) -> tuple[int, int] | None:
    """Bytes of the original text for bytes [start, end) of the normalised one; None if they aren't in it or in reverse.

    aligned: characters with the original bytes each stands for, as ``WordPiece.normalise`` gives them.
    """
    each = [(s, e) for c, s, e in aligned for _ in c.encode("utf-8", "surrogatepass")]
    if start == end:
        return (start, end)
    if start > end or end > len(each):
        return None
    return each[start][0], each[end - 1][1]


def to_normalised(aligned: list[tuple[str, int, int]], start: int, end: int) -> tuple[int, int] | None:
    """Bytes of the normalised text for bytes [start, end) of the original one: what begins and ends within them.

    Where nothing begins there, the place where it would end, and the other way round; None where neither is.
    """
    if start == end:
        return (start, end)
    if start > end:
        return None
    each = np.array([(s, e) for c, s, e in aligned for _ in c.encode("utf-8", "surrogatepass")], np.int64).reshape(-1, 2)
    within = int(np.argmax(each[:, 1] > end)) if (each[:, 1] > end).any() else len(each)
    head = each[:within]
    begins = np.flatnonzero((head[:, 0] >= start) & (head[:, 0] != head[:, 1]))
    first, last = (int(begins[0]) if len(begins) else None), (within or None)
    if first is None and last is None:
        return None
    return (last if first is None else first, first if last is None else last)


# --- poolers and encoders -----------------------------------------------------------------------


def pool_none(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """All tokens, as they are."""
    return tokens


def pool_first(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return tokens[0]


def pool_average(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the attended tokens; zeros without any."""
    n = mask.sum()
    return (tokens * mask[:, None]).sum(axis=0) / n if n else np.zeros(tokens.shape[1])


class Encoder(Protocol):
    size: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


@dataclass
class ByteEncoder:
    """A stand-in for a model: the text's bytes, padded or cut."""

    size: int = 128

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for k, t in enumerate(texts):
            b = np.frombuffer((t or "").encode()[: self.size], np.uint8)
            out[k, : len(b)] = b
        return out


@dataclass
class NgramEncoder:
    """A stand-in for a model that reads all of a text: counts of its bytes' n-grams, hashed into as many places as there are.

    A text that is shorter than an n-gram counts as one, behind zero bytes; an empty text has none.
    """

    size: int = 128
    n: int = 3

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for k, t in enumerate(texts):
            b = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
            if not len(b):
                continue
            b = np.concatenate([np.zeros(max(0, self.n - len(b)), np.uint64), b])
            h = np.zeros(len(b) - self.n + 1, np.uint64)
            for i in range(self.n):
                h = (h ^ b[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out[k] = np.bincount((h % np.uint64(self.size)).astype(np.int64), minlength=self.size)
        return out


@dataclass
class OnnxEncoder:
    """A transformer of ids, attention mask and type ids; the session is made once in each worker."""

    model_path: str
    tokenizer: WordPiece
    size: int = 128
    pooler: Callable[[np.ndarray, np.ndarray], np.ndarray] = pool_average
    batch: int = 32

    def tokens(self, texts: list[str]) -> list[tuple[Encoding, np.ndarray]]:
        """Each text's encoding and the embeddings of its tokens; ``batch`` texts, filled up to the longest, in a call."""
        if not hasattr(self, "_session"):
            import onnxruntime

            self._session = onnxruntime.InferenceSession(self.model_path)
        names, out = [i.name for i in self._session.get_inputs()], []
        for i in range(0, len(texts), self.batch):
            some = [self.tokenizer.encode(t) for t in texts[i : i + self.batch]]
            full = np.zeros((3, len(some), max(len(e.ids) for e in some)), np.int64)
            full[0] = self.tokenizer.vocab.get(self.tokenizer.pad, 0)
            for k, e in enumerate(some):
                full[:, k, : len(e.ids)] = e.ids, e.attention_mask, e.type_ids
            found = self._session.run(None, dict(zip(names, full, strict=False)))[0]
            out += [(e, found[k, : len(e.ids)]) for k, e in enumerate(some)]
        return out

    def encode(self, texts: list[str]) -> np.ndarray:
        pooled = [self.pooler(x, np.array(e.attention_mask)) for e, x in self.tokens(texts)]
        return np.array(pooled).reshape(-1, self.size)


@dataclass
class ContextEncoder:
    """A stand-in for a model that embeds tokens in their context: seeded vectors of the ids, mixed with their neighbours'."""

    tokenizer: WordPiece
    size: int = 128
    seed: int = 0

    def tokens(self, texts: list[str]) -> list[tuple[Encoding, np.ndarray]]:
        out = []
        for t in texts:
            e = self.tokenizer.encode(t)
            x = np.stack([np.random.default_rng([self.seed, i]).standard_normal(self.size) for i in e.ids])
            out.append((e, (np.roll(x, 1, axis=0) + 2 * x + np.roll(x, -1, axis=0)) / 4))
        return out


def encode_column(encoder: Encoder, text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(encoder.encode([t or "" for t in texts])), dtype=object)

    return run(text)
