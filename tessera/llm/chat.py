"""Chat formatting at token level.

Every turn is encoded by segments, its role and its text each on their own, and reserved ids are spliced between them:
START role MIDDLE text END. Nothing in a text can so become a marker. For models that see the formatted text, control
strings inside roles and texts are escaped as well (a backslash before each ``###``, ``</turn>`` and backslash), which
reads back without loss; in roles a colon is escaped too, as it ends them. The loss mask is the prefix sum of +1 and -1
marks at the borders of the assistants' texts.

Cases: a null conversation id leaves the row out; null roles and texts are empty; turns go by number (null first), ties
by role and text, and repeated rows are turns of their own; other columns aren't read. Texts of over STEP code points
are encoded piece by piece, cut before white space that follows something else, where the tokenizer's pattern ends a
token anyway; only in a longer run without such a place (a million blanks or letters) a cut changes the ids, never the
text. A conversation is one row of the result and is put together in one task as its turns arrive in order.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: The markers, in the order of their ids above the vocabulary.
MARKERS = ("### ", ": ", " </turn>\n")
_CONTROL = re.compile(r"\\|###|</turn>")
_CONTROL_OR_COLON = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
STEP = 4096
_BORDER = re.compile(r".{0,4094}\S(?=\s)", re.DOTALL)


def escape(text: str, role: bool = False) -> str:
    return (_CONTROL_OR_COLON if role else _CONTROL).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


class ByteTokenizer:
    """A byte-level vocabulary of (base64 token, rank) lines, with ids for the markers above it."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.start, self.middle, self.end = (max(ranks.values()) + 1 + k for k in range(3))

    def encode(self, text: str) -> list[int]:
        ids, at = [], 0
        while len(text) - at > STEP:
            m = _BORDER.match(text, at)
            end = m.end() if m else at + STEP
            ids += self.encoding.encode_ordinary(text[at:end])
            at = end
        return ids + self.encoding.encode_ordinary(text[at:])

    def decode(self, ids: list[int]) -> str:
        return self.encoding.decode_bytes(ids).decode("utf-8")


def segments(tokenizer: ByteTokenizer, role: str, text: str) -> tuple[list[int], list[int]]:
    return tokenizer.encode(escape(role, True)), tokenizer.encode(escape(text))


def assemble(tokenizer: ByteTokenizer, turns: list[tuple[str, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of a conversation; turns: role, ids of the role, ids of the text."""
    parts, sizes, learn = [], [], []
    for role, r, t in turns:
        parts += [[tokenizer.start], r, [tokenizer.middle], t, [tokenizer.end]]
        sizes += [1, len(r), 1, len(t), 1]
        learn += [0, 0, 0, int(role == "assistant"), 0]
    ids = np.concatenate([np.asarray(p, np.int32) for p in parts]) if parts else np.zeros(0, np.int32)
    ends = np.cumsum(sizes) if sizes else np.zeros(0, np.int64)
    marks = np.zeros(len(ids) + 1, np.int32)
    on = np.array(learn, bool)
    np.add.at(marks, (ends - sizes)[on] if len(ends) else [], 1)
    np.add.at(marks, ends[on] if len(ends) else [], -1)
    return ids, np.cumsum(marks)[:-1].astype(np.int8)


def read_back(tokenizer: ByteTokenizer, ids: np.ndarray, mask: np.ndarray) -> tuple[list[tuple[str, str]], list[str], str]:
    """(role, text) of the turns, the texts under the mask, and the formatted text, from ids and mask alone."""
    pieces, texts = [], {tokenizer.start: MARKERS[0], tokenizer.middle: MARKERS[1], tokenizer.end: MARKERS[2]}
    marked = np.flatnonzero(ids >= tokenizer.start)
    turns, formatted = [], []
    for i, j in zip(np.append(0, marked + 1), np.append(marked, len(ids)), strict=True):
        pieces.append(tokenizer.decode(ids[i:j].tolist()))
        formatted.append(pieces[-1])
        if j < len(ids):
            formatted.append(texts[int(ids[j])])
            if ids[j] == tokenizer.end:
                turns.append((unescape(pieces[-2]), unescape(pieces[-1])))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
    learned = [unescape(tokenizer.decode(ids[i:j].tolist())) for i, j in zip(edges[::2], edges[1::2], strict=True)]
    return turns, learned, "".join(formatted)


def _packed(ids: list[int]) -> bytes:
    """Two bytes an id where that is enough; the width is told by a leading byte."""
    a = np.array(ids, np.int64)
    small = not len(a) or a.max() < 1 << 16
    return (b"\2" if small else b"\4") + a.astype("<u2" if small else "<u4").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if raw[0] == 2 else "<u4", offset=1).astype(np.int32)


def _encoder(path: str, pattern: str):
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("r", pa.binary()), ("t", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = None
        for b in batches:
            tokenizer = tokenizer or ByteTokenizer(path, pattern)
            pairs = [segments(tokenizer, r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            cols = [pa.array([_packed(p[k]) for p in pairs], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], schema=schema)

    return run


def _in_order(tokenizer: ByteTokenizer, turns: list[tuple[int | None, bytes, bytes]]) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """role, ids of the role and of the text; turns of one number by role and text."""
    read = lambda ids: unescape(tokenizer.decode(ids.tolist()))
    out, i = [], 0
    while i < len(turns):
        j = i + 1
        while j < len(turns) and turns[j][0] == turns[i][0]:
            j += 1
        same = [(read(r), r, t) for r, t in ((_unpacked(r), _unpacked(t)) for _, r, t in turns[i:j])]
        out += same if len(same) == 1 else sorted(same, key=lambda x: (x[0], read(x[2])))
        i = j
    return out


def _assembler(path: str, pattern: str):
    schema = pa.schema([("conv_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.int8()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ByteTokenizer(path, pattern)
        now: int | None = None
        turns: list = []

        def done(rows):
            ids, mask = zip(*(assemble(tokenizer, _in_order(tokenizer, t)) for _, t in rows), strict=True)
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array(list(ids), schema.types[1]), pa.array(list(mask), schema.types[2])], schema=schema)

        for b in batches:
            rows = []
            for conv, turn, r, t in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if conv != now:
                    if turns:
                        rows.append((now, turns))
                    now, turns = conv, []
                turns.append((turn, r, t))
            if rows:
                yield done(rows)
        if turns:
            yield done([(now, turns)])

    return run


def format_conversations(turns: DataFrame, tokenizer_path: str, pattern: str) -> DataFrame:
    """turns (conv_id, turn, role, text) -> conv_id, ids, loss_mask."""
    bound_batches(turns.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role"), text("text")).filter("conv_id is not null")
    coded = rows.mapInArrow(_encoder(tokenizer_path, pattern), "conv_id long, turn long, r binary, t binary")
    # only ids travel, two bytes each
    dealt = coded.repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    return dealt.mapInArrow(_assembler(tokenizer_path, pattern), "conv_id long, ids array<int>, loss_mask array<tinyint>")


def _digests(path: str, pattern: str):
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ByteTokenizer(path, pattern)
        for b in batches:
            rows = []
            for k, conv in enumerate(b.column(0).to_pylist()):
                ids, mask = (b.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (1, 2))
                turns, learned, text = read_back(tokenizer, ids, mask)
                all_turns = "".join(f"{r}\n{t}\n" for r, t in turns)
                loss = "".join(learned)
                rows.append((conv, len(turns), hashlib.sha256(all_turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    return run


def conversation_report(turns: DataFrame, tokenizer_path: str, pattern: str) -> DataFrame:
    """-> conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted ids."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return format_conversations(turns, tokenizer_path, pattern).mapInArrow(_digests(tokenizer_path, pattern), schema)
