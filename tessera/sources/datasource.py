"""Histories as Python data sources, for batches and streams.

``tessera_history`` reads a folder of users' histories, a CSV file and a partition each, or, as a stream, files as they
come. ``tessera_generated_history`` makes histories up, some users a batch. Register them with ``register(spark)`` and use
``spark.read.format("tessera_history").load(folder)``.

Every entry of the folder whose name ends in .csv must be a file; other entries are passed over. The first malformed record
stops the read with its file and line. Files are opened where the tasks run, by a path that they share or one that
pyarrow's file systems know; ``tables.read_history_csv`` reads by Spark's own file systems instead.
"""

from __future__ import annotations

import csv
import io
import random
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

COLUMNS = "user_id long, hist_pos long, id string, session long, query_count long, query_id long, query_words string, url string, domain string, day int, relevance int, user_feedback int, rank int, user_action int"
FIELDS = ("session_id", "user_id", "query_id", "day", "query_words", "url", "domain", "relevance", "position", "query_counter")
_TEXTS = {"query_words", "url", "domain"}
# Feedback that isn't given; a result that was missed.
NOT_GIVEN, MISS = 2, 0


def record_id(user_id: int, counter: int) -> str:
    """As tables.synthetic_id, from a user and the record's place in the user's file."""
    return f"{counter & 0xFFFFFFFF:08x}-eb92-4d36-{(user_id >> 48) & 0xFFFF:04x}-{user_id & ((1 << 48) - 1):012x}"


def parse(lines: io.TextIOBase, name: str) -> Iterator[tuple]:
    """The rows of a file; an error names the file and the line."""
    reader = csv.reader(lines)
    head = next(reader, None)
    if head is None:
        return
    missing = [f for f in FIELDS if f not in head]
    if missing:
        raise ValueError(f"{name}, line 1: missing fields {missing}")
    if len(set(head)) != len(head):
        raise ValueError(f"{name}, line 1: repeated fields")
    for counter, row in enumerate(reader):
        where = f"{name}, line {reader.line_num}"
        if len(row) != len(head):
            raise ValueError(f"{where}: {len(head)} fields expected, not {len(row)}")
        r: dict = dict(zip(head, row, strict=True))
        for f in FIELDS:
            if f not in _TEXTS:
                if not (r[f].isascii() and r[f].isdigit()):
                    raise ValueError(f"{where}: {f} is no whole number: {r[f]!r}")
                r[f] = int(r[f])
        if r["relevance"] > 2:
            raise ValueError(f"{where}: relevance must be 0, 1 or 2")
        if r["position"] < 1:
            raise ValueError(f"{where}: positions start at 1")
        yield (
            r["user_id"], counter, record_id(r["user_id"], counter), r["session_id"], r["query_counter"], r["query_id"], r["query_words"].replace(",", " "), r["url"], r["domain"],
            r["day"] % 7, r["relevance"], NOT_GIVEN, r["position"] - 1, MISS,
        )


def _opened(path: str):
    from pyarrow import fs

    system, own = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)
    return system, own


def list_histories(folder: str) -> list[tuple[int, str]]:
    """(time, path) of the folder's CSV files, oldest first."""
    from pyarrow import fs

    system, own = _opened(folder)
    found = []
    for entry in system.get_file_info(fs.FileSelector(own)):
        if entry.extension != "csv":
            continue
        if entry.type != fs.FileType.File:
            raise ValueError(f"{entry.path} ends in .csv, but is no file")
        found.append((entry.mtime_ns or 0, entry.path))
    return sorted(found)


@dataclass
class HistoryFile(InputPartition):
    path: str


class _Files:
    """Partitions are files; a stream's offset is how many of the files, oldest first, were read."""

    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("a folder is needed")
        self.folder = options["path"]

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(list_histories(self.folder))}

    def partitions(self, start: dict | None = None, end: dict | None = None) -> list[HistoryFile]:
        files = [HistoryFile(p) for _, p in list_histories(self.folder)]
        return files if start is None else files[start["files"] : end["files"]]

    def read(self, partition: HistoryFile) -> Iterator[tuple]:
        system, _ = _opened(self.folder)
        with system.open_input_stream(partition.path) as f:
            yield from parse(io.TextIOWrapper(f, encoding="utf-8", newline=""), partition.path)


class _FileReader(_Files, DataSourceReader):
    pass


class _FileStreamReader(_Files, DataSourceStreamReader):
    pass


class HistorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_history"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return _FileReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _FileStreamReader(self.options)


# --- made-up histories ----------------------------------------------------------------------------


def generated(user: int, queries: int, documents: int, seed: int) -> Iterator[tuple]:
    """One user's history: clicks favour good ranks; above the last click results were skipped, below it missed."""
    rnd = random.Random(f"{seed}/{user}")
    pos = 0
    for q in range(queries):
        clicks = [rnd.random() < 1 / (k + 2) for k in range(documents)]
        last = max((k for k, c in enumerate(clicks) if c), default=-1)
        first = clicks.index(True) if last >= 0 else -1
        for k, clicked in enumerate(clicks):
            relevance = 0 if not clicked else 2 if k == first or rnd.random() < 0.5 else 1
            feedback = rnd.choices([2, 1, 0], [5, 3, 2])[0]
            doc = rnd.randrange(1_000)
            yield (user, pos, record_id(user, pos), q // 3, q % 3, q % 7, f"w{q % 7}", f"u{doc % 97}", f"d{doc % 13}", rnd.randrange(7), relevance, feedback, k, 2 if clicked else 1 if k < last else 0)
            pos += 1


@dataclass
class Users(InputPartition):
    start: int
    end: int


class _Made:
    """A stream's offset is the number of users made so far; a batch of it has usersPerBatch of them."""

    def __init__(self, options: dict):
        self.users, self.queries, self.documents, self.seed, self.step, self.each = (int(options.get(k, v)) for k, v in (("users", 10), ("queries", 5), ("documents", 10), ("seed", 0), ("usersperbatch", 10), ("userspertask", 100)))
        if min(self.users, self.queries, self.documents, self.step, self.each) < 1:
            raise ValueError("users, queries, documents and sizes must be positive")
        self.told = 0

    def initialOffset(self) -> dict:
        return {"users": 0}

    def latestOffset(self) -> dict:
        self.told = min(self.told + self.step, self.users)
        return {"users": self.told}

    def partitions(self, start: dict | None = None, end: dict | None = None) -> list[Users]:
        low, high = (0, self.users) if start is None else (start["users"], end["users"])
        self.told = max(self.told, high)
        return [Users(k, min(k + self.each, high)) for k in range(low, high, self.each)]

    def read(self, partition: Users) -> Iterator[tuple]:
        for user in range(partition.start, partition.end):
            yield from generated(user, self.queries, self.documents, self.seed)


class _Generator(_Made, DataSourceReader):
    pass


class _StreamGenerator(_Made, DataSourceStreamReader):
    pass


class GeneratedHistorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_generated_history"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return _Generator(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamGenerator(self.options)


def register(spark: SparkSession) -> None:
    for source in (HistorySource, GeneratedHistorySource):
        spark.dataSource.register(source)
