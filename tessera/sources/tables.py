"""Sources and sinks: histories as CSV, calls as JSON, samples, vocabularies, versioned state, results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.wordpiece import read_vocabulary

HISTORY_CSV = "session_id long, user_id long, query_id long, day int, query_words string, url string, domain string, relevance int, position int, query_counter int"
DOCUMENT = "id string, rank int, title string, snippet string, session string, query_count int, query_id string, query_words string, url string, domain string"
HISTORY = "id string, relevance int, user_feedback int, session string, query_count int, query_id string, query_words string, day int, url string, domain string, rank int, user_action int"
CALL = f"rerank_mode int, histories array<struct<{HISTORY.replace(' ', ':').replace(',:', ', ')}>>, documents array<struct<{DOCUMENT.replace(' ', ':').replace(',:', ', ')}>>, serialized_state string"
STATE_VERSION = 3


def synthetic_id(sub_id: Column, second: Column | int = 0xD006A685) -> Column:
    """A 128-bit id in UUID form: a second number of 32 bits, a fixed middle, and a number of 64 bits."""
    second = second if isinstance(second, Column) else F.lit(second).cast("long")
    return F.format_string("%08x-eb92-4d36-%04x-%012x", second.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(sub_id, 48), sub_id.bitwiseAND(F.lit((1 << 48) - 1)))


def read_history_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Histories of users, one CSV file each, hist_pos in the file's order; anything malformed is an error, other files are passed over."""
    raw = spark.read.schema(HISTORY_CSV).option("header", True).option("mode", "FAILFAST").option("pathGlobFilter", "*.csv").csv(folder)
    raw = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("_file", "_block", "_row")) - 1
    ok = F.when(F.col("position") < 1, F.raise_error(F.lit("positions start at 1")).cast("int")).otherwise(F.col("position") - 1)
    return raw.select(
        "user_id", place.cast("long").alias("hist_pos"), F.col("session_id").alias("session"), F.col("query_counter").alias("query_count"), "query_id", F.replace("query_words", F.lit(","), F.lit(" ")).alias("query_words"), "url", "domain",
        (F.col("day") % 7).alias("day"), "relevance", F.lit(2).alias("user_feedback"), ok.alias("rank"), synthetic_id(F.col("user_id"), place.cast("long")).alias("id"),
    )


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Recorded calls, one JSON document a file, with the file's name; the state comes out of base64."""
    return spark.read.schema(CALL).option("multiLine", True).json(path).withColumn("file", F.input_file_name()).withColumn("state", F.unbase64("serialized_state")).drop("serialized_state")


def write_calls(calls: DataFrame, path: str) -> None:
    calls.withColumn("serialized_state", F.base64("state")).drop("state", "file").write.mode("overwrite").json(path)


def read_vocabulary_file(spark: SparkSession, path: str) -> dict[str, int]:
    return read_vocabulary(r["value"] for r in spark.read.option("wholetext", False).text(path).coalesce(1).collect())


def write_samples(samples: DataFrame, path: str, append: bool = True) -> None:
    """sample_id, inputs (n x 50) and target (n); any other shape is an error."""
    fine = (F.size("inputs") == F.size("target")) & F.forall("inputs", lambda r: F.size(r) == 50)
    checked = samples.filter(F.when(F.coalesce(fine, F.lit(False)), True).otherwise(F.raise_error(F.lit("samples need n x 50 inputs and n targets")).cast("boolean")))
    checked.write.mode("append" if append else "overwrite").parquet(path)


def read_samples(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    if ids is None:
        return rows
    found = rows.filter(F.col("sample_id").isin(ids))
    if found.select("sample_id").distinct().count() != len(set(ids)):
        raise IndexError("no such sample")
    return found


# --- state --------------------------------------------------------------------------------------


def migrate(state: DataFrame, version: int) -> DataFrame:
    """Interests of an older version: 0 and 1 held alpha and beta, up to 2 had no statistics (count 1, no time, the epoch)."""
    if not 0 <= version <= STATE_VERSION:
        raise ValueError(f"unknown state version {version}")
    out = state.drop("alpha", "beta")
    if version < 3:
        out = out.withColumn("view_count", F.lit(1).cast("long")).withColumn("view_time", F.lit(0.0)).withColumn("last_view", F.lit(0).cast("timestamp"))
    return out


def save_state(interests: DataFrame, path: str) -> None:
    """Interests or phrases, as a table of the present version."""
    interests.withColumn("schema_version", F.lit(STATE_VERSION)).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str, phrases: bool = False) -> DataFrame:
    """What was saved, brought to the present version; phrases have not changed since they are kept."""
    rows = spark.read.option("mergeSchema", True).parquet(path)  # files of several versions have different columns
    if phrases:
        return rows.drop("schema_version")
    versions = [r[0] for r in rows.select("schema_version").distinct().limit(STATE_VERSION + 2).collect()]
    out = None
    for v in versions or [STATE_VERSION]:
        part = migrate(rows.filter(F.col("schema_version") == v).drop("schema_version"), v)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


#: A service's state as one document: interests and the last ranking.
INTEREST_STATE = "polarity string, coi_pos int, coi_id string, point array<double>, view_count long, view_time double, last_view_micros long"
PREVIOUS_STATE = "request_id long, doc_pos int, id string, rank int, embedding array<double>, ltr_score double, context double, final_rank int"
STATE = f"schema_version int, interests array<struct<{INTEREST_STATE.replace(' ', ':').replace(',:', ', ')}>>, previous array<struct<{PREVIOUS_STATE.replace(' ', ':').replace(',:', ', ')}>>"


def _columns(schema: str) -> list[tuple[str, str]]:
    return [(c.split(" ")[0], c.split(" ", 1)[1]) for c in schema.split(", ")]


def state_to_bytes(interests: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """-> user_id, state: each user's interests and, for a service that goes on, its last ranking, in versioned bytes."""
    rows = interests.withColumn("last_view_micros", F.unix_micros("last_view"))
    own = lambda frame, schema: F.struct(*[(F.col(c) if c in frame.columns else F.lit(None)).cast(t).alias(c) for c, t in _columns(schema)])
    lists = rows.groupBy("user_id").agg(F.sort_array(F.collect_list(own(rows, INTEREST_STATE))).alias("interests"))
    if previous is not None:
        ranked = previous.groupBy("user_id").agg(F.sort_array(F.collect_list(own(previous, PREVIOUS_STATE))).alias("previous"))
        lists = lists.join(ranked, "user_id", "full")
    else:
        lists = lists.withColumn("previous", F.lit(None).cast(STATE.split("previous ")[1]))
    none = F.coalesce("interests", F.array().cast(lists.schema["interests"].dataType))
    return lists.select("user_id", F.to_json(F.struct(F.lit(STATE_VERSION).alias("schema_version"), none.alias("interests"), "previous")).cast("binary").alias("state"))


def state_from_bytes(states: DataFrame, needed: bool = False) -> tuple[DataFrame, DataFrame]:
    """states (user_id, state) -> interests and last rankings. Null and empty bytes are a service that knows nothing.

    needed: they are an error instead, as for what devices exchange. Bytes of another form or version always are one.
    """
    rows = states.withColumn("_s", F.from_json(F.col("state").cast("string"), STATE)).withColumn("_empty", F.coalesce(F.length("state") == 0, F.lit(True)))
    fine = F.when(F.col("_empty"), F.lit(not needed)).otherwise(F.coalesce(F.col("_s.schema_version") == STATE_VERSION, F.lit(False)))
    rows = rows.filter(F.when(fine, True).otherwise(F.raise_error(F.lit("no state of this version")).cast("boolean"))).filter("not _empty")
    interests = rows.select("user_id", F.inline("_s.interests")).withColumn("last_view", F.timestamp_micros("last_view_micros")).drop("last_view_micros")
    return interests, rows.select("user_id", F.inline("_s.previous"))


def synthetic_calls(spark: SparkSession, users: int, queries: int = 5, documents: int = 10, seed: int = 0) -> DataFrame:
    """A generated history: ranked results with clicks that favour good ranks.

    A query's results are read down to its last click: what isn't clicked above it was skipped, what comes below was
    missed; without a click all were missed. Its first click is of high relevance, others of medium or high. Half the
    results get no feedback, three in ten are found irrelevant, two in ten relevant.
    """
    rows = spark.range(users * queries * documents).select(
        F.floor(F.col("id") / (queries * documents)).alias("user_id"), (F.floor(F.col("id") / documents) % queries).alias("q"), (F.col("id") % documents).cast("int").alias("rank"), F.rand(seed).alias("u"), F.rand(seed + 1).alias("v"), F.rand(seed + 2).alias("w"), "id"
    )
    own = Window.partitionBy("user_id", "q")
    rows = rows.withColumn("clicked", F.col("u") < 1.0 / (F.col("rank") + 2))
    place = F.when(F.col("clicked"), F.col("rank"))
    rows = rows.withColumn("first", F.min(place).over(own)).withColumn("last", F.max(place).over(own))
    relevance = F.when(~F.col("clicked"), 0).when((F.col("rank") == F.col("first")) | (F.col("v") < 0.5), 2).otherwise(1)
    return rows.select(
        "user_id", (F.col("q") * documents + F.col("rank")).alias("hist_pos"), F.col("id").cast("string").alias("id"), F.floor(F.col("q") / 3).alias("session"), (F.col("q") % 3).alias("query_count"), (F.col("q") % 7).alias("query_id"),
        F.concat(F.lit("w"), F.col("q") % 7).alias("query_words"), "rank", F.concat(F.lit("u"), F.col("id") % 97).alias("url"), F.concat(F.lit("d"), F.col("id") % 13).alias("domain"), (F.col("id") % 7).cast("int").alias("day"),
        relevance.alias("relevance"), F.when(F.col("w") < 0.5, 2).when(F.col("w") < 0.8, 1).otherwise(0).alias("user_feedback"), F.when(F.col("clicked"), 2).when(F.col("rank") < F.col("last"), 1).otherwise(0).alias("user_action"),
    )


def write_results(outcomes: DataFrame, faults: DataFrame, path: str, analytics: DataFrame | None = None) -> None:
    """Outcomes, analytics and faults of calls as JSON lines, each in a folder of its own."""
    for name, rows in (("outcomes", outcomes), ("faults", faults), ("analytics", analytics)):
        if rows is not None:
            rows.write.mode("overwrite").json(f"{path}/{name}")


def read_manifest(path: str) -> dict[str, dict]:
    """Model assets by id: url_suffix and, where an asset comes in chunks, chunk_size."""
    with open(path) as f:
        assets = json.load(f)
    out = {}
    for a in assets["assets"] if isinstance(assets, dict) else assets:
        if not {"id", "url_suffix"} <= set(a) or a["id"] in out:
            raise ValueError("assets need an id of their own and a url_suffix")
        out[a["id"]] = {k: a.get(k) for k in ("url_suffix", "chunk_size")}
    return out
