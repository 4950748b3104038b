"""URL filters by a temporal list join, with DataFrame functions only.

A list's entries say that a rule (a host with everything below it) is listed or delisted in a category from a time on.
Each rule's entries become validity intervals; a capture is matched as of its fetch time, with equality on its host and
the hosts above it and the interval around the time, so that an entry applies only to captures fetched while it held.

Captures are reduced to distinct (host, time) pairs before they meet the list, so that a host with a large share of the
captures meets its rules once for each time. A list of at most BROADCAST_RULES intervals is broadcast; of a longer one
only the intervals of rules that very many hosts lie below (there are few such rules, counted at the keys) are broadcast,
and the others are joined by shuffle.

Cases: a null, empty or hostless URL and a null fetch time match nothing; hosts and rules are compared in lower case and
without final dots, hosts also without user (all up to the last @) and port, an address in brackets being a host; entries
with null or empty rule, null category or time are ignored; of several entries of a rule at one time, delisting wins;
repeated captures each get their row; a null id stays a row; URLs of any length are taken whole; empty tables give no
rows or no matches; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, partitions

BROADCAST_RULES = 500_000
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^/?#\]]*\]|[^/?#:]*)"


def host_of(url: Column) -> Column:
    """Lower-case host; empty where there is none."""
    return F.lower(F.regexp_replace(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")), r"\.+$", ""))


def hosts_above(host: Column) -> Column:
    """The host and every host above it, down to the last label."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def validity(entries: DataFrame) -> DataFrame:
    """entries (rule, category, listed, at) -> rule, category, since, until (null: still): when a rule is listed."""
    own = entries.withColumn("rule", F.lower(F.regexp_replace("rule", r"\.+$", ""))).filter("rule <> '' and category is not null and at is not null")
    fine = own.groupBy("rule", "category", "at").agg(F.min(F.coalesce("listed", F.lit(False))).alias("listed"))
    after = F.lead("at").over(Window.partitionBy("rule", "category").orderBy("at"))
    return fine.withColumn("until", after).filter("listed").select("rule", "category", F.col("at").alias("since"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """-> id, host, fetched, n_rules, categories (sorted, joined by commas), blocked."""
    rows = captures.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), F.col(time_col).alias("fetched"))
    rules = validity(entries)
    spots = rows.filter("host <> '' and fetched is not null").select("host", "fetched").distinct()
    keys = spots.select("host", "fetched", F.explode(hosts_above(F.col("host"))).alias("rule"))
    active = (F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    if rules.count() <= BROADCAST_RULES:
        met = keys.join(F.broadcast(rules), "rule").filter(active)
    else:
        # rules with so large a share of the keys: at most as many as a few times the partitions, by their count
        keys, rules = materialize(keys), materialize(rules)
        most = max(1, keys.count() // (2 * partitions(captures.sparkSession)))
        hot = F.broadcast(materialize(keys.groupBy("rule").count().filter(F.col("count") > most).select("rule")))
        spread = rules.join(hot, "rule", "left_semi")
        if spread.count() <= BROADCAST_RULES:
            spread = F.broadcast(spread)
        near = keys.join(hot, "rule", "left_anti").join(rules, "rule")
        met = keys.join(spread, "rule").unionByName(near).filter(active)
    verdicts = met.groupBy("host", "fetched").agg(F.count("*").alias("n_rules"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    out = rows.join(verdicts, ["host", "fetched"], "left")
    return out.select(F.col("id").alias(id_col), "host", "fetched", F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"), F.coalesce("categories", F.lit("")).alias("categories"), F.col("n_rules").isNotNull().alias("blocked"))


# --- a list and fetch times for tables that have none ---------------------------------------------


def _digit(x: Column, at: int, n: int) -> Column:
    """A number below 16**n from the MD5 of a text."""
    return F.conv(F.substring(F.md5(x.cast("string")), at, n), 16, 10).cast("long")


def fetch_time(page_id: Column) -> Column:
    """A day of 2024, by the id."""
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(page_id * 37, F.lit(366)).cast("int"))


def derived_entries(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Dated entries for some of the hosts and second-level hosts that occur: listed, for some delisted, some listed again."""
    host = pages.select(host_of(F.col(url_col)).alias("host")).filter("host <> ''").distinct()
    labels = F.split("host", r"\.")
    second = F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(F.col("host"))
    both = host.select(F.explode(F.array(F.col("host"), second)).alias("rule"))
    rules = both.distinct().withColumn("h", _digit(F.col("rule"), 1, 2)).withColumn("day", F.pmod(_digit(F.col("rule"), 3, 3), F.lit(200)).cast("int"))
    first = F.lit("2024-01-01").cast("date")
    steps = F.filter(
        F.array(*[F.struct(F.lit(k).alias("k"), F.lit(on).alias("listed"), F.date_add(first, F.col("day") + add).alias("at")) for k, on, add in ((0, True, 0), (1, False, 60), (2, True, 120))]),
        lambda s: s["k"] <= F.col("h") % 3,
    )
    category = F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam"), F.lit("gambling")), (F.col("h") % 4 + 1).cast("int"))
    return rules.filter("h < 128").select("rule", category.alias("category"), F.explode(steps).alias("s")).select("rule", "category", "s.listed", "s.at")


def filter_pages(pages: DataFrame) -> DataFrame:
    """Every page against the derived list as of its derived fetch day."""
    captures = pages.select("page_id", "url", fetch_time(F.col("page_id")).alias("fetched"))
    return filter_urls(captures, derived_entries(pages)).withColumn("fetched", F.col("fetched").cast("string"))
