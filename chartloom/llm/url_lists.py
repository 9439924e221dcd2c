"""URL filters against dated lists: validity intervals and an as-of join.

A list is a log of dated entries: ``list``, ``key`` (a host, a domain with all its hosts, or a host with
its first path segment), ``action`` (add or remove) and ``at``.  Consecutive entries of a key become
intervals [from, to) in which it is active.  Every capture looks up its keys among intervals that hold its
fetch time, so later changes of a list never judge earlier captures.

Captures fall into periods of ``PERIOD`` days.  An interval is listed once for each period in which its key has captures, however long
it lasts, and joined on key and period: a key with a long history or with a third of all captures is spread over
periods, and a hot pair can be split at run time.

Captures with a null URL, no host or no fetch time match nothing, meet no join and stay in the result.  Columns named
``blocked`` and ``lists`` are replaced; all others pass unchanged, whatever their names.  Of several entries of a
key at the same time a removal wins.  Repeated captures each get their verdict; an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chartloom.operators.staging import join_splittable

PERIOD = 28
_DAY = 86_400


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def segment_of(url: Column) -> Column:
    """First path segment, empty if there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)


def keys_of(url: Column) -> Column:
    """The host, every domain above it, and the host with its first path segment."""
    host, segment = host_of(url), segment_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    return F.when(F.coalesce(host, F.lit("")) == "", F.expr("array()").cast("array<string>")).otherwise(
        F.when(segment == "", domains).otherwise(F.array_append(domains, F.concat_ws("/", host, segment)))
    )


def intervals(entries: DataFrame) -> DataFrame:
    """list, key, valid_from, valid_to (null: still active), one row per time a key is active."""
    at = entries.where("key IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')")
    state = at.groupBy("list", "key", "at").agg(F.max(F.when(F.col("action") == "remove", 1).otherwise(0)).alias("gone"))
    order = W.partitionBy("list", "key").orderBy("at")
    changes = state.withColumn("before", F.lag("gone", 1, 1).over(order)).where("gone <> before")
    spans = changes.withColumn("valid_to", F.lead("at").over(order))
    return spans.where("gone = 0").select("list", "key", F.col("at").alias("valid_from"), "valid_to")


def _period(time: Column) -> Column:
    return F.floor(F.unix_timestamp(time) / F.lit(PERIOD * _DAY)).cast("long")


def active_cells(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """list, valid_from, valid_to per key and period: intervals where and when ``asked`` (key, period) has captures."""
    cells = asked.select("key", "period").distinct()
    spans = intervals(entries).withColumn("first", _period(F.col("valid_from"))).withColumn("last", _period(F.col("valid_to")))
    within = (F.col("period") >= F.col("first")) & (F.col("last").isNull() | (F.col("period") <= F.col("last")))
    return join_splittable(cells, spans, ["key"], "inner").where(within).select("key", "period", "list", "valid_from", "valid_to")


def judge_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """All columns of ``captures`` (url, fetch_time), ``blocked`` and the sorted names of the lists that block."""
    columns = [c for c in captures.columns if c not in ("blocked", "lists")]
    rows = captures.select(F.struct(*columns).alias("row"), "url", "fetch_time")
    complete = F.col("url").isNotNull() & F.col("fetch_time").isNotNull()
    asked = rows.where(complete).select("url", "fetch_time").distinct()
    asked = asked.select("url", "fetch_time", _period(F.col("fetch_time")).alias("period"), F.explode(F.array_distinct(keys_of(F.col("url")))).alias("key"))
    found = join_splittable(asked, active_cells(asked, entries), ["key", "period"], "inner").where(
        (F.col("valid_from") <= F.col("fetch_time")) & (F.col("valid_to").isNull() | (F.col("fetch_time") < F.col("valid_to")))
    )
    verdicts = found.groupBy("url", "fetch_time").agg(F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"))
    judged = join_splittable(rows.where(complete), verdicts, ["url", "fetch_time"], "left").select("row", "lists")
    rest = rows.where(~complete).select("row", F.lit(None).cast("string").alias("lists"))
    return judged.unionByName(rest).select(
        *[F.col("row").getField(c).alias(c) for c in columns], F.col("lists").isNotNull().alias("blocked"), F.coalesce("lists", F.lit("")).alias("lists")
    )
