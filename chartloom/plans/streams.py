"""Streaming queries, each run to completion over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.plans import checks
from chartloom.plans.intake import _ADMIT, SMALL
from chartloom.plans.lifecycle import SQL_STAMP, STAMP
from chartloom.plans.registry import query
from chartloom.sources.corpus import file_columns, table
from chartloom.streaming import keyed
from chartloom.streaming import lifecycle as jobs


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.table_stream(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("created_at")
    )


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.table_stream(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_shipdate").cast("timestamp").alias("requested_at")
    )


_HIT = """EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 24 HOUR)"""


@query(f"""SELECT o_orderkey AS k, strftime(o_orderdate, {SQL_STAMP}) AS created_at FROM orders WHERE {_HIT}""")
def stream_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as drafts and order lines as confirm requests, joined in event time."""
    done = jobs.drain(jobs.confirmed_drafts(_drafts(spark, sf_dir), _requests(spark, sf_dir), "k"), "confirmed")
    return done.select("k", F.date_format("created_at", STAMP).alias("created_at"))


@query(f"""SELECT o_orderkey AS k, strftime(o_orderdate, {SQL_STAMP}) AS created_at FROM orders
WHERE NOT {_HIT} AND o_orderdate <= least((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) - INTERVAL 25 HOUR""")
def stream_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unconfirmed drafts, emitted once the watermark is past their time to live."""
    left = jobs.drain(jobs.expired_drafts(_drafts(spark, sf_dir), _requests(spark, sf_dir), "k"), "expired")
    return left.select("k", F.date_format("created_at", STAMP).alias("created_at"))


@query(f"""WITH {checks.FILES}, {_ADMIT} SELECT *, reason IS NULL AS admitted FROM a""")
def stream_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arriving uploads through the same admission as the batch form."""
    files = file_columns(jobs.table_stream(spark, sf_dir, "documents")).drop("content")
    return jobs.admitted_uploads(files, SMALL)


_STATES = """WITH q AS (
  SELECT o_orderkey AS k, min(l_shipdate) FILTER (WHERE l_returnflag <> 'R') AS c, min(l_shipdate) FILTER (WHERE l_returnflag = 'R') AS d
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey
   AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 720 HOUR AND l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY 1)
SELECT o_orderkey AS k, CASE WHEN c <= coalesce(d, c) THEN 'confirmed' WHEN d IS NOT NULL THEN 'discarded'
       WHEN TIMESTAMP '2001-06-01' > o_orderdate + INTERVAL 720 HOUR THEN 'expired' ELSE 'open' END AS state
FROM orders LEFT JOIN q ON q.k = o_orderkey"""


@query(_STATES)
def stream_draft_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every draft from keyed state, whatever the order of the rows."""
    requests = jobs.table_stream(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_shipdate").cast("timestamp").alias("requested_at"),
        F.when(F.col("l_returnflag") == "R", "discard").otherwise("confirm").alias("action"),
    )
    events = keyed.draft_events(_drafts(spark, sf_dir), requests, "k")
    drafts = keyed.draft_changes(events, "k", jobs.run_folder(spark, "draft-states"), ttl_hours=720)
    return keyed.state_at(drafts, F.lit("2001-06-01 00:00:00").cast("timestamp"), 720).select("k", "state")


@query(f"""WITH {checks.FILES}, {_ADMIT} SELECT *, reason IS NULL AS admitted FROM a""")
def stream_admission_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets whose files arrive one source file at a time: one verdict per intake, when the announced number is there."""
    announced = file_columns(table(spark, sf_dir, "documents")).groupBy("intake_no").agg(F.count("*").alias("n_announced"))
    files = file_columns(jobs.table_stream(spark, sf_dir, "documents", maxFilesPerTrigger="1")).drop("content")
    return keyed.admitted_sets(files.join(announced, "intake_no"), jobs.run_folder(spark, "admission"), SMALL)[0]


def _life(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Orders and order lines one source file at a time, through keyed state."""
    requests = _requests(spark, sf_dir).withColumn("action", F.lit("confirm"))
    return keyed.draft_changes(keyed.draft_events(_drafts(spark, sf_dir), requests, "k"), "k", jobs.run_folder(spark, name))


@query(f"""SELECT o_orderkey AS k, strftime(o_orderdate, {SQL_STAMP}) AS created_at, strftime(min(l_shipdate), {SQL_STAMP}) AS confirmed_at
FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 24 HOUR GROUP BY 1, 2""")
def stream_confirmed_any_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``stream_confirmed`` without a watermark, so without late rows, and with the time of the confirm."""
    done = keyed.confirmed(_life(spark, sf_dir, "confirmed"), "k")
    return done.select("k", *[F.date_format(c, STAMP).alias(c) for c in ("created_at", "confirmed_at")])


@query(f"""SELECT o_orderkey AS k, strftime(o_orderdate, {SQL_STAMP}) AS created_at FROM orders
WHERE NOT {_HIT} AND o_orderdate <= TIMESTAMP '2001-06-01' - INTERVAL 24 HOUR""")
def stream_expired_any_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unconfirmed drafts whose time is over on a fixed day."""
    left = keyed.expired(_life(spark, sf_dir, "expired"), "k", F.lit("2001-06-01 00:00:00").cast("timestamp"))
    return left.select("k", F.date_format("created_at", STAMP).alias("created_at"))
