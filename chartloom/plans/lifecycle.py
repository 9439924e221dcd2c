"""Life-cycle queries: listing, confirm, expiry, erasure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom import config as c
from chartloom.functions.ids import promoted_key
from chartloom.operators import lifecycle as lc
from chartloom.operators.normalize import parse_cases
from chartloom.operators.ranking import next_match
from chartloom.plans import checks
from chartloom.plans.registry import query
from chartloom.sources import corpus

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
SQL_STAMP = "'%Y-%m-%d %H:%M:%S.%f'"
NEWEST = 50


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker documents, one in fifty unreadable, none for cancelled orders."""
    docs = corpus.case_documents(spark, sf_dir)
    cut = F.when(F.col("k") % 50 == 16, F.left("raw", F.lit(40))).otherwise(F.col("raw"))
    return parse_cases(docs.select("case_id", cut.alias("raw")))


def _prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct case prefixes as the stored file keys show them."""
    keyed = corpus.with_case_keys(corpus.table(spark, sf_dir, "orders")).where("o_orderstatus <> 'P'")
    paths = keyed.select(F.explode(F.array(
        F.concat(F.lit("bucket/cases/"), F.col("case_id"), F.lit("/a.pdf")),
        F.concat(F.lit("bucket/cases/"), F.col("case_id"), F.lit(f"/{c.MARKER_NAME}")),
    )).alias("path"))
    return paths.select(F.regexp_extract("path", "/cases/([^/]+)/", 1).alias("case_id")).distinct()


_LISTED = f"""{checks.CASES},
l AS (SELECT case_id, full_name AS patient_name, 'cases/' || case_id || '/{c.MARKER_NAME}' AS analysis_key
      FROM o WHERE o_orderstatus <> 'P' AND k%50 <> 16)"""


@query(f"WITH {_LISTED} SELECT * FROM l")
def case_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.case_listing(_prefixes(spark, sf_dir), _documents(spark, sf_dir))


@query(f"WITH {_LISTED} SELECT * FROM l ORDER BY case_id DESC LIMIT {NEWEST}")
def newest_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top of the listing: sort and limit fuse into one bounded heap per task."""
    return lc.case_listing(_prefixes(spark, sf_dir), _documents(spark, sf_dir), NEWEST)


@query(f"""WITH {_LISTED}
SELECT 'C' AS initials, patient_name AS patient, '{c.REPORT_DONE}' AS report, '{c.REVIEW_PENDING}' AS review, 'success' AS tone, true AS saved, case_id FROM l
UNION ALL
SELECT upper(left(s_name, 1)), s_name, 'Parcial', '{c.REVIEW_PENDING}', 'warning', NULL, NULL FROM supplier""")
def case_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved cases and sample rows in one bag union with aligned columns."""
    samples = corpus.table(spark, sf_dir, "supplier").select(
        F.upper(F.left("s_name", F.lit(1))).alias("initials"), F.col("s_name").alias("patient"),
        F.lit("Parcial").alias("report"), F.lit(c.REVIEW_PENDING).alias("review"), F.lit("warning").alias("tone"),
    )
    return lc.board(lc.committed_cases(_prefixes(spark, sf_dir), _documents(spark, sf_dir)), samples)


@query(f"""WITH {checks.CASES},
v AS (SELECT case_id, o_orderdate AS committed_at, 0 AS version, NULL AS part FROM o
      UNION ALL SELECT case_id, l_shipdate, l_linenumber, l_partkey FROM lineitem JOIN o ON l_orderkey = k),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY committed_at DESC, version DESC, part DESC) AS rn FROM v)
SELECT case_id, strftime(committed_at, {SQL_STAMP}) AS committed_at, CAST(version AS BIGINT) AS version, CAST(part AS BIGINT) AS part FROM r WHERE rn = 1""")
def case_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest version per case out of stored rows and later re-saves."""
    keyed = corpus.with_case_keys(corpus.table(spark, sf_dir, "orders"))
    current = keyed.select("case_id", F.col("o_orderdate").alias("committed_at"), F.lit(0).cast("bigint").alias("version"))
    incoming = (
        corpus.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "k")
        .join(keyed.select("k", "case_id"), "k")
        .select(
            "case_id", F.col("l_shipdate").alias("committed_at"),
            F.col("l_linenumber").cast("bigint").alias("version"), F.col("l_partkey").alias("part"),
        )
    )
    newest = lc.upsert_cases(current, incoming, ("committed_at", "version", "part"))
    return newest.withColumn("committed_at", F.date_format("committed_at", STAMP))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirm requests: one per order line; seventh lines ask for an unknown intake."""
    key = F.when(F.col("l_linenumber") == 7, -F.col("l_orderkey") - 1).otherwise(F.col("l_orderkey"))
    return corpus.table(spark, sf_dir, "lineitem").select(
        key.alias("k"), "l_linenumber", "l_partkey", F.col("l_shipdate").cast("timestamp").alias("requested_at")
    )


@query(f"""WITH r AS (SELECT CASE WHEN l_linenumber=7 THEN -l_orderkey-1 ELSE l_orderkey END AS k, l_linenumber, l_partkey, l_shipdate FROM lineitem)
SELECT r.k, l_linenumber, l_partkey, strftime(l_shipdate, {SQL_STAMP}) AS requested_at,
       CASE WHEN o_orderkey IS NULL THEN 'not_found' WHEN o_orderstatus='F' THEN 'already_confirmed'
            WHEN l_shipdate > o_orderdate + INTERVAL 24 HOUR OR r.k%10=7 THEN 'invalid_or_expired' ELSE 'confirmed' END AS outcome
FROM r LEFT JOIN orders ON o_orderkey = r.k""")
def confirm_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = corpus.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", "o_orderdate")
    drafts = orders.where("o_orderstatus <> 'F'").select(
        "k", F.col("o_orderdate").cast("timestamp").alias("created_at"), (F.col("k") % 10 != 7).alias("manifest_ok")
    )
    cases = orders.where("o_orderstatus = 'F'").select("k")
    answered = lc.confirm_outcome(_requests(spark, sf_dir), drafts, cases, "k")
    return answered.withColumn("requested_at", F.date_format("requested_at", STAMP))


@query(f"""SELECT CASE WHEN l_linenumber=7 THEN -l_orderkey-1 ELSE l_orderkey END AS k,
       strftime(min(l_shipdate), {SQL_STAMP}) AS requested_at, CAST(count(*) AS BIGINT) AS n_requests FROM lineitem GROUP BY 1""")
def confirm_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated confirms of one intake collapse to the first."""
    once = lc.first_requests(_requests(spark, sf_dir), "k", "requested_at")
    return once.withColumn("requested_at", F.date_format("requested_at", STAMP))


@query("""WITH q AS (
  SELECT o_orderkey AS k, min(l_shipdate) FILTER (WHERE l_returnflag <> 'R') AS c, min(l_shipdate) FILTER (WHERE l_returnflag = 'R') AS d
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey
   AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 720 HOUR AND l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY 1)
SELECT o_orderkey AS k, CASE WHEN c <= coalesce(d, c) THEN 'confirmed' WHEN d IS NOT NULL THEN 'discarded'
       WHEN TIMESTAMP '2001-06-01' > o_orderdate + INTERVAL 720 HOUR THEN 'expired' ELSE 'open' END AS state
FROM orders LEFT JOIN q ON q.k = o_orderkey""")
def draft_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as drafts with a 30-day life, order lines as confirm or discard requests, seen on a fixed day."""
    drafts = corpus.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("created_at")
    )
    requests = corpus.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_shipdate").cast("timestamp").alias("requested_at"),
        F.when(F.col("l_returnflag") == "R", "discard").otherwise("confirm").alias("action"),
    )
    as_of = F.lit("2001-06-01 00:00:00").cast("timestamp")
    return lc.draft_states(drafts, requests, "k", as_of, ttl_hours=720).select("k", "state")


_NEXT = """n AS (
  SELECT s.event_id, s.user_id, s.ts, min(p.ts) AS confirmed
  FROM (SELECT * FROM events WHERE event_type='signup') s
  LEFT JOIN (SELECT * FROM events WHERE event_type='purchase') p
    ON p.user_id = s.user_id AND p.ts BETWEEN s.ts AND s.ts + INTERVAL 24 HOUR
  GROUP BY ALL)"""


def _drafts_with_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups as drafts with the first later purchase of the same user."""
    events = corpus.table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")
    )
    micros = F.unix_micros("ts")
    matched = next_match(
        events, "user_id", micros, F.col("event_type") == "signup", F.col("event_type") == "purchase", "_next"
    )
    ttl = c.Thresholds().draft_ttl_hours * 3_600_000_000
    within = F.coalesce(F.col("_next") - micros <= ttl, F.lit(False))
    return matched.select("event_id", "user_id", "ts", F.when(within, F.timestamp_micros("_next")).alias("confirmed"))


@query(f"""WITH {_NEXT} SELECT event_id, user_id, strftime(ts, {SQL_STAMP}) AS drafted_at, strftime(confirmed, {SQL_STAMP}) AS confirmed_at FROM n WHERE confirmed IS NOT NULL""")
def confirm_within_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _drafts_with_confirm(spark, sf_dir).where("confirmed IS NOT NULL")
    return done.select(
        "event_id", "user_id", F.date_format("ts", STAMP).alias("drafted_at"),
        F.date_format("confirmed", STAMP).alias("confirmed_at"),
    )


@query(f"""WITH {_NEXT} SELECT event_id, user_id, strftime(ts, {SQL_STAMP}) AS drafted_at, strftime(ts + INTERVAL 24 HOUR, {SQL_STAMP}) AS expires_at FROM n WHERE confirmed IS NULL""")
def expired_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts without a confirm in their time to live."""
    left = _drafts_with_confirm(spark, sf_dir).where("confirmed IS NULL")
    return left.select(
        "event_id", "user_id", F.date_format("ts", STAMP).alias("drafted_at"),
        F.date_format(F.col("ts") + F.expr("INTERVAL 24 HOURS"), STAMP).alias("expires_at"),
    )


@query("""SELECT event_id FROM events WHERE event_type='signup' AND TIMESTAMP '2024-01-15 12:00:00' > ts + INTERVAL 24 HOUR""")
def stale_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweep at a fixed moment: everything strictly older than the time to live."""
    drafts = corpus.table(spark, sf_dir, "events").where("event_type = 'signup'").select(
        "event_id", F.col("ts").cast("timestamp").alias("created_at")
    )
    as_of = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return lc.expired_drafts(drafts, as_of, c.Thresholds().draft_ttl_hours).select("event_id")


def _erase_set(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, cases, ids): order lines as files, completed orders as cases, urgent orders to erase."""
    keyed = corpus.with_case_keys(corpus.table(spark, sf_dir, "orders"))
    lines = corpus.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey")
    files = lines.join(keyed.select("k", "case_id"), "k").select(
        "case_id", F.concat(F.lit("cases/"), F.col("case_id"), F.lit("/"), F.col("l_linenumber"), F.lit("-"), F.col("l_partkey")).alias("key")
    )
    cases = keyed.where("o_orderstatus <> 'O'").select("case_id")
    ids = keyed.where("o_orderpriority = '1-URGENT'").select("case_id")
    return files, cases, ids


_ERASE = f"""{checks.CASES},
i AS (SELECT case_id, k, ord.o_orderstatus FROM o JOIN orders ord ON ord.o_orderkey = o.k WHERE ord.o_orderpriority = '1-URGENT')"""


@query(f"""WITH {_ERASE},
n AS (SELECT i.case_id, CAST(count(l_orderkey) + CASE WHEN any_value(i.o_orderstatus) <> 'O' THEN 1 ELSE 0 END AS BIGINT) AS deleted_objects
      FROM i LEFT JOIN lineitem ON l_orderkey = i.k GROUP BY i.case_id)
SELECT case_id, deleted_objects, CASE WHEN deleted_objects > 0 THEN 'deleted' ELSE 'not_found' END AS outcome FROM n""")
def erase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.erased_objects(*_erase_set(spark, sf_dir))


@query(f"""WITH {checks.CASES} SELECT case_id FROM o JOIN orders ord ON ord.o_orderkey = o.k
WHERE ord.o_orderstatus <> 'O' AND ord.o_orderpriority <> '1-URGENT'""")
def erase_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cases, ids = _erase_set(spark, sf_dir)
    return lc.remove_cases(cases, ids)


@query(f"""WITH {_ERASE}
SELECT case_id, 'cases/' || case_id || '/' || l_linenumber || '-' || l_partkey AS key, 1 AS step FROM i JOIN lineitem ON l_orderkey = i.k
UNION ALL SELECT case_id, 'cases/' || case_id || '/{c.MARKER_NAME}', 2 FROM i WHERE o_orderstatus <> 'O'""")
def erase_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key to delete with its step: files in step one, markers in step two."""
    return lc.erase_order(*_erase_set(spark, sf_dir))


@query(f"""WITH {checks.CASES},
d AS (SELECT intake_id, o.k FROM o JOIN orders ord ON ord.o_orderkey = o.k WHERE ord.o_orderpriority = '1-URGENT' AND ord.o_orderstatus <> 'F')
SELECT intake_id, 'drafts/' || intake_id || '/' || l_linenumber AS key FROM d JOIN lineitem ON l_orderkey = d.k WHERE l_returnflag <> 'R'
UNION ALL SELECT intake_id, 'drafts/' || intake_id || '/{c.DRAFT_MARKER_NAME}' FROM d""")
def discard_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of discarded drafts; files outside the own prefix stay, absent drafts give nothing."""
    keyed = corpus.with_case_keys(corpus.table(spark, sf_dir, "orders"))
    lines = corpus.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_returnflag")
    area = F.when(F.col("l_returnflag") == "R", "cases/").otherwise("drafts/")
    files = lines.join(keyed.select("k", "intake_id"), "k").select(
        "intake_id", F.concat(area, F.col("intake_id"), F.lit("/"), F.col("l_linenumber")).alias("key")
    )
    drafts = keyed.where("o_orderstatus <> 'F'").select("intake_id")
    ids = keyed.where("o_orderpriority = '1-URGENT'").select("intake_id")
    return lc.discard_keys(drafts, files, ids)


@query(f"""WITH {checks.CASES} SELECT intake_id, case_id, 'cases/' || case_id || '/x-' || k || '.pdf' AS key FROM o WHERE o_orderstatus = 'F'""")
def promoted_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed drafts become cases and their files move to the case area."""
    keyed = corpus.with_case_keys(corpus.table(spark, sf_dir, "orders")).where("o_orderstatus = 'F'")
    drafts = keyed.select(
        "intake_id", F.concat(F.lit("drafts/"), F.col("intake_id"), F.lit("/x-"), F.col("k"), F.lit(".pdf")).alias("draft_key")
    )
    moved = lc.promote(drafts)
    return moved.select("intake_id", "case_id", promoted_key(F.col("case_id"), F.col("draft_key")).alias("key"))
