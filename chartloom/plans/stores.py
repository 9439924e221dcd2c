"""Queries that write tables or objects to the shared folder, change them and read them back."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom import config as c
from chartloom.config import Limits
from chartloom.functions import text
from chartloom.functions.variants import at
from chartloom.operators import lifecycle as lc
from chartloom.operators.lineage import enriched_document, gather_files, owned_sources, source_entries, with_defaults
from chartloom.operators.staging import stage
from chartloom.plans import checks
from chartloom.plans.intake import _TOKEN
from chartloom.plans.registry import query
from chartloom.session import shared_dir
from chartloom.sources import corpus, inventory
from chartloom.sources import tables as tb
from chartloom.sources.generations import MONTHLY
from chartloom.sources.files import scan_files


def _root(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a short case document; completed ones are version 1."""
    keyed = corpus.with_case_keys(corpus.table(spark, sf_dir, "orders"))
    body = F.to_json(F.struct(F.struct(F.concat(F.lit("Customer#"), F.col("o_custkey")).alias("full_name")).alias("patient"), "k"))
    return keyed.select("case_id", "intake_id", "k", "o_orderpriority", F.parse_json(body).alias("analysis"))


def _lines(spark: SparkSession, sf_dir: str, owner: str, area: str) -> DataFrame:
    """Order lines as file rows of their order's case or intake."""
    keyed = corpus.with_case_keys(corpus.table(spark, sf_dir, "orders")).select("k", owner)
    lines = corpus.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey")
    key = F.concat(F.lit(f"{area}/"), F.col(owner), F.lit("/"), F.col("l_linenumber"), F.lit("-"), F.col("l_partkey"), F.lit(".pdf"))
    return lines.join(keyed, "k").select(owner, F.col("l_linenumber").alias("file_index"), key.alias("key")).distinct()


_FILES = "f AS (SELECT l_orderkey, count(DISTINCT (l_linenumber, l_partkey)) AS n FROM lineitem GROUP BY 1)"


def _summary(spark: SparkSession, root: str) -> DataFrame:
    names = tb.read_cases(spark, root).select("case_id", at(F.col("analysis"), "patient.full_name", "string").alias("full_name"))
    files = tb.read_files(spark, root).groupBy("case_id").agg(F.count("*").alias("n_files"))
    return names.join(files, "case_id", "left").select("case_id", "full_name", F.coalesce("n_files", F.lit(0)).alias("n_files"))


@query(f"""WITH {checks.CASES}, {_FILES}
SELECT case_id, 'Customer#' || o_custkey AS full_name, CAST(coalesce(n, 0) AS BIGINT) AS n_files FROM o LEFT JOIN f ON l_orderkey = k""")
def commit_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cases committed with their files, twice, and read back."""
    root = _root(spark, "commit")
    cases, files = _cases(spark, sf_dir).select("case_id", "analysis"), stage(_lines(spark, sf_dir, "case_id", "drafts"), "commit-files")
    tb.commit_cases(cases, files, root, MONTHLY)
    tb.commit_cases(cases, files, root, MONTHLY)
    return _summary(spark, root)


@query(f"""WITH {checks.CASES}, {_FILES},
g AS (SELECT o.*, ord.o_orderpriority = '1-URGENT' AS gone FROM o JOIN orders ord ON ord.o_orderkey = o.k)
SELECT case_id, CASE WHEN gone THEN 'deleted' ELSE 'kept' END AS outcome, CAST(coalesce(n, 0) + gone::INT AS BIGINT) AS n_objects
FROM g LEFT JOIN f ON l_orderkey = k
UNION ALL SELECT 'case-none', 'not_found', 0""")
def erase_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent cases erased for good and asked for again, one unknown id among them; the others read back."""
    root = _root(spark, "erase")
    cases = _cases(spark, sf_dir)
    tb.commit_cases(cases.select("case_id", "analysis"), _lines(spark, sf_dir, "case_id", "drafts"), root, MONTHLY)
    unknown = spark.range(1).select(F.lit("case-none").alias("case_id"))
    ids = stage(cases.where("o_orderpriority = '1-URGENT'").select("case_id").union(unknown), "erase-ids")
    answer = tb.erase_cases(spark, root, ids, MONTHLY)
    tb.erase_cases(spark, root, ids, MONTHLY)
    tb.purge(spark, root)
    erased = answer.select("case_id", "outcome", F.col("deleted_objects").alias("n_objects"))
    kept = _summary(spark, root).select("case_id", F.lit("kept").alias("outcome"), F.col("n_files").alias("n_objects"))
    return erased.unionByName(kept)


@query(f"""WITH {checks.CASES}, {_FILES}
SELECT intake_id, strftime(o.o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at, CAST(coalesce(n, 0) AS BIGINT) AS n_files
FROM o JOIN orders ord ON ord.o_orderkey = k LEFT JOIN f ON l_orderkey = k WHERE ord.o_orderpriority <> '2-HIGH'""")
def discard_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts staged, some discarded, also twice and with unknown ids; the others read back with their files."""
    root = _root(spark, "discard")
    keyed = corpus.with_case_keys(corpus.table(spark, sf_dir, "orders"))
    drafts = keyed.select("intake_id", F.col("o_orderdate").cast("timestamp").alias("created_at"), F.lit("{}").alias("analysis"))
    tb.write_drafts(drafts, _lines(spark, sf_dir, "intake_id", "drafts"), root, MONTHLY)
    ids = keyed.where("o_orderpriority = '2-HIGH'").select("intake_id")
    tb.discard_drafts(spark, root, ids.union(spark.range(1).select(F.lit("intake-none"))), MONTHLY)
    tb.discard_drafts(spark, root, ids, MONTHLY)
    files = tb.read_draft_files(spark, root).groupBy("intake_id").agg(F.count("*").alias("n_files"))
    rows = tb.read_drafts(spark, root).join(files, "intake_id", "left")
    return rows.select("intake_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.coalesce("n_files", F.lit(0)).alias("n_files"))


@query(f"""WITH {checks.CASES},
v AS (SELECT k, 1 AS version, -1 AS part FROM o UNION ALL SELECT l_orderkey, l_linenumber + 1, max(l_partkey) FROM lineitem GROUP BY 1, 2),
w AS (SELECT k, max(version) AS version, max_by(part, version) AS part FROM v GROUP BY k)
SELECT case_id, CAST(version AS BIGINT) AS version, CAST(part AS BIGINT) AS part FROM w JOIN o USING (k)""")
def upsert_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases saved again and again, even versions first: the highest version stays in whatever order they come."""
    root = _root(spark, "upsert")
    keyed = corpus.with_case_keys(corpus.table(spark, sf_dir, "orders")).select("k", "case_id")
    lines = corpus.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") + 1).cast("bigint").alias("version")).agg(
        F.max("l_partkey").alias("part"))
    saved = lines.unionByName(keyed.select("k", F.lit(1).cast("bigint").alias("version"), F.lit(-1).cast("bigint").alias("part"))).join(keyed, "k")
    rows = saved.select("case_id", "version", F.parse_json(F.to_json(F.struct("part"))).alias("analysis"))
    files = spark.createDataFrame([], "case_id string, file_index int, key string")
    for delivery in (rows.where("version % 2 = 0"), rows.where("version % 2 = 1")):
        tb.commit_cases(delivery, files, root, MONTHLY)
    return tb.read_cases(spark, root).select("case_id", "version", at(F.col("analysis"), "part", "bigint").alias("part"))


def _intake_id(number: Column) -> Column:
    return F.concat(F.lit("intake-20240301T000000Z-"), F.lower(F.lpad(F.hex(number), 8, "0")))


@query(f"""WITH {checks.ATTACHED}
SELECT 'case-20240301T000000Z-' || printf('%08x', intake_no) AS case_id, file_index AS index,
       'cases/case-20240301T000000Z-' || printf('%08x', intake_no) || '/' || {_TOKEN} || '-' || replace(filename, ' ', '-') AS path,
       content_type AS type, exam, eye, sha256, size_bytes, '1.0' AS schema_version FROM att""")
def ingest_to_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction results and uploads to drafts, verified and confirmed to cases; read back, every file is its case's own."""
    root = _root(spark, "ingest")
    _stage_drafts(spark, sf_dir, root)
    requests = tb.read_drafts(spark, root).select("intake_id", F.lit("2024-03-01 01:00:00").cast("timestamp").alias("requested_at"))
    tb.confirm_drafts(spark, root, requests, period=MONTHLY)
    saved = tb.read_cases(spark, root)
    version = at(F.col("analysis"), "schema_version", "string")
    shape = "array<struct<sha256: string, size_bytes: bigint>>"
    own = owned_sources(source_entries(saved.select("case_id", "analysis", version.alias("v"), at(F.col("analysis"), "source_files", shape).alias("more")), keep=("v", "more")))
    entry = F.get("more", F.col("index").cast("int"))
    return own.select("case_id", "index", "path", "type", "exam", "eye", entry["sha256"].alias("sha256"), entry["size_bytes"].alias("size_bytes"), F.col("v").alias("schema_version"))


def _stage_drafts(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Every intake as a stored draft whose document names all of its uploads."""
    stored = text.safe_name(F.col("filename"), text.token(F.col("intake_no"), F.col("file_index"), F.col("filename")))
    files = corpus.intake_files(spark, sf_dir).select(
        "intake_no", "file_index", "filename", "content_type", "size_bytes", text.sha256(F.col("content")).alias("sha256"),
        F.concat(F.lit("drafts/"), _intake_id(F.col("intake_no")), F.lit("/"), stored).alias("key"),
    )
    listed = corpus.extracted_sources(spark, sf_dir).groupBy("intake_no").agg(
        F.array_sort(F.collect_list(F.struct("source_pos", "path", "filename", "exam", "eye"))).alias("source_files"))
    extracted = listed.select("intake_no", F.to_json(F.struct(F.struct(F.lit("x").alias("full_name")).alias("patient"), "source_files")).alias("raw"))
    documents = gather_files(files).join(extracted, "intake_no", "left").select(
        _intake_id(F.col("intake_no")).alias("intake_id"), "_uploads", F.parse_json(F.coalesce("raw", F.lit("{}"))).alias("analysis"),
    )
    drafts = documents.select(
        "intake_id", F.lit("2024-03-01 00:00:00").cast("timestamp").alias("created_at"), F.col("_uploads").alias("files"),
        with_defaults(enriched_document(F.col("analysis"), F.col("_uploads")), dt.date(2024, 3, 1)).alias("analysis"),
    )
    draft_files = files.select(_intake_id(F.col("intake_no")).alias("intake_id"), "file_index", "filename", "sha256", "key")
    tb.write_drafts(drafts, draft_files, root, MONTHLY)


@query(f"""WITH {checks.FILES}, i AS (SELECT intake_no, count(*) AS n FROM f GROUP BY 1),
r AS (SELECT 'intake-20240301T000000Z-' || printf('%08x', intake_no) AS intake_id, intake_no % 5 = 0 AS late, n FROM i)
SELECT intake_id, CASE WHEN late THEN 'invalid_or_expired' ELSE 'confirmed' END AS first_answer,
       CASE WHEN late THEN 'invalid_or_expired' ELSE 'already_confirmed' END AS second_answer, late AS swept,
       CAST(CASE WHEN late THEN 0 ELSE n END AS BIGINT) AS n_files FROM r""")
def confirm_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts confirmed in time or too late, asked for again, and the late ones swept; what each became."""
    root = _root(spark, "confirm")
    _stage_drafts(spark, sf_dir, root)
    number = F.conv(F.substring_index("intake_id", "-", -1), 16, 10).cast("bigint")
    hours = F.when(number % 5 == 0, 48).otherwise(1)
    created = F.lit("2024-03-01 00:00:00").cast("timestamp")
    requests = stage(tb.read_drafts(spark, root).select("intake_id", (created + F.make_dt_interval(hours=hours)).alias("requested_at")), "requests")
    first, second = (tb.confirm_drafts(spark, root, requests, period=MONTHLY) for _ in range(2))
    swept = tb.sweep_drafts(spark, root, F.lit("2024-03-04 00:00:00").cast("timestamp"), period=MONTHLY).withColumn("swept", F.lit(True))
    files = tb.read_files(spark, root).groupBy(F.replace("case_id", F.lit("case-"), F.lit("intake-")).alias("intake_id")).agg(F.count("*").alias("n_files"))
    answers = first.select("intake_id", F.col("outcome").alias("first_answer")).join(second.select("intake_id", F.col("outcome").alias("second_answer")), "intake_id")
    return answers.join(swept, "intake_id", "left").join(files, "intake_id", "left").select(
        "intake_id", "first_answer", "second_answer", F.coalesce("swept", F.lit(False)).alias("swept"), F.coalesce("n_files", F.lit(0)).alias("n_files"),
    )


@query("""WITH o AS (SELECT *, 'intake-' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || '-' || printf('%08x', o_orderkey) AS id FROM orders),
r AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey, l_shipdate, CASE WHEN l_linenumber = 6 THEN replace(id, 'Z', '') WHEN l_linenumber = 7 THEN left(id, 24) || 'ffffffff' ELSE id END AS intake_id
      FROM lineitem JOIN o ON l_orderkey = o_orderkey)
SELECT intake_id, n, r.l_partkey AS part, CASE WHEN n = 6 THEN 'invalid_id' WHEN n = 7 THEN 'not_found' WHEN o_orderstatus = 'F' THEN 'already_confirmed'
       WHEN k % 9 = 4 THEN 'undecodable' WHEN l_shipdate > o_orderdate + INTERVAL 720 HOUR OR k % 10 = 7 THEN 'invalid_or_expired' ELSE 'confirmed' END AS outcome
FROM r JOIN orders ON o_orderkey = k""")
def confirm_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every confirm request with one of six answers; drafts of completed orders are gone, their cases there."""
    keyed = corpus.with_case_keys(corpus.table(spark, sf_dir, "orders"))
    number = F.col("l_linenumber")
    asked = F.when(number == 6, F.replace("intake_id", F.lit("Z"), F.lit(""))).when(number == 7, F.concat(F.left("intake_id", F.lit(24)), F.lit("ffffffff"))).otherwise(F.col("intake_id"))
    lines = corpus.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "k").join(keyed.select("k", "intake_id"), "k")
    requests = lines.select(asked.alias("intake_id"), number.alias("n"), F.col("l_partkey").alias("part"), F.col("l_shipdate").cast("timestamp").alias("requested_at"))
    drafts = keyed.where("o_orderstatus <> 'F'").select(
        "intake_id", F.col("o_orderdate").cast("timestamp").alias("created_at"), (F.col("k") % 10 != 7).alias("manifest_ok"),
        F.try_parse_json(F.when(F.col("k") % 9 == 4, "{").otherwise('{"files":[]}')).alias("analysis"),
    )
    cases = keyed.where("o_orderstatus = 'F'").select("case_id")
    return lc.route_confirms(requests, drafts, cases, ttl_hours=720).select("intake_id", "n", "part", "outcome")


@query(f"""WITH {checks.CASES}, l AS (SELECT case_id, k, 1 + k % 40 AS d FROM o)
SELECT case_id, '{{' || (SELECT string_agg(chr(10) || repeat('  ', i) || '"a": {{', '' ORDER BY i) FROM range(1, d + 1) t(i))
  || chr(10) || repeat('  ', d + 1) || '"e": {{}},' || chr(10) || repeat('  ', d + 1) || '"s": [' || chr(10) || repeat('  ', d + 2) || '1,'
  || chr(10) || repeat('  ', d + 2) || '"x, {{y}}: "' || chr(10) || repeat('  ', d + 1) || '],' || chr(10) || repeat('  ', d + 1) || '"x": ' || k
  || (SELECT string_agg(chr(10) || repeat('  ', d + 1 - i) || '}}', '' ORDER BY i) FROM range(1, d + 1) t(i)) || chr(10) || '}}' AS document
FROM l""")
def pretty_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of 1 to 40 levels written indented, keyed by their case, and read back."""
    keyed = corpus.with_case_keys(corpus.spread(corpus.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")))
    depth = "cast(1 + k % 40 as int)"
    raw = F.expr(f"""concat(repeat('{{"a":', {depth}), '{{"x":', k, ',"s":[1,"x, {{y}}: "],"e":{{}}}}', repeat('}}', {depth}))""")
    path = _root(spark, "pretty")
    tb.write_pretty(keyed.select("case_id", F.parse_json(raw).alias("analysis")), path)
    return spark.read.schema("case_id string, document string").json(path)


_OBJECTS = f"""{checks.CASES},
b AS (SELECT 'drafts/intake-' || doc_id // 4 || '/' || doc_id || '.pdf' AS key, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes FROM documents
      UNION ALL SELECT 'cases/' || case_id || '/{c.MARKER_NAME}', k FROM o UNION ALL SELECT 'cases/' || case_id || '/a.pdf', 1 FROM o)"""


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads and cases as one stored inventory."""
    number = F.expr("doc_id div 4")
    drafts = corpus.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("drafts/intake-"), number, F.lit("/"), F.col("doc_id"), F.lit(".pdf")).alias("key"), F.octet_length("text").cast("bigint").alias("size_bytes")
    )
    keyed = corpus.with_case_keys(corpus.table(spark, sf_dir, "orders"))
    base = F.concat(F.lit("cases/"), F.col("case_id"), F.lit("/"))
    objects = F.array(
        F.struct(F.concat(base, F.lit(c.MARKER_NAME)).alias("key"), F.col("k").alias("size_bytes")),
        F.struct(F.concat(base, F.lit("a.pdf")).alias("key"), F.lit(1).cast("bigint").alias("size_bytes")),
    )
    path = _root(spark, "inventory")
    inventory.write_inventory(drafts.unionByName(keyed.select(F.inline(objects))), path)
    return inventory.read_inventory(spark, path)


@query(f"WITH {_OBJECTS} SELECT key, size_bytes FROM b WHERE starts_with(key, 'drafts/')")
def object_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object under one prefix, from the key range of a stored inventory."""
    return inventory.under_prefix(_inventory(spark, sf_dir), "drafts/").select("key", "size_bytes")


@query(f"""WITH {_OBJECTS} SELECT split_part(key, '/', 2) AS name, CAST(count(*) AS BIGINT) AS n_objects, CAST(sum(size_bytes) AS BIGINT) AS total_bytes
FROM b WHERE starts_with(key, 'cases/') GROUP BY 1""")
def child_prefixes_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case folders with their objects and bytes."""
    return inventory.child_prefixes(_inventory(spark, sf_dir), "cases/")


PAGES = 5


@query(f"""WITH {_OBJECTS}, r AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS place, count(*) OVER () AS n FROM b WHERE starts_with(key, 'cases/'))
SELECT key, CAST(place // ((n + {PAGES - 1}) // {PAGES}) AS INTEGER) AS page FROM r""")
def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chained pages: each one asks for the next objects after the last key of the one before."""
    stored = _inventory(spark, sf_dir)
    size = -(-inventory.under_prefix(stored, "cases/").count() // PAGES)
    after, found = None, None
    for number in range(PAGES):
        page = stage(inventory.next_page(stored, "cases/", after, max(1, size)), "page").select("key", F.lit(number).alias("page"))
        after = page.agg(F.max("key")).first()[0] or after
        found = page if found is None else found.unionByName(page)
    return found


SMALL_FILE = 21


@query(f"""SELECT s_suppkey, CAST(strlen(s_name || '-' || s_nationkey) + 1 AS BIGINT) AS size_bytes,
       CASE WHEN strlen(s_name || '-' || s_nationkey) + 1 <= {SMALL_FILE} THEN sha256(s_name || '-' || s_nationkey || chr(10)) END AS sha256,
       CASE WHEN strlen(s_name || '-' || s_nationkey) + 1 <= {SMALL_FILE} THEN 'hashed' ELSE 'too_large' END AS state FROM supplier""")
def stored_file_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written and scanned as a set: size, hash within the size bound, and what became of the others."""
    path = _root(spark, "files")
    rows = corpus.table(spark, sf_dir, "supplier").select("s_suppkey", F.concat("s_name", F.lit("-"), "s_nationkey").alias("value"))
    # With their number given, the parts stay: narrow rows would be put into one task, which would create all files alone.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(parts, "s_suppkey").write.partitionBy("s_suppkey").text(path)
    scanned = scan_files(spark, path, Limits(max_file=SMALL_FILE)).where(F.col("filename").startswith("part-"))
    number = F.regexp_extract("path", "s_suppkey=([0-9]+)", 1).cast("bigint")
    return scanned.select(number.alias("s_suppkey"), "size_bytes", "sha256", "state")


@query(f"""WITH {checks.CASES}, l AS (SELECT case_id, full_name FROM o WHERE o_orderstatus <> 'P')
SELECT case_id AS "caseId", full_name AS "patientName", 'cases/' || case_id || '/{c.MARKER_NAME}' AS "analysisKey" FROM l
UNION ALL SELECT case_id, NULL, NULL FROM o WHERE o_orderstatus = 'P'""")
def listing_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case list as JSON lines under its fixed names, null fields kept, and read back."""
    keyed = corpus.with_case_keys(corpus.table(spark, sf_dir, "orders"))
    known = F.col("o_orderstatus") != "P"
    listing = keyed.select(
        "case_id", F.when(known, F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).alias("patient_name"),
        F.when(known, F.concat(F.lit("cases/"), F.col("case_id"), F.lit(f"/{c.MARKER_NAME}"))).alias("analysis_key"),
    )
    path = _root(spark, "listing")
    tb.write_listing(listing, path)
    lines = spark.read.text(path)
    # A null field that was left out would leave the row out here.
    kept = lines.where(F.contains(F.col("value"), F.lit('"patientName":')) & F.contains(F.col("value"), F.lit('"analysisKey":')))
    return kept.select(F.from_json("value", "caseId string, patientName string, analysisKey string").alias("r")).select("r.*")
