"""Intake queries: ids, contract, admission, lineage, requests and responses."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.config import Limits
from chartloom.functions import ids, text
from chartloom.functions.variants import at
from chartloom.operators.admission import admit
from chartloom.operators.contract import check_contract, is_preview
from chartloom.operators.lineage import enriched_sources, promote_sources, verify_manifest, with_defaults
from chartloom.operators.normalize import parse_cases
from chartloom.operators.ranking import position_in_group
from chartloom.plans import checks
from chartloom.plans.registry import query
from chartloom.sources import corpus
from chartloom.sources.extraction import fold_responses, request_lines, request_parts

SMALL = Limits(max_file=8_000, max_set=12_000)
PROMPT = "Leia os exames e devolva um objeto JSON."
MODEL = "extractor-1"

_MUTATE = """CASE k%12 WHEN 1 THEN replace(intake_id, 'intake-', 'case-') WHEN 2 THEN intake_id || '0'
 WHEN 3 THEN replace(intake_id, 'T', 'Q') WHEN 4 THEN concat(left(intake_id, 11), '13', substr(intake_id, 14))
 WHEN 5 THEN concat(left(intake_id, length(intake_id)-8), 'zz', right(intake_id, 6)) WHEN 6 THEN concat(intake_id, '-x')
 WHEN 7 THEN concat(left(intake_id, length(intake_id)-8), upper(right(intake_id, 8))) WHEN 8 THEN '../../case'
 WHEN 9 THEN replace(intake_id, 'Z', '.25Z') ELSE intake_id END"""


@query(f"""WITH {checks.CASES},
m AS (SELECT k, {_MUTATE} AS id FROM o),
v AS (SELECT k, id, regexp_full_match(id, 'intake-[0-9]{{8}}T[0-9]{{6}}([.,][0-9]+)?Z-[0-9A-Fa-f]{{8}}')
        AND try_strptime(substr(id, 8, 15), '%Y%m%dT%H%M%S') IS NOT NULL AS valid FROM m)
SELECT k, id, valid AS valid_intake, 'case-' || CASE WHEN starts_with(id, 'intake-') THEN substr(id, 8) ELSE id END AS case_id,
       valid AS valid_case FROM v""")
def id_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = corpus.with_case_keys(corpus.table(spark, sf_dir, "orders")).select("k", F.expr(_MUTATE).alias("id"))
    case_id = ids.case_id_of(F.col("id"))
    return keyed.select(
        "k", "id", ids.valid_intake_id(F.col("id")).alias("valid_intake"), case_id.alias("case_id"),
        ids.valid_case_id(case_id).alias("valid_case"),
    )


_REASON = """CASE k%50 WHEN 11 THEN 'patient' WHEN 12 THEN 'exams' WHEN 13 THEN 'unknown_key' WHEN 14 THEN 'source'
 WHEN 15 THEN 'source' WHEN 16 THEN 'json' WHEN 17 THEN 'json' WHEN 18 THEN 'json' WHEN 21 THEN 'exam' WHEN 22 THEN 'json' WHEN 23 THEN 'json' END"""


@query(f"""WITH {checks.CASES}
SELECT case_id, k, {_REASON} IS NULL AS is_valid, {_REASON} AS reason,
       CASE WHEN k%50=13 THEN 'pentacam' WHEN k%50 IN (14,15,21) THEN 'pentacam_corneal_tomography' END AS offending_key,
       CASE WHEN k%50=13 THEN 'pentacam' WHEN k%50 IN (12,16,17,18,22,23) THEN NULL ELSE '' END AS unknown_keys
FROM o""")
def contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_contract(corpus.contract_documents(spark, sf_dir))


@query("""SELECT o_orderkey AS k, o_orderkey%6 IN (0,5) AS is_preview FROM orders""")
def preview_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape test on preview envelopes, four of six broken in one field each."""
    shape = """CASE k%6 WHEN 1 THEN '{"intakeId":1,"files":[],"analysis":{},"message":"m"}'
      WHEN 2 THEN '{"intakeId":"i","files":{},"analysis":{},"message":"m"}'
      WHEN 3 THEN '{"intakeId":"i","files":[],"analysis":null,"message":"m"}'
      WHEN 4 THEN '{"intakeId":"i","files":[],"analysis":{}}'
      WHEN 5 THEN '{"intakeId":"i","files":[],"analysis":[],"message":"m"}'
      ELSE concat('{"intakeId":"', k, '","files":[{"filename":"a"}],"analysis":{"x":1},"message":"m"}') END"""
    rows = corpus.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).select(
        "k", F.expr(f"try_parse_json({shape})").alias("doc")
    )
    return rows.select("k", is_preview(F.col("doc")).alias("is_preview"))


@query(f"""WITH {checks.CASES} SELECT case_id, '1.0' AS schema_version, strftime(o_orderdate, '%Y-%m-%d') AS generated_on,
       'pt-BR' AS language FROM o""")
def envelope_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = parse_cases(corpus.case_documents(spark, sf_dir))
    filled = cases.select("case_id", with_defaults(F.col("analysis"), dt.date(2024, 6, 15)).alias("d"))
    return filled.select("case_id", *[
        at(F.col("d"), name, "string").alias(name) for name in ("schema_version", "generated_on", "language")
    ])


@query(f"""WITH {checks.FILES}
SELECT doc_id, intake_no, file_index, filename, content_type, size_bytes, sha256,
       printf('%.2f', size_bytes/1048576.0::DOUBLE) AS megabytes,
       CASE split_part(filename, '.', -1) WHEN 'pdf' THEN 'pdf' WHEN 'png' THEN 'png' ELSE 'jpeg' END AS icon FROM f""")
def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.intake_files(spark, sf_dir)
    return files.select(
        "doc_id", "intake_no", "file_index", "filename", "content_type", "size_bytes",
        text.sha256(F.col("content")).alias("sha256"), text.megabytes(F.col("size_bytes")).alias("megabytes"),
        text.file_kind(F.col("filename")).alias("icon"),
    )


_ADMIT = f"""t AS (
  SELECT intake_no, CAST(count(*) AS BIGINT) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes,
         CAST(sum(size_bytes + strlen(filename) + strlen(content_type)) AS BIGINT) AS body,
         min(file_index) FILTER (WHERE content_type='text/plain' OR size_bytes > {SMALL.max_file}) AS bad,
         min_by(CASE WHEN content_type='text/plain' THEN 'type' ELSE 'size' END, file_index)
           FILTER (WHERE content_type='text/plain' OR size_bytes > {SMALL.max_file}) AS bad_reason
  FROM f GROUP BY intake_no),
a AS (SELECT intake_no, n_files, total_bytes,
        CASE WHEN body > {SMALL.max_body} THEN 'body' WHEN bad IS NOT NULL THEN bad_reason WHEN total_bytes > {SMALL.max_set} THEN 'set' END AS reason,
        CASE WHEN body <= {SMALL.max_body} THEN CAST(bad AS BIGINT) END AS first_bad_index FROM t)"""


@query(f"""WITH {checks.FILES}, {_ADMIT} SELECT *, reason IS NULL AS admitted FROM a""")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admit(corpus.intake_files(spark, sf_dir).drop("content"), SMALL)


@query(f"""WITH {checks.ATTACHED}
SELECT intake_no, file_index AS index, filename AS path, content_type AS type, size_bytes, sha256, exam, eye FROM att""")
def enrich_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched_sources(_hashed_files(spark, sf_dir), corpus.extracted_sources(spark, sf_dir))


def _hashed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with their hash and draft key; the bytes go no further than this projection."""
    stored = text.safe_name(F.col("filename"), text.token(F.col("intake_no"), F.col("file_index"), F.col("filename")))
    return corpus.intake_files(spark, sf_dir).select(
        "intake_no", "file_index", "filename", "content_type", "size_bytes",
        text.sha256(F.col("content")).alias("sha256"),
        F.concat(F.lit("drafts/intake-"), F.col("intake_no"), F.lit("/"), stored).alias("key"),
    )


_TOKEN = "substr(sha256(concat_ws(chr(1), intake_no, file_index, filename)), 1, 8)"


@query(f"""WITH {checks.FILES},
v AS (SELECT intake_no, CASE WHEN doc_id%19 = 3 THEN 2 WHEN doc_id%13 = 4 OR doc_id%17 = 2 THEN 1 ELSE 0 END AS faults FROM f)
SELECT intake_no, sum(faults) = 0 AS matches, CAST(sum(faults) AS BIGINT) AS n_faults FROM v GROUP BY intake_no""")
def verify_manifest_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest check against entries with a changed hash, a changed name or another position."""
    files = _hashed_files(spark, sf_dir)
    doc_id = F.col("intake_no") * 4 + F.col("file_index")
    sources = files.select(
        "intake_no", (F.col("file_index") + F.when(doc_id % 19 == 3, 1000).otherwise(0)).alias("index"),
        F.when(doc_id % 17 == 2, F.concat(F.lit("other-"), F.col("filename"))).otherwise(
            F.concat(F.lit("uploads/"), F.col("filename"))
        ).alias("path"),
        F.when(doc_id % 13 == 4, F.lit("0")).otherwise(F.col("sha256")).alias("sha256"),
    )
    return verify_manifest(files, sources)


@query(f"""WITH {checks.ATTACHED}
SELECT 'case-' || intake_no AS case_id, intake_no, file_index AS index,
       'cases/case-' || intake_no || '/' || {_TOKEN} || '-' || replace(filename, ' ', '-') AS path, exam, eye FROM att""")
def promoted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source paths rewritten to the case keys of the promoted files, position by position."""
    files = _hashed_files(spark, sf_dir)
    sources = enriched_sources(files, corpus.extracted_sources(spark, sf_dir))
    moved = promote_sources(sources, files, F.concat(F.lit("case-"), F.col("intake_no")))
    return moved.select("case_id", "intake_no", "index", "path", "exam", "eye")


@query(f"""WITH {checks.FILES}
SELECT doc_id, 'drafts/intake-' || intake_no || '/' || {_TOKEN} || '-' || replace(filename, ' ', '-') AS key,
       'drafts%2Fintake-' || intake_no || '%2F' || {_TOKEN} || '-' || replace(filename, ' ', '-') AS copy_source,
       replace(filename, ' ', '%20') AS escaped FROM f""")
def storage_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _hashed_files(spark, sf_dir)
    return files.select(
        (F.col("intake_no") * 4 + F.col("file_index")).alias("doc_id"), "key",
        text.path_escape(F.col("key")).alias("copy_source"), text.path_escape(F.col("filename")).alias("escaped"),
    )


@query(f"""WITH {checks.FILES} SELECT sha256, CAST(count(*) AS BIGINT) AS copies, CAST(min(doc_id) AS BIGINT) AS first_doc FROM f GROUP BY sha256""")
def dup_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies per content hash; counts combine map-side, so a hash with very many copies is cheap."""
    files = corpus.intake_files(spark, sf_dir).select("doc_id", text.sha256(F.col("content")).alias("sha256"))
    return files.groupBy("sha256").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


@query("""SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS upload_index FROM documents""")
def upload_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable position of each document within its source; one source may hold most rows."""
    rows = corpus.table(spark, sf_dir, "documents").select("doc_id", "source")
    return position_in_group(rows, "source", "doc_id", "upload_index", cell_bits=12)


_OUTCOME = """CASE WHEN conv_id%11=5 AND turn%3=1 THEN 'invalid' WHEN conv_id%7=3 THEN 'failed' WHEN role='system' THEN 'incomplete'
 WHEN role='assistant' AND conv_id%9=4 THEN 'refused' ELSE 'ok' END"""


@query(f"""WITH r AS (SELECT conv_id, turn, {_OUTCOME} AS outcome, text AS t FROM conversations)
SELECT conv_id, turn, outcome, CASE WHEN outcome='ok' THEN replace(t, chr(10), '') END AS text,
       CASE outcome WHEN 'refused' THEN 'declined' WHEN 'failed' THEN CASE WHEN turn%2=0 THEN 'overloaded' ELSE 'HTTP 503' END END AS detail FROM r""")
def response_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as one extraction response: lines become text parts, some refused, failed or cut."""
    refused = (F.col("role") == "assistant") & (F.col("conv_id") % 9 == 4)
    failed = F.col("conv_id") % 7 == 3

    def part(kind, value, refusal):
        return F.struct(kind.alias("type"), value.alias("text"), refusal.alias("refusal"))

    lines = F.transform(F.split("text", "\n"), lambda line: part(F.lit("output_text"), line, F.lit("")))
    note = F.array(part(F.lit("reasoning"), F.lit("hidden"), F.lit("")))
    refusal = F.array(part(F.lit("refusal"), F.lit(""), F.lit("declined")))
    body = F.struct(
        F.when(F.col("role") == "system", "incomplete").otherwise("completed").alias("status"),
        F.array(
            F.struct(F.lit("reasoning").alias("type"), note.alias("content")),
            F.struct(F.lit("message").alias("type"), F.when(refused, F.concat(lines, refusal)).otherwise(lines).alias("content")),
        ).alias("output"),
        F.when(failed & (F.col("turn") % 2 == 0), F.struct(F.lit("overloaded").alias("message"))).alias("error"),
    )
    raw = F.to_json(body)
    cut = (F.col("conv_id") % 11 == 5) & (F.col("turn") % 3 == 1)
    responses = corpus.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        F.when(failed, 503).otherwise(200).alias("http_status"),
        F.when(cut, F.left(raw, F.length(raw) - F.lit(2))).otherwise(raw).alias("raw"),
    )
    return fold_responses(responses)


_LABEL_PART = """'{"type":"input_text","text":"Arquivo seguinte: ' || filename || '"}'"""
_URL = "'data:' || content_type || ';base64,' || to_base64(encode(text))"
_BODY_PART = f"""CASE WHEN starts_with(content_type, 'image/') THEN '{{"type":"input_image","image_url":"' || {_URL} || '","detail":"high"}}'
 WHEN content_type='application/pdf' THEN '{{"type":"input_file","filename":"' || filename || '","file_data":"' || {_URL} || '","detail":"high"}}'
 ELSE '{{"type":"input_file","filename":"' || filename || '","file_data":"' || {_URL} || '"}}' END"""


@query(f"""WITH {checks.FILES} SELECT doc_id, CAST(strlen({_LABEL_PART}) + strlen({_BODY_PART}) AS BIGINT) AS n_bytes,
       sha256({_LABEL_PART} || {_BODY_PART}) AS parts_hash FROM f""")
def request_parts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = request_parts(corpus.intake_files(spark, sf_dir))
    joined = F.concat(F.to_json(F.get("parts", F.lit(0))), F.to_json(F.get("parts", F.lit(1))))
    return parts.select("doc_id", joined.alias("j")).select(
        "doc_id", F.octet_length("j").cast("bigint").alias("n_bytes"), text.sha256(F.col("j")).alias("parts_hash")
    )


@query(f"""WITH {checks.FILES}, {_ADMIT},
b AS (SELECT f.intake_no, string_agg({_LABEL_PART} || ',' || {_BODY_PART}, ',' ORDER BY file_index) AS parts
      FROM f JOIN a ON a.intake_no = f.intake_no AND a.reason IS NULL GROUP BY f.intake_no),
l AS (SELECT intake_no, '{{"model":"{MODEL}","store":false,"max_output_tokens":40000,"input":[{{"role":"user","content":[{{"type":"input_text","text":"{PROMPT}"}},'
      || parts || ']}}],"text":{{"format":{{"type":"json_object"}}}}}}' AS line FROM b)
SELECT intake_no, CAST(strlen(line) AS BIGINT) AS n_bytes, sha256(line) AS line_hash FROM l""")
def request_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.intake_files(spark, sf_dir)
    admitted = admit(files.drop("content"), SMALL)
    lines = request_lines(files, admitted, PROMPT, MODEL)
    return lines.select(
        "intake_no", F.octet_length("line").cast("bigint").alias("n_bytes"), text.sha256(F.col("line")).alias("line_hash")
    )


_PATH = "CASE WHEN page_id%3=0 THEN '/relatorios/' || regexp_replace(url, '[^A-Za-z0-9]', '-', 'g') || CASE WHEN page_id%2=0 THEN '/' ELSE '' END ELSE regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) END"


@query(f"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages)
SELECT page_id, path, nullif(regexp_extract(path, '^/relatorios/([^/]+)/?$', 1), '') AS report_id FROM p""")
def url_report_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(
        F.col("page_id") % 3 == 0,
        F.concat(
            F.lit("/relatorios/"), F.regexp_replace("url", "[^A-Za-z0-9]", "-"),
            F.when(F.col("page_id") % 2 == 0, "/").otherwise(""),
        ),
    ).otherwise(F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1))
    pages = corpus.table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return pages.select("page_id", "path", text.report_id(F.col("path")).alias("report_id"))


@query("""SELECT c_custkey, upper(left(c_name,1) || left(lower(c_mktsegment),1)) AS initials,
       upper(left(lower(c_mktsegment),1)) || substr(lower(c_mktsegment), 2) AS capitalized,
       replace(lower(c_mktsegment) || '_' || c_nationkey, '_', ' ') AS words,
       concat_ws(' · ', c_name, CASE WHEN c_custkey%2=0 THEN c_mktsegment END) AS joined,
       abs(c_acctbal) AS magnitude FROM customer""")
def display_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.lower("c_mktsegment")
    return corpus.table(spark, sf_dir, "customer").select(
        "c_custkey",
        text.initials(F.concat(F.col("c_name"), F.lit(" "), segment)).alias("initials"),
        text.capitalize_first(segment).alias("capitalized"),
        text.humanize_key(F.concat(segment, F.lit("_"), F.col("c_nationkey"))).alias("words"),
        text.join_filled(" · ", F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("")).alias("joined"),
        F.abs("c_acctbal").alias("magnitude"),
    )


@query("""SELECT p_partkey, p_retailprice AS parsed, CAST(NULL AS DOUBLE) AS unparsed FROM part""")
def leading_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers at the start of a text with a unit; text without one gives NULL."""
    return corpus.table(spark, sf_dir, "part").select(
        "p_partkey",
        text.leading_number(F.concat(F.lit("  "), F.col("p_retailprice").cast("string"), F.lit(" µm"))).alias("parsed"),
        text.leading_number(F.concat(F.lit("NaN "), F.col("p_name"))).alias("unparsed"),
    )
