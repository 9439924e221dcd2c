"""Shared pieces of the check SQL: the derived corpus restated as arithmetic."""

from __future__ import annotations

from chartloom.operators.normalize import METRICS
from chartloom.sources.corpus import FILE_KINDS, metric_rule

CASES = """o AS (
  SELECT o_orderkey AS k, o_custkey, o_orderstatus, o_orderdate, o_totalprice,
         'case-' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || '-' || printf('%08x', o_orderkey) AS case_id,
         'intake-' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || '-' || printf('%08x', o_orderkey) AS intake_id,
         'Customer#' || printf('%09d', o_custkey) AS full_name,
         DATE '1940-01-01' + CAST((o_orderkey*53)%25000 AS INTEGER) AS birth
  FROM orders)"""


def eyes(incomplete: bool = False) -> str:
    """CTEs ``o`` (cases) and ``eye`` (case, eye, metrics)."""

    def one(e: int, eye: str) -> str:
        metrics = ", ".join(
            f"CAST({metric_rule(m, e, incomplete=incomplete)} AS DOUBLE) AS {m}" for m in METRICS
        )
        return (
            f"SELECT case_id, k, '{eye}' AS eye, {e} AS e, "
            f"CASE WHEN {e}=1 AND k%4=3 THEN NULL ELSE '{eye.lower()}-' || k || '.pdf' END AS source_file, "
            f"{metrics} FROM o"
        )

    return f"{CASES},\neye AS ({one(0, 'OD')} UNION ALL {one(1, 'OS')})"


QUALITY = "CASE k%4 WHEN 0 THEN 'OK' WHEN 1 THEN 'Não informado' WHEN 2 THEN 'Blinking' ELSE 'Model' END"


def pt_number(value: str) -> str:
    """pt-BR text of a non-negative value with at most two decimals."""
    cents = f"CAST(round(({value}-floor({value}))*100) AS INTEGER)"
    return (
        f"CASE WHEN {value} IS NULL THEN 'não informado' ELSE "
        f"replace(format('{{:,d}}', CAST(floor({value}) AS BIGINT)), ',', '.') || "
        f"CASE WHEN {cents}=0 THEN '' ELSE ',' || rtrim(printf('%02d', {cents}), '0') END END"
    )


_EXT = " ".join(f"WHEN {i} THEN '{x}'" for i, (x, _) in enumerate(FILE_KINDS))
_TYPE = " ".join(f"WHEN {i} THEN '{t}'" for i, (_, t) in enumerate(FILE_KINDS))
FILES = f"""f AS (
  SELECT doc_id, doc_id // 4 AS intake_no, doc_id % 4 AS file_index,
         'scan ' || doc_id || '.' || CASE doc_id%5 {_EXT} END AS filename,
         CASE doc_id%5 {_TYPE} END AS content_type,
         CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes,
         sha256(text) AS sha256, text, lang
  FROM documents)"""

SOURCES = """s AS (
  SELECT intake_no, (3 - doc_id % 4) * 2 + copy AS source_pos,
         CASE WHEN doc_id%3=0 THEN 'uploads/' || filename END AS path,
         CASE WHEN doc_id%3<>0 THEN filename END AS name,
         lang || '-' || copy AS exam,
         CASE WHEN doc_id%2=0 THEN 'OD' ELSE 'OS' END AS eye
  FROM f, (SELECT 0 AS copy UNION ALL SELECT 1) c
  WHERE lang <> 'de' AND (copy = 0 OR doc_id % 6 = 0))"""

ATTACHED = f"""{FILES},
{SOURCES},
m AS (
  SELECT f.intake_no, f.file_index, s.exam, s.eye,
         row_number() OVER (PARTITION BY f.intake_no, f.file_index ORDER BY s.source_pos) AS rn
  FROM f JOIN s ON s.intake_no = f.intake_no
   AND (regexp_replace(coalesce(s.path, ''), '^.*/', '') = f.filename OR s.name = f.filename)),
att AS (
  SELECT f.*, m.exam, m.eye FROM f
  LEFT JOIN m ON m.intake_no = f.intake_no AND m.file_index = f.file_index AND m.rn = 1)"""
