"""Report queries: measurement tables, rules, summaries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom import config as c
from chartloom.config import Limits
from chartloom.operators import report as r
from chartloom.operators import rules
from chartloom.operators.admission import file_fault
from chartloom.operators.lineage import owned_sources, source_entries
from chartloom.operators.normalize import normalize, parse_cases
from chartloom.plans import checks
from chartloom.plans.eyes import gold_eyes
from chartloom.plans.registry import query
from chartloom.sources.corpus import case_documents, intake_files, table, with_case_keys

AS_OF = dt.date(2024, 6, 15)
SMALL = Limits(max_file=8_000, max_set=12_000)


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_cases(case_documents(spark, sf_dir))


_LABEL = "CASE WHEN eye='OS' THEN 'OE' ELSE eye END"


def _measurement_rows() -> str:
    parts = []
    for position, (metric, name, full, unit, screen, field) in enumerate(c.METRIC_CATALOG):
        label, source, document = _LABEL, f"'Pentacam ' || {_LABEL}", f"coalesce(source_file, 'Pentacam ' || {_LABEL})"
        if metric == "cell_density_cells_per_mm2":
            source, document = f"'Microscopia especular ' || {_LABEL}", "'micro-' || k || '.jpg'"
        if metric == "axial_length_mm":
            label, source, document = "eye", f"'Biometria ' || {_LABEL}", f"'{c.AXIAL_LENGTH_DOCUMENT}'"
        text = {True: lambda v: f"'{v}'", False: lambda v: "CAST(NULL AS VARCHAR)"}
        parts.append(
            f"SELECT case_id, eye, CAST({position} AS BIGINT) AS position, '{metric}' AS metric, "
            f"'{name} · ' || {label} AS name, {text[full is not None](full)} AS full_name, {metric} AS value, "
            f"{text[unit is not None](unit)} AS unit, {source} AS source, {document} AS document, "
            f"'{screen}' AS screen, '{field}' AS field, {checks.pt_number(metric)} AS value_text, "
            f"'{c.KIND_RAW}' AS kind, '{c.CONFIDENT}' AS confidence, "
            f"CASE WHEN {metric} IS NULL THEN '{c.KIND_MISSING}' ELSE '{c.KIND_RAW}' END AS kind_checked, "
            f"CASE WHEN {metric} IS NULL THEN '{c.SUSPECT}' ELSE '{c.CONFIDENT}' END AS confidence_checked FROM eye"
        )
    return " UNION ALL ".join(parts)


_MEASURED = f"WITH {checks.eyes()},\nm AS ({_measurement_rows()})"


@query(f"{_MEASURED} SELECT * FROM m")
def measurements_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.measurements(gold_eyes(spark, sf_dir))


@query(f"""{_MEASURED}
SELECT case_id, CAST(count(*) AS BIGINT) AS n_data, CAST(count(*) AS BIGINT) AS consistent,
       CAST(count(value) AS BIGINT) AS consistent_checked FROM m GROUP BY case_id""")
def consistent_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.consistent_counts(gold_eyes(spark, sf_dir))


@query(f"""{_MEASURED}
SELECT case_id, CAST(count(value) AS BIGINT) AS completed, CAST(count(*)-count(value) AS BIGINT) AS pending,
       CAST(floor(100.0::DOUBLE*count(value)/count(*)+0.5) AS BIGINT) AS percentage FROM m GROUP BY case_id""")
def completeness_per_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.case_progress(gold_eyes(spark, sf_dir))


@query(f"""{_MEASURED}
SELECT metric, eye, CAST(count(value) AS BIGINT) AS completed, CAST(count(*)-count(value) AS BIGINT) AS pending,
       CAST(floor(100.0::DOUBLE*count(value)/count(*)+0.5) AS BIGINT) AS percentage FROM m GROUP BY metric, eye""")
def completeness_per_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few groups over all rows: partial sums leave each task, never the rows."""
    return r.metric_progress(gold_eyes(spark, sf_dir))


_TORIC = f"""WITH {checks.eyes()},
t AS (SELECT case_id, eye, abs(astigmatism_d) AS astigmatism, coalesce(abs(astigmatism_d) >= 0.75, false) AS is_toric FROM eye)"""


@query(f"""{_TORIC}
SELECT *, CASE WHEN is_toric THEN '{c.TORIC}' ELSE '{c.NON_TORIC}' END AS reference_label,
       CASE WHEN astigmatism IS NULL THEN 'missing' WHEN is_toric THEN '{c.TORIC}' ELSE '{c.NON_TORIC}' END AS label,
       CASE WHEN is_toric THEN '{c.TORIC_WORD}' ELSE '{c.NON_TORIC_WORD}' END AS word FROM t""")
def toric_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.toric_flags(gold_eyes(spark, sf_dir))


@query(f"""{_TORIC}
SELECT case_id, max(CASE WHEN eye='OD' THEN CASE WHEN is_toric THEN '{c.TORIC_WORD}' ELSE '{c.NON_TORIC_WORD}' END END) AS word_od,
       max(CASE WHEN eye='OS' THEN CASE WHEN is_toric THEN '{c.TORIC_WORD}' ELSE '{c.NON_TORIC_WORD}' END END) AS word_os
FROM t GROUP BY case_id""")
def toric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.eyes_side_by_side(rules.toric_flags(gold_eyes(spark, sf_dir)), ("word",))


_ENDO = f"""WITH {checks.eyes()},
d AS (SELECT case_id, eye, cell_density_cells_per_mm2 AS density,
             coalesce(cell_density_cells_per_mm2 < 2000, false) AS below_cutoff FROM eye)"""


@query(f"""{_ENDO}
SELECT *, CASE WHEN below_cutoff THEN '{c.BELOW_CUTOFF}' ELSE '{c.ABOVE_CUTOFF}' END AS reference_label,
       CASE WHEN density IS NULL THEN 'missing' WHEN below_cutoff THEN '{c.BELOW_CUTOFF}' ELSE '{c.ABOVE_CUTOFF}' END AS label FROM d""")
def endothelium_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.endothelium_flags(gold_eyes(spark, sf_dir))


@query(f"""{_ENDO}
SELECT case_id, eye, branch, {_LABEL} || ' · ' || CASE WHEN branch THEN 'Sim' ELSE 'Não' END AS title,
       branch = below_cutoff AS selected,
       CASE WHEN branch = below_cutoff THEN '{c.BRANCH_CHOSEN}' ELSE '{c.BRANCH_NOT_CHOSEN}' END AS badge,
       CASE WHEN branch <> below_cutoff THEN 'neutral' WHEN branch THEN 'warning' ELSE 'success' END AS tone,
       {checks.pt_number('density')} || ' células/mm²' AS density_text,
       CASE WHEN branch THEN '{c.BELOW_CUTOFF}' ELSE '{c.ABOVE_CUTOFF}' END AS consequence
FROM d, (SELECT true AS branch UNION ALL SELECT false) b""")
def branch_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.branch_grid(gold_eyes(spark, sf_dir))


@query(f"""WITH {checks.CASES}
SELECT case_id, CAST(p AS BIGINT) AS position, label, detail, 'success' AS tone,
       CASE p WHEN 0 THEN '4' WHEN 1 THEN '12' WHEN 2 THEN {checks.QUALITY} || ' / ' || {checks.QUALITY} ELSE '{c.CONSOLIDATION_VALUE}' END AS value
FROM o, (VALUES {', '.join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(c.METRIC_CARDS))}) m(p, label, detail)""")
def report_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.metric_cards(_cases(spark, sf_dir))


@query(f"""WITH {checks.CASES},
x AS (
  SELECT case_id, k, 'fundus_retinography' AS exam_key, CAST(NULL AS VARCHAR) AS eyes, 'fundus.png' AS sources FROM o WHERE k%3=0
  UNION ALL SELECT case_id, k, 'pentacam_corneal_tomography', 'OD, OS', 'od-'||k||'.pdf' || CASE WHEN k%4=3 THEN '' ELSE ', os-'||k||'.pdf' END FROM o
  UNION ALL SELECT case_id, k, 'iol_calculation', CASE WHEN k%4=1 THEN 'AO' ELSE 'OD, OS' END, 'bio-'||k||'.pdf' FROM o
  UNION ALL SELECT case_id, k, 'specular_microscopy', 'OD, OS', 'micro-'||k||'.jpg' FROM o)
SELECT case_id, exam_key, CASE exam_key {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in c.EXAM_LABELS.items())} END AS label, eyes, sources FROM x""")
def exam_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.exam_summaries(_cases(spark, sf_dir))


@query(f"""WITH {checks.CASES} SELECT case_id, CAST(CASE WHEN k%3=0 THEN 4 ELSE 3 END AS BIGINT) AS n_exams, CAST(4 AS BIGINT) AS n_files FROM o""")
def case_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.case_counts(_cases(spark, sf_dir))


@query(f"""WITH {checks.CASES}
SELECT case_id, key, CASE key WHEN 'OD' THEN 'olho direito' WHEN 'OS' THEN 'olho esquerdo' ELSE CAST(k%10 AS VARCHAR) END AS value
FROM o, (VALUES ('OD'), ('OS'), ('scale')) v(key)""")
def conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.conventions(_cases(spark, sf_dir))


_SOURCES = """x AS (
  SELECT case_id, k, CAST(i AS BIGINT) AS index, n || k || CASE WHEN i=3 THEN '.jpg' ELSE '.pdf' END AS name,
         CASE WHEN i=3 AND k%10=9 THEN 'unsorted/' ELSE 'cases/' || case_id || '/' END AS prefix, i,
         CASE i WHEN 0 THEN 'OD' WHEN 1 THEN 'OS' END AS eye,
         CASE WHEN i < 2 THEN 'pentacam' WHEN i = 2 THEN 'biometria' WHEN k%8<>6 THEN 'microscopia' END AS exam
  FROM o, (VALUES (0,'od-'), (1,'os-'), (2,'bio-'), (3,'micro-')) f(i, n))"""


@query(f"""WITH {checks.CASES}, {_SOURCES}
SELECT case_id, index,
       coalesce(upper(left(exam, 1)) || substr(exam, 2) || CASE i WHEN 0 THEN ' · OD' WHEN 1 THEN ' · OE' ELSE '' END, 'Documento') AS name,
       name AS filename, '{c.STATUS_PROCESSED}' AS status,
       CASE WHEN i=3 THEN 'Imagem' WHEN k%2=0 THEN CAST(3+k%5 AS VARCHAR) || ' páginas' ELSE 'p1,p2 páginas' END || ' disponível no caso.' AS detail
FROM x""")
def documents_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.document_reviews(source_entries(_cases(spark, sf_dir)))


@query(f"""WITH {checks.CASES}, {_SOURCES}
SELECT case_id, index, prefix || name AS file_name, CASE WHEN i=3 THEN 'jpeg' ELSE 'pdf' END AS icon,
       CASE WHEN i<3 AND k%2=1 THEN CAST(2 AS BIGINT) END AS n_pages,
       coalesce(nullif(concat_ws(' · ', exam, eye, CASE WHEN i<3 AND k%2=1 THEN '2 páginas' END), ''), '{c.FILE_SUMMARY_FALLBACK}') AS summary
FROM x""")
def file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.file_summaries(source_entries(_cases(spark, sf_dir)))


@query(f"""WITH {checks.CASES}, {_SOURCES}
SELECT case_id, index, prefix || name AS path FROM x WHERE prefix <> 'unsorted/'""")
def owned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owned_sources(source_entries(_cases(spark, sf_dir))).select("case_id", "index", "path")


@query(f"""WITH {checks.CASES}
SELECT case_id, full_name AS patient_name, CAST(birth AS VARCHAR) AS birth_date,
       CASE WHEN k%5<>0 THEN 'Uso sob revisão' END AS warning FROM o""")
def patient_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.patients(_cases(spark, sf_dir))


@query(f"""WITH {checks.CASES} SELECT case_id, CAST(birth AS VARCHAR) AS birth_date, full_name FROM o""")
def birth_date_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unified birth date written back into the document as plain text."""
    return r.with_birth_date(_cases(spark, sf_dir)).select(
        "case_id",
        F.try_variant_get("analysis", "$.patient.birth_date", "string").alias("birth_date"),
        F.try_variant_get("analysis", "$.patient.full_name", "string").alias("full_name"),
    )


_AGE = "date_part('year', DATE '2024-06-15') - date_part('year', birth) - CASE WHEN date_part('month', birth)*100 + date_part('day', birth) <= 615 THEN 0 ELSE 1 END"


@query(f"""WITH {checks.CASES},
a AS (SELECT case_id, CAST({_AGE} AS INTEGER) AS age FROM o)
SELECT case_id, age, CASE WHEN age < 40 THEN 'A' WHEN age <= 55 THEN 'B' ELSE 'C' END AS cohort FROM a""")
def age_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = r.patients(_cases(spark, sf_dir))
    age = rules.age_years(F.col("birth_date").try_cast("date"), AS_OF)
    return header.select("case_id", age.alias("age"), rules.age_cohort(age).alias("cohort"))


@query(f"""WITH {checks.eyes()},
p AS (SELECT l_orderkey AS k, 90.0::DOUBLE + count(*) AS flap, sum(l_quantity) AS ablation, max(l_quantity)/10 AS change FROM lineitem GROUP BY 1)
SELECT case_id, eye, (flap+ablation)*100.0::DOUBLE/thinnest_um AS pta_percent, thinnest_um-flap-ablation AS residual_bed_um,
       kmax_d-change AS final_k_d FROM eye JOIN p ON p.k = eye.k""")
def surgical_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planning values per order (pre-aggregated lines) against the measured eyes."""
    plan = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        (F.count("*") + F.lit(90.0)).alias("flap"), F.sum("l_quantity").alias("ablation"),
        (F.max("l_quantity") / 10).alias("change"),
    )
    pachymetry = F.col("thinnest_um")
    return gold_eyes(spark, sf_dir, keep=("k",)).join(plan, "k").select(
        "case_id", "eye",
        rules.altered_tissue_percent(F.col("flap"), F.col("ablation"), pachymetry).alias("pta_percent"),
        rules.residual_bed(F.col("flap"), F.col("ablation"), pachymetry).alias("residual_bed_um"),
        rules.final_curvature(F.col("kmax_d"), F.col("change")).alias("final_k_d"),
    )


_REASONS = (
    "concat_ws('; ', CASE WHEN abs(astigmatism_d) > 1 THEN 'Astigmatismo corneano acima de 1,00 D' END, "
    "CASE WHEN art_max IS NULL THEN 'ARTmax não identificado' END, CASE WHEN kmax_d IS NULL THEN 'Kmax não identificado' END)"
)


@query(f"""WITH {checks.eyes(incomplete=True)}
SELECT case_id, eye, CAST(coalesce(CAST(abs(astigmatism_d) > 1 AS INTEGER), 0) + CAST(art_max IS NULL AS INTEGER) + CAST(kmax_d IS NULL AS INTEGER) AS BIGINT) AS n_reasons,
       {_REASONS} AS reasons, CASE WHEN art_max IS NULL OR kmax_d IS NULL THEN 'partial' ELSE 'complete' END AS conclusion,
       k%6=0 AS tkc_positive FROM eye""")
def conclusion_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.reasons(normalize(parse_cases(case_documents(spark, sf_dir, incomplete=True))))


@query(f"""WITH {checks.eyes()},
a AS (SELECT case_id, eye, thinnest_um, 2.5::DOUBLE + (k%100)/100e0 AS acd_int, e, k FROM eye),
b AS (SELECT *, acd_int + thinnest_um/1000e0 + CASE WHEN k%9=0 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS acd_ext FROM a)
SELECT case_id, eye, abs((acd_ext-acd_int)*1000-thinnest_um) <= 10 AS consistent FROM b""")
def acd_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = gold_eyes(spark, sf_dir, keep=("k",))
    internal = F.lit(2.5) + (F.col("k") % 100) / F.lit(100.0)
    external = internal + F.col("thinnest_um") / F.lit(1000.0) + F.when(F.col("k") % 9 == 0, F.lit(0.05)).otherwise(F.lit(0.0))
    return gold.select(
        "case_id", "eye",
        rules.acd_consistent(external, internal, F.col("thinnest_um"), c.Thresholds().acd_tolerance_um).alias("consistent"),
    )


@query(f"""WITH {checks.CASES},
d AS (SELECT case_id, CASE WHEN l_returnflag='R' AND l_linenumber=7 THEN 'outro' ELSE full_name END AS name,
             CASE WHEN l_linestatus='O' AND l_partkey%10=0 THEN '1900-01-01' ELSE CAST(birth AS VARCHAR) END AS birth_date
      FROM lineitem JOIN o ON l_orderkey = k),
g AS (SELECT case_id, CAST(count(*) AS BIGINT) AS n_documents, count(DISTINCT name) > 1 AS name_conflict, count(DISTINCT birth_date) > 1 AS birth_conflict FROM d GROUP BY 1)
SELECT *, CASE WHEN name_conflict OR birth_conflict THEN '{c.REPORT_BLOCKED}' ELSE '{c.REPORT_DONE}' END AS report FROM g""")
def identity_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order line stands for one document of its case; some carry another name or date."""
    cases = with_case_keys(table(spark, sf_dir, "orders")).select(
        F.col("k").alias("l_orderkey"), "case_id",
        F.format_string("Customer#%09d", "o_custkey").alias("full_name"),
        F.expr("cast(date_add(DATE'1940-01-01', cast((k*53)%25000 as int)) as string)").alias("birth"),
    )
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_returnflag", "l_linenumber", "l_linestatus", "l_partkey"
    )
    other_name = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)
    other_date = (F.col("l_linestatus") == "O") & (F.col("l_partkey") % 10 == 0)
    documents = lines.join(cases, "l_orderkey").select(
        "case_id",
        F.when(other_name, "outro").otherwise(F.col("full_name")).alias("name"),
        F.when(other_date, "1900-01-01").otherwise(F.col("birth")).alias("birth_date"),
    )
    return rules.identity_conflicts(documents)


_STATUS = (
    f"CASE WHEN content_type='text/plain' THEN '{c.STATUS_NOT_SENT}' WHEN size_bytes > {SMALL.max_file} "
    f"THEN '{c.STATUS_ATTENTION}' ELSE '{c.STATUS_PROCESSED}' END"
)


@query(f"""WITH {checks.FILES}, t AS (SELECT intake_no, CAST(count(*) FILTER (WHERE {_STATUS} <> '{c.STATUS_NOT_SENT}') AS BIGINT) AS received, CAST(count(*) AS BIGINT) AS total FROM f GROUP BY 1)
SELECT *, CASE WHEN received = total THEN 'success' ELSE 'warning' END AS tone FROM t""")
def received_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    fault = file_fault(F.col("content_type"), F.col("size_bytes"), SMALL)
    reviews = intake_files(spark, sf_dir).select(
        "intake_no",
        F.when(fault == "type", c.STATUS_NOT_SENT).when(fault == "size", c.STATUS_ATTENTION)
        .otherwise(c.STATUS_PROCESSED).alias("status"),
    )
    return r.received(reviews, "intake_no")


@query(f"""WITH {checks.FILES}
SELECT intake_no, min(file_index) AS file_index, min_by(filename, file_index) AS filename, 'image/png' AS content_type
FROM f WHERE content_type = 'image/png' GROUP BY intake_no""")
def first_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = intake_files(spark, sf_dir).select("intake_no", "file_index", "filename", "content_type")
    return r.find_first(files, "intake_no", "content_type", "image/png", "file_index")


@query(f"""SELECT o_orderkey AS k, CASE o_orderpriority WHEN '1-URGENT' THEN '{c.EXAM_LABELS['fundus_retinography']}'
       WHEN '2-HIGH' THEN '{c.EXAM_LABELS['iol_calculation']}' ELSE 'other exam ' || lower(o_orderstatus) END AS label FROM orders""")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exam labels with the key itself, in words, as fallback."""
    key = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "fundus_retinography")
        .when(F.col("o_orderpriority") == "2-HIGH", "iol_calculation")
        .otherwise(F.concat(F.lit("other_exam_"), F.lower("o_orderstatus")))
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), r.exam_label(key).alias("label"))
