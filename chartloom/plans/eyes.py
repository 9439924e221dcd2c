"""Queries around the normalizer, the completeness test and the repair merge."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.functions.variants import as_map, at, fill_missing, leaves
from chartloom.operators.normalize import METRICS, normalize, parse_cases, paths_type
from chartloom.operators.repair import apply_repairs, completeness, fill_metrics, repair_files
from chartloom.operators.report import renested_document
from chartloom.plans import checks
from chartloom.plans.registry import query
from chartloom.session import shared_dir
from chartloom.sources.corpus import case_documents, repair_documents, spread, table
from chartloom.sources.extraction import repair_lines
from chartloom.sources.tables import write_silver

_GOLD = f"""WITH {checks.eyes()}
SELECT case_id, eye, source_file, 'micro-' || k || '.jpg' AS microscopy_file, {checks.QUALITY} AS quality,
       {', '.join(METRICS)}, CASE WHEN k%6=0 THEN 'KC1' END AS tkc
FROM eye"""


def gold_eyes(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return normalize(parse_cases(case_documents(spark, sf_dir)), keep=keep)


@query(_GOLD)
def eye_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric of every eye over four drifting layouts, one row per case and eye."""
    return gold_eyes(spark, sf_dir)


@query(_GOLD)
def eye_gold_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from stored VARIANT documents: parsed once, and the scan reads only the paths that are used."""
    path = f"{shared_dir(spark)}/silver-{uuid.uuid4().hex}"
    write_silver(case_documents(spark, sf_dir).select("case_id", "raw"), path)
    return normalize(spark.read.parquet(path))


_MEMBERS = (
    "anterior_cornea,belin_ambrosio,cataract_preop,corneal_rings,pachymetry,quality,topometric_indices_8mm",
    "anéis_corneanos,cataract_pre_op,ectasia_reforcada_belin_ambrosio,indices_zona_8mm,pachymetry",
    "anéis_corneanos,belin_ambrosio,cataract_pre_op,general,topometric_indices_8mm",
    "anterior_cornea,cataract_pre_op,display_maps,ectasia_reforcada_belin_ambrosio,general,indices_zona_8mm",
)


@query(f"""WITH {checks.eyes()}
SELECT case_id, eye, CASE k%4 {" ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MEMBERS))} END AS members, thinnest_um FROM eye""")
def raw_eyes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of the untouched eye document next to its typed values."""
    gold = normalize(parse_cases(case_documents(spark, sf_dir)), raw_eye=True)
    names = F.array_sort(F.map_keys(as_map(F.col("raw_eye"))))
    return gold.select("case_id", "eye", F.array_join(names, ",").alias("members"), "thinnest_um")


@query(f"""WITH {checks.eyes()}
SELECT case_id, eye, thinnest_um, axial_length_mm, CAST(NULL AS DOUBLE) AS cell_density_cells_per_mm2 FROM eye""")
def eye_gold_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the microscopy exam: the strict reading drops such a case, the lenient one keeps NULLs."""
    docs = case_documents(spark, sf_dir).withColumn(
        "raw", F.replace("raw", F.lit('"specular_microscopy"'), F.lit('"other_exam"'))
    )
    return normalize(parse_cases(docs), strict=False).select(
        "case_id", "eye", "thinnest_um", "axial_length_mm", "cell_density_cells_per_mm2"
    )


@query(f"""WITH {checks.eyes()}
SELECT case_id, eye, source_file, thinnest_um, kmax_d, bad_d, art_max, axial_length_mm, astigmatism_d,
       cell_density_cells_per_mm2,
       CASE WHEN k%3=0 THEN 'CR-2' END AS untouched_device
FROM eye""")
def renested_eyes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized values written back into the document, then read at their canonical paths."""
    cases = parse_cases(case_documents(spark, sf_dir)).select("case_id", renested_document(F.col("analysis")).alias("d"))
    exams = "exams.pentacam_corneal_tomography.eyes", "exams.iol_calculation.eyes", "exams.specular_microscopy.eyes"

    def paths(name: str) -> dict[str, tuple[str, str]]:
        cornea, iol, micro = (f"{root}.{name}" for root in exams)
        return {
            "source_file": (f"{cornea}.source_file", "string"),
            "thinnest_um": (f"{cornea}.pachymetry.thinnest_um", "double"), "kmax_d": (f"{cornea}.anterior_cornea.kmax_d", "double"),
            "bad_d": (f"{cornea}.belin_ambrosio.d", "double"), "art_max": (f"{cornea}.belin_ambrosio.art_max", "double"),
            "axial_length_mm": (f"{iol}.axial_length_mm", "double"), "astigmatism_d": (f"{iol}.keratometry.astigmatism_d", "double"),
            "cell_density_cells_per_mm2": (f"{micro}.cell_density_cells_per_mm2", "double"),
            "untouched_device": ("exams.fundus_retinography.device", "string"),
        }

    def eye(name: str):
        return F.struct(F.lit(name).alias("eye"), *[F.col(f"v.{path}").alias(column) for column, (path, _) in paths(name).items()])

    # One walk for the paths of both eyes.
    both = paths_type([*dict([*paths("OD").values(), *paths("OS").values()]).items()])
    read = cases.select("case_id", at(F.col("d"), "", both).alias("v"))
    return read.select("case_id", F.inline(F.array(eye("OD"), eye("OS"))))


def _flag(eye: int) -> str:
    kmax = "AND NOT (k%10=3)" if eye else ""
    return f"(k%20<>0 {kmax})"


@query(f"""WITH {checks.CASES}
SELECT case_id, {_flag(0)} AS od_complete, {_flag(1)} AS os_complete,
       NOT ({_flag(0)} AND {_flag(1)}) AS needs_repair,
       CASE WHEN k%20=0 THEN 'OD.bad_d,OD.art_max,OS.bad_d,OS.art_max' WHEN k%10=3 THEN 'OS.kmax_d' ELSE '' END AS missing_metrics
FROM o""")
def needs_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completeness(parse_cases(case_documents(spark, sf_dir, incomplete=True)))


@query(f"""WITH {checks.CASES}
SELECT case_id, CAST(i AS BIGINT) AS file_index, n || k || x AS filename
FROM o, (VALUES (0,'od-','.pdf'), (1,'os-','.pdf'), (2,'bio-','.pdf'), (3,'micro-','.jpg')) f(i, n, x)
WHERE (k%20=0 OR k%10=3) AND (i = 0 OR (i = 1 AND k%4<>3))""", name="repair_file_selection")
def repair_file_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of incomplete cases that the tomography exam names as its source."""
    docs = case_documents(spark, sf_dir, incomplete=True)
    names = [("od-", ".pdf"), ("os-", ".pdf"), ("bio-", ".pdf"), ("micro-", ".jpg")]
    files = docs.select("case_id", F.inline(F.array(*[
        F.struct(
            F.lit(i).cast("bigint").alias("file_index"),
            F.concat(F.lit(n), F.col("k"), F.lit(x)).alias("filename"),
        )
        for i, (n, x) in enumerate(names)
    ])))
    return repair_files(parse_cases(docs), files).select("case_id", "file_index", "filename")


_REPAIR_LINE = (
    """'{"model":"extractor-1","store":false,"max_output_tokens":5000,"input":[{"role":"user","content":[{"type":"input_text","text":"Leia de novo."}'"""
    """ || string_agg(',{"type":"input_text","text":"Arquivo seguinte: ' || name || '"},{"type":"input_file","filename":"' || name || '","file_data":"data:application/pdf;base64,'"""
    """ || to_base64(encode(name)) || '","detail":"high"}', '' ORDER BY i) || ']}],"text":{"format":{"type":"json_object"}}}'"""
)


@query(f"""WITH {checks.CASES},
f AS (SELECT case_id, i, n || k || '.pdf' AS name FROM o, (VALUES (0,'od-'), (1,'os-')) f(i, n) WHERE (k%20=0 OR k%10=3) AND (i = 0 OR k%4<>3))
SELECT case_id, {_REPAIR_LINE} AS line FROM f GROUP BY case_id""")
def repair_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-pass request of every incomplete case, with the files its tomography exam names and the smaller output cap."""
    docs = case_documents(spark, sf_dir, incomplete=True)
    files = docs.select("case_id", F.inline(F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("file_index"), F.concat(F.lit(n), F.col("k"), F.lit(".pdf")).alias("filename"))
        for i, n in enumerate(("od-", "os-", "bio-"))
    ])))
    uploads = files.select("*", F.lit("application/pdf").alias("content_type"), F.encode("filename", "utf-8").alias("content"))
    return repair_lines(parse_cases(docs), uploads, "Leia de novo.", "extractor-1")


_FILLED = "CASE WHEN k%40=20 THEN NULL ELSE {0} END"


@query(f"""WITH {checks.eyes()}
SELECT case_id, eye, thinnest_um, coalesce(kmax_d, 99) AS kmax_d, {_FILLED.format('bad_d')} AS bad_d,
       {_FILLED.format('art_max')} AS art_max, k%40=20 AS still_incomplete
FROM eye""")
def repair_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-pass values land only where the first pass had none; what the second pass lacks stays open."""
    cases = parse_cases(case_documents(spark, sf_dir, incomplete=True)).select("case_id", "analysis")
    merged = apply_repairs(cases, repair_documents(spark, sf_dir))
    flagged = completeness(merged, keep=("analysis",)).select(
        "case_id", "analysis", F.col("needs_repair").alias("still_incomplete")
    )
    return normalize(flagged, keep=("still_incomplete",)).select(
        "case_id", "eye", "thinnest_um", "kmax_d", "bad_d", "art_max", "still_incomplete"
    )


@query(f"""WITH {checks.eyes()}
SELECT case_id, eye, coalesce(kmax_d, 99) AS kmax_d,
       {_FILLED.format('bad_d')} AS bad_d, {_FILLED.format('art_max')} AS art_max
FROM eye""")
def repair_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same merge on typed rows: one equi-join on case and eye, target value first."""
    gold = normalize(parse_cases(case_documents(spark, sf_dir, incomplete=True))).select(
        "case_id", "eye", "kmax_d", "bad_d", "art_max"
    )
    doc = F.try_parse_json("raw")
    eye = [
        F.struct(
            F.lit(name).alias("eye"),
            at(doc, f"eyes.{name}.general.k_max_anterior_diopters", "double").alias("kmax_d"),
            at(doc, f"eyes.{name}.belin_ambrosio.d", "double").alias("bad_d"),
            at(doc, f"eyes.{name}.belin_ambrosio.art_max", "double").alias("art_max"),
        )
        for name in ("OD", "OS")
    ]
    extra = repair_documents(spark, sf_dir).select("case_id", F.inline(F.array(*eye)))
    return fill_metrics(gold, extra, ("kmax_d", "bad_d", "art_max"))


@query("""SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events""")
def leaf_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON trees as (path, value) rows."""
    rows = table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("doc"))
    return rows.select("event_id", F.inline(leaves(F.col("doc")))).select(
        "event_id", "path", F.try_variant_get("value", "$", "string").alias("value")
    )


@query(f"""WITH {checks.CASES},
r AS (
  SELECT 'thinnest' AS metric, CASE k%4 WHEN 0 THEN 'pachymetry.thinnest_um' WHEN 1 THEN 'pachymetry.point_and_finest_um'
         WHEN 2 THEN 'general.pachymetry_thinnest_um' ELSE 'general.thinnest_pachy_um' END AS path FROM o
  UNION ALL
  SELECT 'kmax', CASE k%4 WHEN 0 THEN 'anterior_cornea.kmax_d' WHEN 1 THEN 'pachymetry.k_max_anterior_diopters'
         WHEN 2 THEN 'general.k_max_anterior_diopters' ELSE 'anterior_cornea.kmax_d' END FROM o WHERE k%10<>3)
SELECT path, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY path""")
def layout_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each spelling of two metrics occurs in the left eyes, counted over flattened leaves."""
    cases = parse_cases(case_documents(spark, sf_dir))
    eye = at(F.col("analysis"), "exams.pentacam_corneal_tomography.eyes.OS")
    flat = cases.select(F.inline(leaves(eye)))
    named = F.col("path").rlike("(thinnest|finest|kmax_d|k_max|thinnest_pachy)")
    return flat.where(named).groupBy("path").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS kept,
       CASE WHEN event_id%2=0 THEN NULL ELSE value END AS filled_value, event_type AS added
FROM events""")
def generic_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive null-filling merge of two small trees per event."""
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.try_parse_json("props").alias("target"),
        F.parse_json(F.to_json(F.struct(
            F.lit(-1).alias("k"),
            F.struct(F.when(F.col("event_id") % 2 != 0, F.col("value")).alias("value")).alias("m"),
            F.col("event_type").alias("kind"),
        ))).alias("repair"),
    )
    doc = F.col("doc")
    return rows.select("event_id", fill_missing(F.col("target"), F.col("repair")).alias("doc")).select(
        "event_id", at(doc, "k", "bigint").alias("kept"), at(doc, "m.value", "double").alias("filled_value"),
        at(doc, "kind", "string").alias("added"),
    )


def _chain(levels: str, members: str, inner: str) -> str:
    """SQL of a JSON object nested ``levels`` deep, each level with the given members."""
    return f"""concat(repeat('{{{members},"a":', cast({levels} as int)), {inner}, repeat('}}', cast({levels} as int)))"""


#: Levels of the tree of a row, and of the target it is merged into.
_LEVELS, _SHORT = "1 + k % 40", "CASE WHEN k % 3 = 0 THEN greatest(1, (1 + k % 40) DIV 2) ELSE 1 + k % 40 END"


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees nested 1 to 40 levels by the order key; every third target ends early in a number."""
    keys = spread(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")))
    inner = """CASE WHEN k % 3 = 0 THEN '5' WHEN k % 2 = 0 THEN '{"x":null}' ELSE concat('{"x":', k, '}') END"""
    return keys.select(
        "k", F.expr(f"try_parse_json({_chain(_SHORT, chr(34) + 's' + chr(34) + ':7', inner)})").alias("target"),
        F.expr("try_parse_json(" + _chain(_LEVELS, '"s":9,"n":1', "'" + '{"x":3}' + "'") + ")").alias("repair"),
    )


_TREES = """WITH t AS (
  SELECT o_orderkey AS k, 1 + o_orderkey % 40 AS d,
         CASE WHEN o_orderkey % 3 = 0 THEN greatest(1, (1 + o_orderkey % 40) // 2) ELSE 1 + o_orderkey % 40 END AS short FROM orders),
l AS (SELECT *, unnest(range(0, d)) AS i FROM t)
"""


@query(_TREES + """SELECT k, repeat('a.', i) || 's' AS path, 9 AS value FROM l
UNION ALL SELECT k, repeat('a.', i) || 'n', 1 FROM l UNION ALL SELECT k, repeat('a.', d) || 'x', 3 FROM t""")
def deep_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf of trees of 1 to 40 levels."""
    rows = _trees(spark, sf_dir).select("k", F.inline(leaves(F.col("repair"))))
    return rows.select("k", "path", F.try_variant_get("value", "$", "int").alias("value"))


@query(_TREES + """SELECT k, repeat('a.', i) || 's' AS path, CASE WHEN i < short THEN 7 ELSE 9 END AS value FROM l
UNION ALL SELECT k, repeat('a.', i) || 'n', 1 FROM l
UNION ALL SELECT k, repeat('a.', d) || 'x', CASE WHEN k % 3 = 0 OR k % 2 = 0 THEN 3 ELSE k END FROM t""")
def deep_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of 1 to 40 levels filled from others: kept, filled and replaced members at every level."""
    merged = _trees(spark, sf_dir).select("k", fill_missing(F.col("target"), F.col("repair")).alias("doc"))
    return merged.select("k", F.inline(leaves(F.col("doc")))).select(
        "k", "path", F.try_variant_get("value", "$", "bigint").alias("value")
    )
