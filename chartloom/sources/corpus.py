"""Clinical documents derived inside Spark from the given tables.

Every row of ``orders`` becomes one compiled exam document.  The metric values
follow plain arithmetic on the order key, so SQL can state the expected result
without going through JSON, while the documents drift over four field layouts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Deal narrow rows over all shuffle partitions before they grow into whole documents, at every size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


# Metric arithmetic, valid both in Spark and in the SQL check ({k} key, {e} eye index).
METRIC_RULES = {
    "thinnest_um": "450 + ({k}*37 + {e}*11) % 150",
    "kmax_d": "CASE WHEN {e}=1 AND {k}%10=3 THEN NULL ELSE (400 + ({k}*13 + {e}*7) % 120) / 10e0 END",
    "bad_d": "(({k}*17 + {e}*5) % 400) / 100e0",
    "art_max": "250 + ({k}*29 + {e}*3) % 300",
    "z31_coma_um": "(({k}*19 + {e}*23) % 900) / 1000e0",
    "z40_6mm_um": "(({k}*31 + {e}*2) % 700) / 1000e0",
    "axial_length_mm": "(2150 + ({k}*23 + {e}*9) % 500) / 100e0",
    "astigmatism_d": "CASE WHEN {e}=1 AND {k}%16=5 THEN NULL ELSE -(({k}*7 + {e}*31) % 400) / 100e0 END",
    "cell_density_cells_per_mm2": "CASE WHEN {e}=0 AND {k}%25=7 THEN NULL ELSE 1500 + ({k}*41 + {e}*19) % 1800 END",
}


def metric_rule(name: str, e: int, k: str = "k", incomplete: bool = False) -> str:
    """SQL text of one metric; the incomplete variant lacks two of them on every 20th key."""
    rule = METRIC_RULES[name].format(k=k, e=e)
    if incomplete and name in ("bad_d", "art_max"):
        return f"CASE WHEN {k}%20=0 THEN NULL ELSE {rule} END"
    return rule


def _obj(members: dict) -> str:
    parts = []
    for key, value in members.items():
        parts.append(f"'{key}', {_obj(value) if isinstance(value, dict) else f'({value})'}")
    return f"named_struct({', '.join(parts)})"


def _cornea(layout: int, e: int, incomplete: bool) -> dict:
    m = {name: metric_rule(name, e, incomplete=incomplete) for name in METRIC_RULES}
    coma = {"total_corneal_wfa_components_of_zernike": {"diam_zone_5_mm": {"z31_coma_um": m["z31_coma_um"]}}}
    z40 = {"total_corneal_z40_6mm_um": m["z40_6mm_um"]}
    tkc = {"tkc": "CASE WHEN k%6=0 THEN 'KC1' END"}
    if layout == 0:
        return {
            "quality": "'OK'",
            "pachymetry": {"thinnest_um": m["thinnest_um"]},
            "anterior_cornea": {"kmax_d": m["kmax_d"]},
            "belin_ambrosio": {"d": m["bad_d"], "art_max": m["art_max"]},
            "corneal_rings": {"zernike": {"5mm": {"z31_coma": f"concat(cast({m['z31_coma_um']} as string), ' µm')"}}},
            "cataract_preop": z40,
            "topometric_indices_8mm": tkc,
        }
    if layout == 1:
        return {
            "pachymetry": {"point_and_finest_um": m["thinnest_um"], "k_max_anterior_diopters": m["kmax_d"]},
            "ectasia_reforcada_belin_ambrosio": {
                "d": m["bad_d"], "indice_de_progressao": {"art_max": m["art_max"]}
            },
            "anéis_corneanos": coma,
            "cataract_pre_op": z40,
            "indices_zona_8mm": tkc,
        }
    if layout == 2:
        return {
            "general": {
                "quality": "'Blinking'",
                "pachymetry_thinnest_um": m["thinnest_um"],
                "k_max_anterior_diopters": m["kmax_d"],
            },
            "belin_ambrosio": {"d": m["bad_d"], "art_max": m["art_max"]},
            "anéis_corneanos": coma,
            "cataract_pre_op": z40,
            "topometric_indices_8mm": tkc,
        }
    return {
        "quality": "CAST(NULL AS STRING)",
        "general": {"quality": "'Model'", "thinnest_pachy_um": m["thinnest_um"]},
        "anterior_cornea": {"kmax_d": m["kmax_d"]},
        "ectasia_reforcada_belin_ambrosio": {"d": m["bad_d"], "art_max": m["art_max"]},
        "display_maps": {"corneal_rings": {"zernike_total_corneal_wfa_5mm": {"z31_coma_um": m["z31_coma_um"]}}},
        "cataract_pre_op": z40,
        "indices_zona_8mm": tkc,
    }


def _biometry(layout: int, e: int) -> dict:
    axial = metric_rule("axial_length_mm", e)
    astig = metric_rule("astigmatism_d", e)
    if layout == 0:
        return {"axial_length_mm": axial, "keratometry": {"astigmatism_d": astig}}
    if layout == 2:
        return {"axial_length_mm": axial, "anterior_cornea": {"astig_diopters": astig}}
    if layout == 1:
        return {"biometry": {"al_mm": axial}, "anterior_cornea": {"astig_diopters": astig}}
    return {
        "biometry": {"al_mm": axial},
        "anterior_cornea": {"ast_d_deg": f"concat(cast({astig} as string), ' D x 90')"},
    }


def _document(layout: int, incomplete: bool) -> dict:
    od, os_ = _biometry(layout, 0), _biometry(layout, 1)
    density = "cell_density_cells_per_mm2" if layout in (0, 2) else "cell_density_cells_mm2"
    pentacam_source = "array(file_od, file_os)" if layout != 3 else "array(file_od)"
    pages = "3 + k%5" if layout in (0, 2) else "array('p1', 'p2')"

    def source(path: str, exam: str, eye: str, kind: str, pages_sql: str) -> str:
        return _obj({"path": path, "type": f"'{kind}'", "exam": exam, "eye": eye, "pages": pages_sql})

    sources = [
        source("concat(prefix, file_od)", "'pentacam'", "'OD'", "application/pdf", pages),
        source("concat(prefix, file_os)", "'pentacam'", "'OS'", "application/pdf", pages),
        source("concat(prefix, file_bio)", "'biometria'", "CAST(NULL AS STRING)", "application/pdf", pages),
        source(
            "concat(CASE WHEN k%10=9 THEN 'unsorted/' ELSE prefix END, file_micro)",
            "CASE WHEN k%8<>6 THEN 'microscopia' END", "''", "image/jpeg", "NULL",
        ),
    ]
    files = f"array({', '.join(sources)})"
    birth = "birth" if layout % 2 == 0 else {"normalized": "birth"}
    return {
        "schema_version": "'1.0'",
        "generated_on": "date_format(o_orderdate, 'yyyy-MM-dd')",
        "language": "CASE WHEN k%7<>0 THEN 'pt-BR' END",
        "patient": {"full_name": "full_name", "birth_date": birth},
        "conventions": {"OD": "'olho direito'", "OS": "'olho esquerdo'", "scale": "k%10"},
        "source_files": files,
        "exams": {
            "fundus_retinography": "CASE WHEN k%3=0 THEN named_struct('source', array('fundus.png'), 'device', 'CR-2') END",
            "pentacam_corneal_tomography": {
                "source": pentacam_source,
                "eyes": {"OD": _cornea(layout, 0, incomplete), "OS": _cornea(layout, 1, incomplete)},
            },
            "iol_calculation": {
                "source": "array(file_bio)",
                "eyes": {"AO": {"OD": od, "OS": os_}} if layout == 1 else {"OD": od, "OS": os_},
            },
            "specular_microscopy": {
                "source": "array(file_micro)",
                "eyes": {
                    "OD": {density: metric_rule("cell_density_cells_per_mm2", 0)},
                    "OS": {density: metric_rule("cell_density_cells_per_mm2", 1)},
                },
            },
        },
        "extraction_notes": {
            "clinical_use_warning": "CASE WHEN k%5=0 THEN parse_json('17') ELSE parse_json('\"Uso sob revisão\"') END"
        },
    }


def with_case_keys(orders: DataFrame) -> DataFrame:
    """Add the integer key and the ids minted from order time and key."""
    token = "lower(lpad(hex(o_orderkey), greatest(8, length(hex(o_orderkey))), '0'))"
    stamp = "date_format(o_orderdate, \"yyyyMMdd'T'HHmmss'Z'\")"
    return orders.select(
        F.col("o_orderkey").alias("k"),
        "*",
        F.expr(f"concat('case-', {stamp}, '-', {token})").alias("case_id"),
        F.expr(f"concat('intake-', {stamp}, '-', {token})").alias("intake_id"),
    )


def case_documents(spark: SparkSession, sf_dir: str, incomplete: bool = False) -> DataFrame:
    """(case_id, k, created_at, raw): one compiled JSON document per order.

    With ``incomplete`` every 20th document lacks two metrics, as a first
    extraction pass that needs a repair would.
    """
    keyed = with_case_keys(spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")))
    prepared = keyed.select(
        "case_id", "intake_id", "k", "o_orderdate",
        F.expr("cast(o_orderdate as timestamp)").alias("created_at"),
        F.expr("concat('Customer#', lpad(cast(o_custkey as string), 9, '0'))").alias("full_name"),
        F.expr("cast(date_add(DATE'1940-01-01', cast((k*53)%25000 as int)) as string)").alias("birth"),
        F.expr("concat('cases/', case_id, '/')").alias("prefix"),
        F.expr("concat('od-', k, '.pdf')").alias("file_od"),
        F.expr("concat('os-', k, '.pdf')").alias("file_os"),
        F.expr("concat('bio-', k, '.pdf')").alias("file_bio"),
        F.expr("concat('micro-', k, '.jpg')").alias("file_micro"),
    )
    branches = " ".join(
        f"WHEN {layout} THEN to_json({_obj(_document(layout, incomplete))})" for layout in range(4)
    )
    return prepared.select(
        "case_id", "intake_id", "k", "created_at", F.expr(f"CASE k%4 {branches} END").alias("raw")
    )


def repair_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, raw): one narrow second-pass extraction per order; some found nothing new."""
    keyed = with_case_keys(spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")))

    def eye(e: int) -> dict:
        found = {name: f"CASE WHEN k%40<>20 THEN {metric_rule(name, e)} END" for name in ("bad_d", "art_max")}
        return {
            "general": {"pachymetry_thinnest_um": "CAST(NULL AS INT)", "k_max_anterior_diopters": "99.0e0"},
            "belin_ambrosio": {"d": found["bad_d"], "art_max": found["art_max"]},
        }

    body = _obj({"eyes": {"OD": eye(0), "OS": eye(1)}})
    return keyed.select("case_id", F.expr(f"to_json({body}, map('ignoreNullFields', 'false'))").alias("raw"))


def contract_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, k, raw): short envelopes, a fifth of them broken in a known way."""
    keyed = with_case_keys(spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")))
    good = (
        '{"schema_version":"1.0","language":"pt-BR","patient":{"full_name":"x"},'
        '"source_files":[{"path":"a.pdf"}],'
        '"exams":{"pentacam_corneal_tomography":{"source":["a.pdf",null]}}}'
    )
    broken = {
        11: good.replace('"patient":{"full_name":"x"},', ""),
        12: '{"patient":{},"exams":null}',
        13: good.replace("pentacam_corneal_tomography", "pentacam"),
        14: good.replace('"source":["a.pdf",null]', '"device":"x"'),
        15: good.replace("null]}}", "1]}}"),
        16: good[:-5],
        17: good.replace('"schema_version":"1.0"', '"schema_version":1'),
        18: good + " trailing",
        19: good.replace('"language":"pt-BR"', '"language":1,"language":"pt-BR"'),
        20: good.replace('["a.pdf",null]', "[]"),
        21: good.replace('{"source":["a.pdf",null]}', "null"),
        22: good.replace('[{"path":"a.pdf"}]', '["a.pdf"]'),
        23: "[" + good + "]",
    }
    cases = " ".join(f"WHEN {slot} THEN '{text}'" for slot, text in broken.items())
    return keyed.select("case_id", "k", F.expr(f"CASE k%50 {cases} ELSE '{good}' END").alias("raw"))


# Extension and declared content type by document number.
FILE_KINDS = (
    ("pdf", "application/pdf"),
    ("png", "image/png"),
    ("jpeg", "image/jpeg"),
    ("docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    ("txt", "text/plain"),
)


def _by_document(values: list[str]) -> str:
    return "CASE doc_id%5 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_EXTENSION = _by_document([x for x, _ in FILE_KINDS])
_TYPE = _by_document([t for _, t in FILE_KINDS])


def file_columns(documents: DataFrame) -> DataFrame:
    """Documents as uploaded files: four consecutive ones form an intake; bytes are the whole text."""
    return documents.select(
        "doc_id",
        F.expr("doc_id div 4").alias("intake_no"),
        F.expr("doc_id % 4").alias("file_index"),
        F.expr(f"concat('scan ', doc_id, '.', {_EXTENSION})").alias("filename"),
        F.expr(_TYPE).alias("content_type"),
        F.expr("cast(octet_length(text) as bigint)").alias("size_bytes"),
        F.expr("encode(text, 'utf-8')").alias("content"),
    )


def intake_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_columns(table(spark, sf_dir, "documents"))


def extracted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File entries as an extraction lists them: German ones missing, some doubled, two naming styles."""
    listed = table(spark, sf_dir, "documents").where("lang <> 'de'")
    base = listed.select(
        "doc_id",
        F.expr("doc_id div 4").alias("intake_no"),
        F.expr(f"concat('scan ', doc_id, '.', {_EXTENSION})").alias("name"),
        F.col("lang").alias("exam"),
        F.expr("CASE WHEN doc_id%2=0 THEN 'OD' ELSE 'OS' END").alias("eye"),
    )
    copies = base.select("*", F.explode(F.expr("CASE WHEN doc_id%6=0 THEN array(0,1) ELSE array(0) END")).alias("copy"))
    return copies.select(
        "intake_no",
        F.expr("(3 - doc_id % 4) * 2 + copy").cast("bigint").alias("source_pos"),
        F.expr("CASE WHEN doc_id%3=0 THEN concat('uploads/', name) END").alias("path"),
        F.expr("CASE WHEN doc_id%3<>0 THEN name END").alias("filename"),
        F.expr("concat(exam, '-', copy)").alias("exam"),
        "eye",
    )
