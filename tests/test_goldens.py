"""Golden inputs and outputs stated in FIXTURES.md."""

import json

import pytest
from pyspark.sql import functions as F

from chartloom.functions.ids import valid_case_id, valid_intake_id
from chartloom.operators.contract import check_contract
from chartloom.operators.lineage import verify_manifest
from chartloom.operators.normalize import normalize, parse_cases
from chartloom.operators.repair import apply_repairs, completeness, repair_files


def _coma(value):
    return {"total_corneal_wfa_components_of_zernike": {"diam_zone_5_mm": {"z31_coma_um": value}}}


@pytest.fixture(scope="module")
def norm_case():
    legacy = {
        "pachymetry": {"point_and_finest_um": 529, "k_max_anterior_diopters": 44.2},
        "ectasia_reforcada_belin_ambrosio": {"d": 0.65, "indice_de_progressao": {"art_max": 416}},
        "anéis_corneanos": _coma(0.097), "cataract_pre_op": {"total_corneal_z40_6mm_um": 0.287},
    }
    current = {
        "general": {"pachymetry_thinnest_um": 526, "k_max_anterior_diopters": 45.5},
        "belin_ambrosio": {"d": 2.27, "art_max": 366},
        "anéis_corneanos": _coma(0.299), "cataract_pre_op": {"total_corneal_z40_6mm_um": 0.602},
    }
    return {
        "patient": {}, "source_files": [],
        "exams": {
            "pentacam_corneal_tomography": {"source": ["od.pdf", "os.pdf"], "eyes": {"OD": legacy, "OS": current}},
            "iol_calculation": {"source": ["bio.pdf"], "eyes": {"AO": {
                "OD": {"biometry": {"al_mm": 24.6}, "anterior_cornea": {"astig_diopters": -0.28}},
                "OS": {"biometry": {"al_mm": 24.74}, "anterior_cornea": {"astig_diopters": -3.17}},
            }}},
            "specular_microscopy": {"source": ["micro.jpg"], "eyes": {
                "OD": {"cell_density_cells_mm2": 2403}, "OS": {"cell_density_cells_mm2": 2184},
            }},
        },
    }


def _cases(spark, *documents):
    rows = [(f"case-{i}", d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)]
    return parse_cases(spark.createDataFrame(rows, "case_id string, raw string"))


def test_normalizer_golden(spark, norm_case):
    got = {r.eye: r for r in normalize(_cases(spark, norm_case)).collect()}
    order = ("thinnest_um", "kmax_d", "bad_d", "art_max", "cell_density_cells_per_mm2", "axial_length_mm")
    assert [got[e][m] for e in ("OD", "OS") for m in order] == [
        529, 44.2, 0.65, 416, 2403, 24.6, 526, 45.5, 2.27, 366, 2184, 24.74
    ]
    rest = ("astigmatism_d", "z31_coma_um", "z40_6mm_um")
    assert [got[e][m] for e in ("OD", "OS") for m in rest] == [-0.28, 0.097, 0.287, -3.17, 0.299, 0.602]
    assert (got["OD"].source_file, got["OS"].source_file) == ("od.pdf", "os.pdf")
    assert got["OD"].quality == "Não informado"


def test_normalized_document_golden(spark, norm_case):
    from chartloom.operators.report import renested_document

    doc = json.loads(_cases(spark, norm_case).select(F.to_json(renested_document(F.col("analysis")))).first()[0])
    eye = doc["exams"]["pentacam_corneal_tomography"]["eyes"]["OD"]
    assert eye["pachymetry"] == {"point_and_finest_um": 529, "k_max_anterior_diopters": 44.2, "thinnest_um": 529}
    assert eye["anterior_cornea"] == {"kmax_d": 44.2} and eye["belin_ambrosio"]["art_max"] == 416
    assert eye["corneal_rings"]["zernike"]["5mm"]["z31_coma"] == "0.097 µm"
    assert eye["topometric_indices_8mm"] == {"tkc": None} and "anéis_corneanos" in eye
    assert doc["exams"]["iol_calculation"]["eyes"]["OS"]["axial_length_mm"] == 24.74
    assert doc["exams"]["specular_microscopy"]["eyes"]["OS"]["cell_density_cells_per_mm2"] == 2184
    assert doc["exams"]["pentacam_corneal_tomography"]["source"] == ["od.pdf", "os.pdf"]


def test_repair_golden(spark):
    def eye(thinnest, kmax):
        return {"general": {"pachymetry_thinnest_um": thinnest, "k_max_anterior_diopters": kmax}}

    target = {"exams": {"pentacam_corneal_tomography": {
        "source": ["od.pdf", "os.pdf"], "eyes": {"OD": eye(529.0, 44.2), "OS": eye(526.0, 45.5)},
    }}}
    cases = _cases(spark, target)
    names = ["od.pdf", "os.pdf", "biometria.pdf"]
    files = spark.createDataFrame([("case-0", i, n) for i, n in enumerate(names)], "case_id string, file_index int, filename string")
    chosen = repair_files(cases, files).orderBy("file_index").collect()
    assert [r.filename for r in chosen] == ["od.pdf", "os.pdf"]
    repair = {"eyes": {
        "OD": {"general": {"k_max_anterior_diopters": 99.0}, "belin_ambrosio": {"d": 0.65, "art_max": 416.0}},
        "OS": {"belin_ambrosio": {"d": 2.27, "art_max": 366.0}},
    }}
    repairs = spark.createDataFrame([("case-0", json.dumps(repair))], "case_id string, raw string")
    merged = apply_repairs(cases, repairs)
    assert not completeness(merged).first().needs_repair
    od = json.loads(merged.select(F.to_json("analysis")).first()[0])["exams"]["pentacam_corneal_tomography"]["eyes"]["OD"]
    assert od["general"]["k_max_anterior_diopters"] == 44.2 and od["belin_ambrosio"] == {"d": 0.65, "art_max": 416.0}


@pytest.mark.parametrize("raw, reason", [
    ('{"patient":{},"exams":{"pentacam_corneal_tomography":{"source":[]}}}', None),
    ('{"patient":{},"exams":{"pentacam":{"source":[]}}}', "unknown_key"),
])
def test_contract_golden(spark, raw, reason):
    row = check_contract(spark.createDataFrame([(raw,)], "raw string")).first()
    assert row.reason == reason and row.is_valid == (reason is None)


@pytest.mark.parametrize("digest, matches", [("hash-correto", True), ("outro-hash", False)])
def test_manifest_golden(spark, digest, matches):
    files = spark.createDataFrame(
        [(1, 0, "exame.pdf", "hash-correto", "drafts/intake/exame.pdf")],
        "intake_no int, file_index int, filename string, sha256 string, key string",
    )
    sources = spark.createDataFrame([(1, 0, "exame.pdf", digest)], "intake_no int, index int, path string, sha256 string")
    assert verify_manifest(files, sources).first().matches == matches


@pytest.mark.parametrize("value, valid", [
    ("intake-20260815T155045Z-da4bf173", True), ("../../case", False),
    ("intake-20261315T155045Z-da4bf173", False), ("intake-20260815T155045Z-da4bf17", False),
    ("intake-20260815T155045Z-da4bf17g", False), ("intake-20260815T155045Z-da4b-f173", False),
    ("intake-20260815T155045Z-DA4BF173", True), ("intake-20260230T155045Z-da4bf173", False),
    ("intake-20260815T155045.5Z-da4bf173", True), ("", False), (None, False),
])
def test_id_golden(one, value, valid):
    column = F.lit(value).cast("string")
    swapped = F.replace(column, F.lit("intake-"), F.lit("case-"))
    assert tuple(one(valid_intake_id(column), F.coalesce(valid_case_id(swapped), F.lit(False)))) == (valid, valid)
