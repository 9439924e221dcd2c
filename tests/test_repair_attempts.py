"""Several repair attempts per case, oversized documents and the state of a scanned file."""

import json

from pyspark.sql import functions as F

from chartloom.config import Limits
from chartloom.operators.repair import apply_repairs, best_attempts
from chartloom.sources import files as fs

GOOD = json.dumps({"eyes": {"OD": {"belin_ambrosio": {"d": 0.65, "art_max": 416}}, "OS": {"belin_ambrosio": {"d": 2.27, "art_max": 366}}}})
POOR = json.dumps({"eyes": {"OD": {}}})
EYE = {"general": {"pachymetry_thinnest_um": 529, "k_max_anterior_diopters": 44.2}}


def case(spark, case_id="c1"):
    doc = json.dumps({"exams": {"pentacam_corneal_tomography": {"source": [], "eyes": {"OD": EYE, "OS": EYE}}}})
    return spark.createDataFrame([(case_id, doc)], "case_id string, raw string").select("case_id", F.parse_json("raw").alias("analysis"))


def repaired(spark, attempts):
    rows = spark.createDataFrame([("c1", x) for x in attempts], "case_id string, raw string")
    out = apply_repairs(case(spark), rows).select(F.to_json("analysis")).first()[0]
    eyes = json.loads(out)["exams"]["pentacam_corneal_tomography"]["eyes"]
    return eyes["OD"].get("belin_ambrosio", {}).get("d")


def test_broken_and_poor_attempts_never_win(spark):
    assert repaired(spark, ["", "error: timeout", "[1]", None, POOR, GOOD]) == 0.65
    assert repaired(spark, ["", "error: timeout"]) is None
    assert repaired(spark, [POOR]) is None


def test_of_equal_attempts_the_latest_wins(spark):
    other = GOOD.replace("0.65", "0.75")
    rows = spark.createDataFrame([("c1", other, 1), ("c1", GOOD, 2)], "case_id string, raw string, attempt int")
    assert best_attempts(rows).first()["_raw"] == GOOD


def test_oversized_documents_are_listed(spark, tmp_path):
    for name, size in (("small", 10), ("large", 500)):
        folder = tmp_path / "cases" / name
        folder.mkdir(parents=True)
        (folder / fs.MARKER_NAME).write_text("x" * size)
    limits = Limits(max_document=100)
    root = f"file://{tmp_path}"
    assert [r["case_id"] for r in fs.read_documents(spark, root, limits).collect()] == ["small"]
    rejects = fs.document_rejects(spark, root, limits).collect()
    assert [(r["case_id"], r["size_bytes"], r["reason"]) for r in rejects] == [("large", 500, "too_large")]


def test_scan_tells_unhashed_files_apart(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    (tmp_path / "b").write_text("y" * 50)
    states = {r["filename"]: (r["state"], r["sha256"] is None) for r in fs.scan_files(spark, f"file://{tmp_path}", Limits(max_file=10)).collect()}
    assert states == {"a": ("hashed", False), "b": ("too_large", True)}
