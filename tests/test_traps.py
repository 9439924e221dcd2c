"""One test per semantic trap of the data model."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from chartloom import config as c
from chartloom.functions import text, variants as v
from chartloom.operators import rules
from chartloom.operators.contract import check_contract
from chartloom.operators.lineage import attach_sources, with_defaults
from chartloom.operators.normalize import normalize, parse_cases
from chartloom.operators.repair import completeness, merged_document


def J(value):
    return F.parse_json(F.lit(json.dumps(value)))


def cases(spark, *documents):
    rows = [(f"case-{i}", json.dumps(d)) for i, d in enumerate(documents)]
    return parse_cases(spark.createDataFrame(rows, "case_id string, raw string"))


def case_of(cornea, iol=None, micro=None):
    return {"exams": {
        "pentacam_corneal_tomography": {"source": ["a.pdf"], "eyes": {"OD": cornea}},
        "iol_calculation": {"source": [], "eyes": {"OD": iol or {}}},
        "specular_microscopy": {"source": [], "eyes": {"OD": micro or {}}},
    }}


def gold_od(spark, *args):
    return normalize(cases(spark, case_of(*args))).where("eye = 'OD'").first()


@pytest.mark.parametrize("value, expected", [(44, 44.0), (44.2, 44.2), (1e30, 1e30), ("44.2", None), (True, None), (None, None), ({}, None), ([1], None)])
def test_t1_number_guard(one, value, expected):
    assert one(v.number(J(value)))[0] == expected


def test_t2_t3_missing_is_null_and_labelled(spark):
    row = normalize(cases(spark, case_of({})))
    toric = rules.toric_flags(row).first()
    cells = rules.endothelium_flags(row).first()
    assert row.first().astigmatism_d is None
    assert (toric.label, toric.reference_label, toric.is_toric) == ("missing", c.NON_TORIC, False)
    assert (cells.label, cells.reference_label) == ("missing", c.ABOVE_CUTOFF)


def test_t4_object_level_fallback(spark):
    both = {"belin_ambrosio": {"q": 1}, "ectasia_reforcada_belin_ambrosio": {"d": 2.0}}
    assert gold_od(spark, both).bad_d is None
    assert gold_od(spark, {"belin_ambrosio": None, **{"ectasia_reforcada_belin_ambrosio": {"d": 2.0}}}).bad_d == 2.0
    assert gold_od(spark, {"belin_ambrosio": "x", "ectasia_reforcada_belin_ambrosio": {"d": 2.0}}).bad_d is None


def test_t5_repair_sees_every_leaf(spark):
    eye = {
        "pachymetry": {"thinnest_um": 500}, "anterior_cornea": {"kmax_d": 44}, "belin_ambrosio": {"q": 1},
        "ectasia_reforcada_belin_ambrosio": {"d": 1.0, "art_max": 300},
    }
    doc = {"exams": {"pentacam_corneal_tomography": {"source": [], "eyes": {"OD": eye, "OS": eye}}}}
    assert not completeness(cases(spark, doc)).first().needs_repair
    only_display = {**eye, "pachymetry": {}, "display_maps": {"belin_ambrósio": {"thinnest_pachy_um": 500}}}
    doc["exams"]["pentacam_corneal_tomography"]["eyes"]["OS"] = only_display
    row = completeness(cases(spark, doc)).first()
    assert row.needs_repair and row.missing_metrics == "OS.thinnest_um"
    assert gold_od(spark, only_display).thinnest_um == 500


def test_t6_text_stops_the_chain(spark):
    eye = {"pachymetry": {"thinnest_um": "520"}, "general": {"thinnest_pachy_um": 510}}
    assert gold_od(spark, eye).thinnest_um is None
    eye["pachymetry"]["thinnest_um"] = None
    assert gold_od(spark, eye).thinnest_um == 510


@pytest.mark.parametrize("target, repair, expected", [
    ({"a": 1}, {"a": {"b": 2}}, {"a": {"b": 2}}),
    ({"a": [1]}, {"a": {"b": None}}, {"a": {}}),
    ({"a": None}, {"a": {"b": 2}}, {"a": {"b": 2}}),
    ({"a": {"b": 1}}, {"a": 5}, {"a": {"b": 1}}),
    ({"a": 1}, {"a": 2, "b": 3}, {"a": 1, "b": 3}),
    ({"a": None}, {"a": None, "b": None}, {"a": None}),
    ({"a": False}, {"a": 7}, {"a": False}),
])
def test_t7_merge(one, target, repair, expected):
    assert json.loads(one(F.to_json(v.fill_missing(J(target), J(repair))))[0]) == expected


def test_t7_new_eyes_are_not_created(one):
    target = {"exams": {"pentacam_corneal_tomography": {"eyes": {"OD": {"x": None}, "OS": None}}}, "k": 1}
    repair = {"eyes": {"OD": {"x": 1}, "OS": {"x": 2}, "AO": {"x": 3}}}
    got = json.loads(one(F.to_json(merged_document(J(target), J(repair))))[0])
    assert got == {"exams": {"pentacam_corneal_tomography": {"eyes": {"OD": {"x": 1}, "OS": None}}}, "k": 1}
    assert json.loads(one(F.to_json(merged_document(J({"k": 1}), J(repair))))[0]) == {"k": 1}


def test_t8_t9_each_upload_has_its_row(spark):
    files = spark.createDataFrame([(1, 0, "a.pdf"), (1, 1, "a.pdf"), (1, 2, "b.pdf")], "intake_no int, file_index int, filename string")
    sources = spark.createDataFrame(
        [(1, 0, "x/a.pdf", None, "late"), (1, 1, None, "a.pdf", "later"), (1, 2, "gone.pdf", None, "none")],
        "intake_no int, source_pos int, path string, filename string, exam string",
    )
    rows = attach_sources(files, sources, ("exam",)).orderBy("file_index").collect()
    assert [(r.file_index, r.exam) for r in rows] == [(0, "late"), (1, "late"), (2, None)]


@pytest.mark.parametrize("raw, reason", [
    ('{"patient":{},"exams":{}}', None), ('{"patient":{},"exams":{}}xyz', "json"), ("", "json"), ("[]", "json"),
    ("{}},{", "json"), ("{}],[{}", "json"), ("nul", "json"), ("null", "patient"), ('"x"', "json"), ("{", "json"),
    ('{"patient":{}}', "exams"), ('{"patient":null,"exams":{}}', "patient"), ('{"patient":[],"exams":{}}', "json"),
    ('{"patient":{},"exams":{},"schema_version":1}', "json"), ('{"patient":{},"exams":{},"schema_version":null}', None),
    ('{"patient":{},"exams":{},"source_files":[1]}', "json"), ('{"patient":{},"exams":{},"source_files":[null,{}]}', None),
    ('{"patient":{},"exams":{},"language":1,"language":"x"}', None),
    ('{"patient":{},"exams":{"iol_calculation":{"source":null}}}', "source"),
    ('{"patient":{},"exams":{"iol_calculation":{"source":["a",null]}}}', None),
    ('{"patient":{},"exams":{"iol_calculation":{"source":["a",1]}}}', "source"),
    ('{"patient":{},"exams":{"iol_calculation":[]}}', "exam"), ('{"patient":{},"exams":{"iol_calculation":null}}', "exam"),
    ('{"Patient":{},"exams":{}}', "patient"),
])
def test_t10_to_t14_strict_contract(spark, raw, reason):
    assert check_contract(spark.createDataFrame([(raw,)], "raw string")).first().reason == reason


def test_smallest_failing_key_is_reported(spark):
    raw = '{"patient":{},"exams":{"zzz":{},"aaa":{},"iol_calculation":{}}}'
    row = check_contract(spark.createDataFrame([(raw,)], "raw string")).first()
    assert (row.offending_key, row.unknown_keys) == ("aaa", "aaa,zzz")


def test_t15_strict_and_lenient(spark):
    doc = case_of({"pachymetry": {"thinnest_um": 500}})
    del doc["exams"]["specular_microscopy"]
    assert normalize(cases(spark, doc)).count() == 0
    assert normalize(cases(spark, doc), strict=False).count() == 2


@pytest.mark.parametrize("value, shown", [
    (0.0625, "0,063"), (1234.5, "1.234,5"), (44.0, "44"), (-0.28, "-0,28"), (None, "não informado"),
    (float("nan"), "não informado"), (1234567.8914, "1.234.567,891"),
])
def test_t17_number_text(one, value, shown):
    assert one(text.pt_number(F.lit(value).cast("double")))[0] == shown


def test_t17_fixed_fraction(one):
    assert one(text.pt_number(F.lit(0.3), 3))[0] == "0,300"


def test_t20_bad_casts_give_null(one):
    assert one(text.leading_number(F.lit("NaN µm")), text.leading_number(F.lit("-.5e1 D")), text.leading_number(F.lit("abc")))[:] == (None, -5.0, None)


def test_defaults_only_for_absent_fields(one):
    got = json.loads(one(F.to_json(with_defaults(J({"language": None, "x": 1}), dt.date(2024, 1, 2))))[0])
    assert got == {"language": None, "x": 1, "schema_version": "1.0", "generated_on": "2024-01-02"}


@pytest.mark.parametrize("unrolled", [0, 1, 6])
def test_no_depth_changes_leaves_or_merge(spark, unrolled):
    def chain(levels, inner):
        for level in reversed(range(levels)):
            inner = {"s": level, "e": {}, "a": inner}
        return inner

    for levels in (1, 5, 6, 7, 13, 40, 300):
        target, repair = chain(levels, {"x": None, "y": [1, {"z": None}]}), chain(levels, {"x": 1, "y": 2, "n": None, "m": {"k": {}}})
        row = spark.range(1).select(
            F.to_json(v.fill_missing(J(target), J(repair), unrolled)).alias("m"),
            F.transform(v.leaves(J(target), unrolled), lambda x: F.struct(x["path"].alias("p"), F.to_json(x["value"]).alias("v"))).alias("l"),
        ).first()
        assert json.loads(row.m) == chain(levels, {"x": 1, "y": [1, {"z": None}], "m": {"k": {}}})
        end = "a." * levels
        want = {f"{'a.' * i}{k}": value for i in range(levels) for k, value in (("s", str(i)), ("e", "{}"))}
        assert {x.p: x.v for x in row.l} == want | {f"{end}x": "null", f"{end}y": '[1,{"z":null}]'}


@pytest.mark.parametrize("fn, value, expected", [
    (text.basename, "", "."), (text.basename, "a/b/", "b"), (text.basename, "///", "/"), (text.basename, "x.pdf", "x.pdf"),
    (text.last_segment, "a/", ""), (text.capitalize_first, "éCO dE", "ÉCO dE"), (text.initials, "ana maria souza", "AM"),
    (text.initials, "", ""), (text.file_kind, "A.PDF", "pdf"), (text.file_kind, "a.docx", "jpeg"), (text.eye_label, "OS", "OE"),
    (text.eye_label, "AO", "AO"), (text.path_escape, "a b/ç*~$&+:=@(1)", "a%20b%2F%C3%A7%2A~$&+:=@%281%29"),
    (text.report_id, "/relatorios/x1/", "x1"), (text.report_id, "/relatorios/a/b", None), (text.trim_slashes, "//a/b/", "a/b"),
])
def test_text_functions(one, fn, value, expected):
    assert one(fn(F.lit(value)))[0] == expected


def test_ages_and_cohorts(one):
    as_of = dt.date(2024, 6, 15)
    age = lambda d: rules.age_years(F.lit(d).cast("date"), as_of)
    assert one(age("1984-06-15"), age("1984-06-16"), age("2000-02-29"))[:] == (40, 39, 24)
    assert one(*[rules.age_cohort(F.lit(n).cast("int")) for n in (39, 40, 55, 56, None)])[:] == ("A", "B", "B", "C", "missing")


def test_formulas(one):
    pta = rules.altered_tissue_percent(F.lit(110.0), F.lit(70.0), F.lit(500.0))
    none = rules.altered_tissue_percent(F.lit(110.0), F.lit(70.0), F.lit(0.0))
    assert one(pta, none, rules.residual_bed(F.lit(110.0), F.lit(70.0), F.lit(500.0)))[:] == (36.0, None, 320.0)


def test_leaves_take_members_out_once_per_level(spark):
    conversions = str(v.leaves(F.col("d"), 3)).count("try_variant_get")
    assert conversions <= 3 + 2  # the root, each level and the fold below them
