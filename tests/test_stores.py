"""Lineage inside documents, confirm and sweep on stored drafts, inventories: small cases with known answers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from chartloom.functions.variants import as_list, at
from chartloom.operators import lifecycle as lc
from chartloom.operators import lineage as ln
from chartloom.sources import generations as g
from chartloom.sources import inventory as inv
from chartloom.sources import tables as tb

T0 = dt.datetime(2024, 1, 1)
IDS = [f"intake-20240101T000000Z-0000000{n}" for n in range(6)]
UPLOADS = "array<struct<file_index:int,filename:string,content_type:string,size_bytes:bigint,sha256:string,key:string>>"


def upload(n, name, digest="h"):
    return (n, name, "application/pdf", 10 + n, f"{digest}{n}", f"drafts/x/t{n}-{name}")


def document(spark, analysis, uploads, column):
    rows = spark.createDataFrame([(json.dumps(analysis), uploads)], f"raw string, uploads {UPLOADS}")
    return rows.select(column(F.parse_json("raw"), F.col("uploads")).alias("out"))


def test_documents_get_one_entry_per_upload(spark):
    listed = [
        7, None, {"path": "in/b.pdf", "exam": "late", "pages": [1]}, {"filename": "b.pdf", "exam": "later"}, {"path": 3, "filename": "a.pdf", "sha256": "old"},
        {"path": "gone.pdf"},
    ]
    uploads = [upload(0, "a.pdf"), upload(1, "b.pdf"), upload(2, "b.pdf"), upload(3, "c.pdf")]
    out = document(spark, {"x": 1, "source_files": listed}, uploads, lambda a, u: F.to_json(ln.enriched_document(a, u)))
    got = json.loads(out.first().out)

    def entry(n, name, **more):
        return {"index": n, "path": name, "type": "application/pdf", "size_bytes": 10 + n, "sha256": f"h{n}", **more}

    assert got == {"x": 1, "source_files": [
        entry(0, "a.pdf", filename="a.pdf"), entry(1, "b.pdf", exam="late", pages=[1]), entry(2, "b.pdf", exam="late", pages=[1]), entry(3, "c.pdf"),
    ]}


@pytest.mark.parametrize("analysis", [{}, {"source_files": None}, {"source_files": {"a": 1}}, {"source_files": []}])
def test_documents_without_a_list_get_one(spark, analysis):
    out = document(spark, analysis, [upload(0, "a.pdf")], lambda a, u: F.size(as_list(at(ln.enriched_document(a, u), "source_files"))))
    assert out.first().out == 1


@pytest.mark.parametrize(("change", "fine"), [
    (lambda s: None, True), (lambda s: s[1].update(sha256="other"), False), (lambda s: s[0].update(path="in/else.pdf"), False),
    (lambda s: s[0].update(path="in/a.pdf"), True), (lambda s: s.pop(), False), (lambda s: s.reverse(), False), (lambda s: s.append({}), False),
])
def test_manifest_inside_the_row(spark, change, fine):
    sources = [{"sha256": "h0", "path": "a.pdf"}, {"sha256": "h1", "path": "b.pdf"}]
    change(sources)
    uploads = [upload(0, "a.pdf"), upload(1, "b.pdf")]
    assert document(spark, {"source_files": sources}, uploads, ln.document_matches).first().out is fine
    assert document(spark, {"y": 1}, uploads, ln.document_matches).first().out is False


def test_promoted_paths_leave_other_members_alone(spark):
    analysis = {"source_files": [{"path": "a.pdf", "exam": "e"}, "text", {"path": "more.pdf"}], "k": [1]}
    out = document(spark, analysis, [upload(0, "a.pdf"), upload(1, "b.pdf")], lambda a, u: F.to_json(ln.promoted_document(a, F.lit("case-1"), u)))
    assert json.loads(out.first().out) == {"source_files": [{"path": "cases/case-1/t0-a.pdf", "exam": "e"}, "text", {"path": "more.pdf"}], "k": [1]}


def test_each_of_six_answers(spark):
    drafts = spark.createDataFrame(
        [(IDS[0], T0, "{}", True), (IDS[1], T0, "{", True), (IDS[2], T0, "{}", False), (IDS[3], T0, "{}", True)], "intake_id string, created_at timestamp, raw string, manifest_ok boolean"
    ).select("intake_id", "created_at", F.try_parse_json("raw").alias("analysis"), "manifest_ok")
    cases = spark.createDataFrame([(i.replace("intake-", "case-"),) for i in (IDS[0], IDS[4])], "case_id string")
    hour = dt.timedelta(hours=1)
    asked = [(IDS[0], hour), (IDS[0], 24 * hour), (IDS[1], hour), (IDS[2], hour), (IDS[3], 25 * hour), (IDS[4], 99 * hour), (IDS[5], hour), ("intake-1", hour), (None, hour), (IDS[0] + "x", hour)]
    requests = spark.createDataFrame([(i, T0 + t, n) for n, (i, t) in enumerate(asked)], "intake_id string, requested_at timestamp, n int")
    answers = {r.n: r.outcome for r in lc.route_confirms(requests, drafts, cases).collect()}
    assert [answers[n] for n in range(len(asked))] == [
        "confirmed", "confirmed", "undecodable", "invalid_or_expired", "invalid_or_expired", "already_confirmed", "not_found", "invalid_id", "invalid_id", "invalid_id",
    ]


@pytest.fixture
def staged(spark, tmp_path):
    """Three drafts with two files each; the second draft's document does not match its files."""
    root = str(tmp_path / "store")
    rows = []
    for n, intake in enumerate(IDS[:3]):
        uploads = [(i, f"{i}.pdf", "application/pdf", 5, f"h{i}", f"drafts/{intake}/t-{i}.pdf") for i in range(2)]
        sources = [{"sha256": f"h{i}" if n != 1 else "bad", "path": f"{i}.pdf"} for i in range(2)]
        rows.append((intake, T0, uploads, json.dumps({"source_files": sources})))
    drafts = spark.createDataFrame(rows, f"intake_id string, created_at timestamp, files {UPLOADS}, raw string")
    files = spark.createDataFrame([(i, n, f"drafts/{i}/t-{n}.pdf") for i in IDS[:3] for n in range(2)], "intake_id string, file_index int, key string")
    tb.write_drafts(drafts.select("intake_id", "created_at", "files", F.parse_json("raw").alias("analysis")), files, root)
    return root


def test_confirm_survives_a_crash_between_commit_and_clean_up(spark, staged, monkeypatch):
    requests = spark.createDataFrame([(i, T0 + dt.timedelta(hours=h)) for i, h in ((IDS[0], 1), (IDS[0], 2), (IDS[1], 1), (IDS[5], 1))], "intake_id string, requested_at timestamp")

    def answers(rows):
        return sorted((r.intake_id, r.outcome) for r in rows.collect())

    first = [(IDS[0], "confirmed"), (IDS[0], "confirmed"), (IDS[1], "invalid_or_expired"), (IDS[5], "not_found")]
    with monkeypatch.context() as m:
        m.setattr(tb, "discard_drafts", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            tb.confirm_drafts(spark, staged, requests)
    assert tb.read_drafts(spark, staged).count() == 3 and tb.read_cases(spark, staged).count() == 1
    assert answers(tb.confirm_drafts(spark, staged, requests)) == first
    case = tb.read_cases(spark, staged).select("case_id", F.to_json("analysis").alias("j")).collect()
    assert len(case) == 1 and [s["path"] for s in json.loads(case[0].j)["source_files"]] == [f"cases/{case[0].case_id}/t-{i}.pdf" for i in range(2)]
    assert {r.key for r in tb.read_files(spark, staged).collect()} == {f"cases/{case[0].case_id}/t-{i}.pdf" for i in range(2)}
    assert sorted(r.intake_id for r in tb.read_drafts(spark, staged).collect()) == IDS[1:3]
    again = [(IDS[0], "already_confirmed"), (IDS[0], "already_confirmed"), *first[2:]]
    assert answers(tb.confirm_drafts(spark, staged, requests)) == again
    swept = tb.sweep_drafts(spark, staged, F.lit("2024-01-03 00:00:00").cast("timestamp"))
    assert sorted(r.intake_id for r in swept.collect()) == IDS[1:3]
    assert tb.read_drafts(spark, staged).count() == tb.read_draft_files(spark, staged).count() == 0


def test_commits_are_numbered_and_name_what_is_live(spark, staged):
    assert {r.commit for r in g.commits(spark, staged).collect()} == {1}
    g.switch(spark, staged, [])
    assert g.commits(spark, staged).agg(F.max("commit")).first()[0] == 1
    assert g.live(spark, staged, "drafts").count() == 1 and g.live(spark, staged, "cases").count() == 0


def test_prefixes_and_pages_of_an_inventory(spark, tmp_path):
    keys = ["a", "a/1/x", "a/1/y", "a/2/x", "a/top", "a0", "ab/1/x", "é/1", "a/￿/z"]
    path = f"file://{tmp_path}/inventory"
    inv.write_inventory(spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "key string, size_bytes long").repartition(3), path)
    stored = inv.read_inventory(spark, path)
    below = [k for k in keys if k.startswith("a/")]
    assert sorted(r.key for r in inv.under_prefix(stored, "a/").collect()) == sorted(below)
    assert inv.under_prefix(stored, "").count() == len(keys)
    assert {tuple(r) for r in inv.child_prefixes(stored, "a/").collect()} == {("1", 2, 3), ("2", 1, 3), ("￿", 1, 8)}
    after, seen = None, []
    while page := [r.key for r in inv.next_page(stored, "a/", after, 2).collect()]:
        after = page[-1]
        seen += page
    assert seen == sorted(below, key=str.encode)
    plan = inv.next_page(stored, "a/", "a/1/x", 2)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(key,a/1/x)" in plan and "LessThan(key,a0)" in plan


def test_an_oversized_response_is_told_apart_from_broken_json(spark):
    from chartloom.config import Limits
    from chartloom.sources.extraction import fold_responses

    fine = json.dumps({"status": "completed", "output": [{"content": [{"type": "output_text", "text": "{}"}]}]})
    rows = spark.createDataFrame([(0, 200, fine), (1, 200, fine + " " * 200), (2, 200, fine[:-3]), (3, 200, "{" + " " * 300)], "n int, http_status int, raw string")
    answers = {r.n: r.outcome for r in fold_responses(rows, Limits(max_response=len(fine) + 50)).collect()}
    assert answers == {0: "ok", 1: "too_large", 2: "invalid", 3: "too_large"}


def test_repair_requests_hold_only_files_to_look_at_again(spark):
    from chartloom.sources.extraction import repair_lines

    eye = {"pachymetry": {"thinnest_um": 500}, "anterior_cornea": {"kmax_d": 44}, "belin_ambrosio": {"d": 1.0, "art_max": 300}}

    def case(n, left, source):
        return (f"case-{n}", json.dumps({"exams": {"pentacam_corneal_tomography": {"source": source, "eyes": {"OD": eye, "OS": left}}}}))

    cases = spark.createDataFrame([case(0, eye, ["a.pdf"]), case(1, {}, ["x/a.pdf"]), case(2, {}, [])], "case_id string, raw string").select("case_id", F.parse_json("raw").alias("analysis"))
    files = spark.createDataFrame([(f"case-{n}", i, f"{x}.pdf", "application/pdf", b"1") for n in range(3) for i, x in enumerate("ab")], "case_id string, file_index int, filename string, content_type string, content binary")
    lines = repair_lines(cases, files, "again", "m").collect()
    assert [r.case_id for r in lines] == ["case-1"]
    request = json.loads(lines[0].line)
    assert request["max_output_tokens"] == 5000 and [p.get("filename") for p in request["input"][0]["content"]] == [None, None, "a.pdf"]
