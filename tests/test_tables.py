"""Sources and sinks on real folders."""

import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chartloom.config import Limits
from chartloom.operators.lifecycle import case_listing
from chartloom.operators.normalize import parse_cases
from chartloom.sources import files as fs
from chartloom.sources import generations as g
from chartloom.sources import tables as tb

IDS = ["case-20240101T000000Z-00000001", "case-20240101T000000Z-00000002", "case-20240102T000000Z-00000003"]


@pytest.fixture
def lake(spark, tmp_path):
    cases = spark.createDataFrame([(i, json.dumps({"patient": {"full_name": i[-1]}})) for i in IDS], "case_id string, raw string")
    files = spark.createDataFrame(
        [(i, n, f"drafts/x/{n}-a.pdf") for i in IDS for n in range(2)], "case_id string, file_index int, key string"
    )
    root = str(tmp_path / "lake")
    tb.commit_cases(parse_cases(cases), files, root)
    return root


def _ids(df):
    return sorted({r.case_id for r in df.select("case_id").collect()})


def test_commit_moves_keys_and_reads_back(spark, lake):
    assert _ids(tb.read_cases(spark, lake)) == IDS
    assert {r.key for r in tb.read_files(spark, lake).collect()} == {f"cases/{i}/{n}-a.pdf" for i in IDS for n in range(2)}


def test_repeated_commit_adds_nothing_and_ids_without_a_day_can_go(spark, lake):
    def commit(ids):
        cases = spark.createDataFrame([(i, "{}") for i in ids], "case_id string, raw string")
        files = spark.createDataFrame([(i, 0, "drafts/x/0-a.pdf") for i in ids], "case_id string, file_index int, key string")
        tb.commit_cases(parse_cases(cases), files, lake)

    commit([IDS[0], IDS[0], "odd"])
    commit(["odd"])
    assert sorted(r.case_id for r in tb.read_cases(spark, lake).collect()) == [*IDS, "odd"]
    assert tb.read_files(spark, lake).count() == 2 * len(IDS) + 1
    tb.erase_cases(spark, lake, spark.createDataFrame([("odd",)], "case_id string"))
    assert _ids(tb.read_cases(spark, lake)) == IDS and tb.read_files(spark, lake).count() == 2 * len(IDS)


def test_files_without_marker_are_invisible(spark, lake):
    orphan = spark.createDataFrame([("case-20240103T000000Z-00000009", 0, "drafts/x/a.pdf", 0)], "case_id string, file_index int, key string, version long")
    g.switch(spark, lake, g.upsert(spark, lake, "files", orphan, ["case_id", "key"]))
    assert _ids(tb.read_files(spark, lake)) == IDS


def test_only_repeated_keys_are_put_in_order(spark, tmp_path):
    schema = "case_id string, version long, text string"

    def newest(rows):
        return g.newest(spark.createDataFrame(rows, schema), ["case_id"], str(tmp_path / "spool"))

    once = [("a", 1, "x"), ("b", None, None), (None, 2, "y")]
    found = newest(once)
    assert "max_by" not in found._jdf.queryExecution().toString()  # every row went through it before
    assert sorted(map(tuple, found.collect()), key=str) == sorted(once, key=str)
    twice = [("a", 1, "x"), ("a", 2, "w"), ("a", 2, "v"), ("b", None, "p"), ("b", 0, "n"), (None, 1, "z"), (None, 2, "y"), ("c", 1, None)]
    assert {tuple(r) for r in newest(twice).collect()} == {("a", 2, "w"), ("b", 0, "n"), (None, 2, "y"), ("c", 1, None)}


def test_stored_rows_are_joined_once(spark, lake, monkeypatch):
    spooled = []
    monkeypatch.setattr(g, "_spool", lambda rows, root, spool=g._spool: spooled.append(spool(rows, root)) or spooled[-1])
    again = spark.createDataFrame([(IDS[0], 0, "cases/k", 0), (IDS[0], 0, f"cases/{IDS[0]}/0-a.pdf", 0)], "case_id string, file_index int, key string, version long")
    changes = g.upsert(spark, lake, "files", again, ["case_id", "key"])
    # What outdoes stored rows is written once and read for the days and for the rows.
    assert [r.key for r in spooled[-1].collect()] == ["cases/k"] and [c[3] for c in changes] == [False]


def test_erase_one_of_a_day_and_a_whole_day(spark, lake):
    ids = [IDS[0], IDS[2], "case-20990101T000000Z-00000000"]
    answer = tb.erase_cases(spark, lake, spark.createDataFrame([(i,) for i in ids], "case_id string"))
    assert {tuple(r) for r in answer.collect()} == {(IDS[0], 3, "deleted"), (IDS[2], 3, "deleted"), (ids[2], 0, "not_found")}
    assert _ids(tb.read_cases(spark, lake)) == [IDS[1]] and _ids(tb.read_files(spark, lake)) == [IDS[1]]
    assert tb.purge(spark, lake) == 4
    assert not [p for p in Path(lake, "cases").rglob("*") if "20240102" in p.name or "2099" in p.name]
    again = tb.erase_cases(spark, lake, spark.createDataFrame([(IDS[0],)], "case_id string"))
    assert again.first().outcome == "not_found" and _ids(tb.read_cases(spark, lake)) == [IDS[1]] and tb.purge(spark, lake) == 0


def test_a_job_that_dies_before_its_commit_changes_nothing(spark, lake, monkeypatch):
    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(g, "switch", die)
        for job in (
            lambda: tb.erase_cases(spark, lake, spark.createDataFrame([(IDS[0],)], "case_id string")),
            lambda: commit(spark, lake, IDS, 7),
        ):
            with pytest.raises(RuntimeError):
                job()
    assert _ids(tb.read_cases(spark, lake)) == IDS and tb.read_files(spark, lake).count() == 6
    assert {r.version for r in tb.read_cases(spark, lake).collect()} == {0}
    assert tb.purge(spark, lake) == 6  # what the dead jobs had written
    tb.erase_cases(spark, lake, spark.createDataFrame([(IDS[0],)], "case_id string"))
    assert _ids(tb.read_cases(spark, lake)) == IDS[1:] and tb.read_files(spark, lake).count() == 4


def commit(spark, lake, ids, version, name="n"):
    cases = spark.createDataFrame([(i, json.dumps({"patient": {"full_name": f"{name}{version}"}}), version) for i in ids], "case_id string, raw string, version long")
    files = spark.createDataFrame([(i, 0, "drafts/x/0-a.pdf", version) for i in ids], "case_id string, file_index int, key string, version long")
    tb.commit_cases(parse_cases(cases).select("case_id", "analysis", "version"), files, lake)


@pytest.mark.parametrize("order", [(1, 3, 2), (3, 2, 1), (2, 1, 3)])
def test_the_newest_version_wins_in_any_order(spark, tmp_path, order):
    lake = str(tmp_path / "lake")
    for version in order:
        commit(spark, lake, IDS[: version], version)
    names = {r.case_id: r.n for r in tb.read_cases(spark, lake).select("case_id", F.try_variant_get("analysis", "$.patient.full_name", "string").alias("n")).collect()}
    assert names == dict.fromkeys(IDS, "n3") and tb.read_files(spark, lake).count() == 3
    commit(spark, lake, [IDS[0], IDS[0]], 3, "other")
    assert tb.read_cases(spark, lake).where("try_variant_get(analysis, '$.patient.full_name', 'string') <> 'n3'").count() == 0


def test_cases_are_read_by_id_from_their_days_only(spark, lake):
    some = spark.createDataFrame([(IDS[2],), ("case-20990101T000000Z-00000000",), (None,)], "case_id string")
    rows = tb.read_cases(spark, lake, some)
    assert _ids(rows) == [IDS[2]]
    assert "PartitionFilters: [day" in rows._jdf.queryExecution().executedPlan().toString()


def test_erase_takes_ids_without_a_case(spark, lake):
    tb.erase_cases(spark, lake, spark.createDataFrame([("not-an-id",), (None,)], "case_id string"))
    assert _ids(tb.read_cases(spark, lake)) == IDS


def test_drafts_round_trip_and_discard(spark, tmp_path):
    root = str(tmp_path / "d")
    ids = [i.replace("case-", "intake-") for i in IDS]
    drafts = spark.createDataFrame([(i, "{}") for i in ids], "intake_id string, raw string")
    files = spark.createDataFrame([(i, f"drafts/{i}/a.pdf") for i in ids], "intake_id string, key string")
    tb.write_drafts(drafts, files, root)
    tb.discard_drafts(spark, root, spark.createDataFrame([(ids[2],), ("intake-20990101T000000Z-00000000",)], "intake_id string"))
    assert sorted(r.intake_id for r in tb.read_drafts(spark, root).collect()) == ids[:2]
    assert tb.read_draft_files(spark, root).count() == 2


def test_file_scan_and_bounds(spark, tmp_path):
    for name, body in (("a b.pdf", b"x" * 10), ("sub/c.png", b"y" * 100)):
        target = tmp_path / "in" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(body)
    rows = {r.filename.replace("%20", " "): r for r in fs.scan_files(spark, str(tmp_path / "in"), Limits(max_file=50)).collect()}
    assert rows["a b.pdf"].sha256 == __import__("hashlib").sha256(b"x" * 10).hexdigest()
    assert rows["c.png"].sha256 is None and rows["c.png"].size_bytes == 100
    plan = fs.list_objects(spark, str(tmp_path / "in"))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_read_list_and_skip_unreadable(spark, tmp_path):
    for case, body in ((IDS[0], '{"patient":{"full_name":"Ana"}}'), (IDS[1], '{"patient"'), (IDS[2], " " * 200)):
        target = tmp_path / "s" / "cases" / case / "paciente_compilado.json"
        target.parent.mkdir(parents=True)
        target.write_text(body)
    (tmp_path / "s" / "cases" / IDS[0] / "a.pdf").write_bytes(b"1")
    root = str(tmp_path / "s")
    objects = fs.list_objects(spark, root)
    assert fs.under_prefix(objects, f"cases/{IDS[0]}").count() == 2
    documents = fs.read_documents(spark, root, Limits(max_document=100))
    good, bad = fs.split_readable(documents)
    assert _ids(good) == [IDS[0]] and _ids(bad) == [IDS[1]]
    listing = case_listing(fs.child_prefixes(objects, "cases"), good)
    assert [tuple(r) for r in listing.collect()] == [(IDS[0], "Ana", f"cases/{IDS[0]}/paciente_compilado.json")]
    tb.write_listing(listing, str(tmp_path / "list"))
    assert spark.read.json(str(tmp_path / "list")).first().patientName == "Ana"
    tb.write_pretty(good, str(tmp_path / "pretty"))
    row = spark.read.json(str(tmp_path / "pretty")).first()
    assert (row.case_id, row.document) == (IDS[0], '{\n  "patient": {\n    "full_name": "Ana"\n  }\n}')


def test_silver_reads_only_used_paths(spark, tmp_path):
    docs = spark.createDataFrame([(i, json.dumps({"patient": {"full_name": "A"}, "exams": {}})) for i in IDS], "case_id string, raw string")
    path = str(tmp_path / "silver")
    tb.write_silver(docs, path)
    names = spark.read.parquet(path).select(F.try_variant_get("analysis", "$.patient.full_name", "string").alias("n"))
    assert [r.n for r in names.collect()] == ["A"] * 3
    plan = names._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<analysis:struct<0:string>>" in plan


def test_file_set_is_written_by_many_tasks(spark, tmp_path):
    # Adaptive execution put the narrow rows into one task before, which created all files one after the other.
    from chartloom.plans import QUERIES
    from chartloom.session import shared_dir

    rows = [(i, f"Supplier#{i % 50:03d}", i % 25) for i in range(40)] + [(7, "Supplier#again", 7)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    root = Path(re.sub("^file:/*", "/", shared_dir(spark)))
    before = set(root.glob("files-*"))
    got = QUERIES["stored_file_set"](spark, str(tmp_path)).collect()
    files = [f for folder in set(root.glob("files-*")) - before for f in folder.glob("s_suppkey=*/part-*")]
    assert len(files) == 40 and len({f.name.split("-")[1] for f in files}) > 1
    assert sorted(r.s_suppkey for r in got) == list(range(40))
    assert {r.s_suppkey for r in got if r.state == "too_large"} == {7}


def test_indented_documents_take_less_room_than_their_text(spark, tmp_path):
    # Written as they are, their leading spaces took most of the disk.
    deep = {"x": 1}
    for _ in range(40):
        deep = {"a": deep}
    docs = spark.range(500).select(F.concat(F.lit("case-"), F.col("id")).alias("case_id"), F.parse_json(F.lit(json.dumps(deep))).alias("analysis"))
    tb.write_pretty(docs, str(tmp_path / "pretty"))
    back = spark.read.json(str(tmp_path / "pretty")).collect()
    assert {r.document for r in back} == {json.dumps(deep, indent=2)} and len({r.case_id for r in back}) == 500
    size = sum(f.stat().st_size for f in (tmp_path / "pretty").glob("part-*"))
    assert size * 5 < sum(len(r.document) for r in back)


def test_indentation_of_texts_that_no_parser_made(spark):
    texts = ['{ "a" : [ ] , "b":[1 , {}]}', "", "7", "[", "]", "[[", '{"a":"\\"{["}', None, "}{,:", '["\u00a0"]']
    want = ['{\n  "a": [],\n  "b": [\n    1,\n    {}\n  ]\n}', "", "7", "[\n  ", "\n]", "[\n  [\n    ", '{\n  "a": "\\"{["\n}', None,
            "\n}{\n,\n: ", '[\n  "\u00a0"\n]']
    from chartloom.functions.text import pretty_json

    rows = spark.createDataFrame([*enumerate(texts)], "i int, t string").select("i", pretty_json(F.col("t")).alias("p")).collect()
    assert {r.i: r.p for r in rows} == dict(enumerate(want))
