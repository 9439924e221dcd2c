"""Keyed streaming state over unordered pieces and restarts, against the batch forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chartloom.config import Limits
from chartloom.operators.admission import admit
from chartloom.operators.lifecycle import draft_states
from chartloom.streaming import keyed
from chartloom.streaming import lifecycle as jobs

T0 = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def put(spark, rows, schema, folder):
    """One more file of a source table."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def source(spark, root, name):
    return jobs.table_stream(spark, root, name, maxFilesPerTrigger="1")


def test_draft_states_over_unordered_files_and_a_restart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "FEW", 3)
    rng = random.Random(4)
    drafts = [(k, T0 + k * 5 * HOUR) for k in range(60)]
    requests = [(k, T0 + k * 5 * HOUR + rng.randint(-3, 40) * HOUR, rng.choice(["confirm", "discard"])) for k in range(70) for _ in range(rng.randint(0, 3))]
    requests += [(7, T0 + 35 * HOUR + n * HOUR / 10, "confirm") for n in range(200)] * 2 + [(None, T0, "confirm")]
    rng.shuffle(drafts)
    rng.shuffle(requests)
    root, base = str(tmp_path), f"file://{tmp_path}/run"
    result = None
    for start in (0, 2):  # the second run goes on with files that came meanwhile
        for part in range(start, start + 2):
            put(spark, requests[part::4], "k long, requested_at timestamp, action string", f"{root}/requests.parquet")
            put(spark, drafts[part::4], "k long, created_at timestamp", f"{root}/drafts.parquet")
        events = keyed.draft_events(source(spark, root, "drafts"), source(spark, root, "requests"), "k")
        result = keyed.draft_changes(events, "k", base, ttl_hours=24)
    batches = spark.read.parquet(f"{base}/out").select("batch_id").distinct().count()
    assert batches >= 3
    all_drafts, all_requests = spark.read.parquet(f"{root}/drafts.parquet"), spark.read.parquet(f"{root}/requests.parquet")
    for moment in (T0 + 100 * HOUR, T0 + 1000 * HOUR):
        as_of = F.lit(moment.isoformat(sep=" ")).cast("timestamp")
        want = {(r.k, r.state) for r in draft_states(all_drafts, all_requests, "k", as_of).collect()}
        got = [(r.k, r.state) for r in keyed.state_at(result, as_of).collect()]
        assert set(got) == want and len(got) == len(want) == 60
    hits = {k for k, t in drafts if any(r == k and a == "confirm" and t <= at <= t + 24 * HOUR for r, at, a in requests)}
    assert {r.k for r in keyed.confirmed(result, "k").collect()} == hits
    late = F.lit((T0 + 1000 * HOUR).isoformat(sep=" ")).cast("timestamp")
    assert {r.k for r in keyed.expired(result, "k", late).collect()} == {k for k, _ in drafts} - hits


def test_draft_states_need_no_state_store_and_skip_requests_without_a_time(spark, tmp_path):
    root, base = str(tmp_path), f"file://{tmp_path}/run"
    put(spark, [(1, T0), (1, T0 + HOUR), (2, T0), (3, None)], "k long, created_at timestamp", f"{root}/drafts.parquet")
    put(spark, [(1, T0 + 3 * HOUR, "confirm"), (1, T0 + 2 * HOUR, "confirm"), (1, None, "confirm"), (2, T0 + 30 * HOUR, "discard"), (3, T0, "confirm")],
        "k long, requested_at timestamp, action string", f"{root}/requests.parquet")
    events = keyed.draft_events(source(spark, root, "drafts"), source(spark, root, "requests"), "k")
    found = {r.k: r.confirm_us for r in keyed.draft_changes(events, "k", base).collect()}
    assert found == {1: int((T0 + 2 * HOUR).replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000), 2: None}
    assert not (tmp_path / "run/checkpoint/state").exists()


def test_state_of_a_draft_goes_after_its_time(spark, tmp_path):
    """A forgotten draft is made anew by its next row; a kept one stays."""
    for keep_ms, created in ((1, T0 + HOUR), (None, T0)):
        root, base = f"{tmp_path}/{keep_ms}", f"file://{tmp_path}/{keep_ms}/run"
        put(spark, [(1, T0, "confirm")], "k long, requested_at timestamp, action string", f"{root}/requests.parquet")
        for at in (T0, T0 + HOUR):
            put(spark, [(1, at)], "k long, created_at timestamp", f"{root}/drafts.parquet")
            events = keyed.draft_events(source(spark, root, "drafts"), source(spark, root, "requests"), "k")
            got = keyed.draft_changes(events, "k", base, keep_ms=keep_ms).collect()
        assert [r.created_us for r in got] == [int(created.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)]


@pytest.fixture
def pieces():
    """Sets of one to six files, some refused, a few delivered twice."""
    rng = random.Random(9)
    rows = []
    for intake in range(40):
        n = rng.randint(1, 6)
        rows += [(intake, i, f"f{i}.pdf", rng.choice(["application/pdf"] * 5 + ["text/plain"]), rng.choice([10, 10, 10, 900]), n) for i in range(n)]
    rng.shuffle(rows)
    return rows, rows[:25]


FILES = "intake_no long, file_index long, filename string, content_type string, size_bytes long, n_announced long"


def test_sets_in_pieces_get_one_verdict_each(spark, tmp_path, pieces):
    rows, twice = pieces
    limits = Limits(max_file=500, max_set=40)
    root, base = str(tmp_path), f"file://{tmp_path}/run"
    missing = [r for r in rows if (r[0], r[1]) == (rows[-1][0], rows[-1][1])]
    arriving = [r for r in rows if r not in missing]
    for start in (0, 2):
        for part in range(start, start + 2):
            put(spark, [*arriving[part::4], *twice[part::4]], FILES, f"{root}/files.parquet")
        done, still_open = keyed.admitted_sets(source(spark, root, "files"), base, limits)
    assert spark.read.parquet(f"{base}/out").select("batch_id").distinct().count() == 4
    whole = [r for r in arriving if r[0] != missing[0][0]]
    want = sorted(map(tuple, admit(spark.createDataFrame(whole, FILES).drop("n_announced"), limits).collect()))
    assert sorted(map(tuple, done.collect())) == want
    closed = keyed.judge_incomplete(still_open).collect()
    assert [(r.intake_no, r.reason, r.admitted) for r in closed] == ([(missing[0][0], "incomplete", False)] if missing[0][5] > 1 else [])
    assert done.select("intake_no").distinct().count() == done.count()
