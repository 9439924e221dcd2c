"""Streaming jobs over several arrivals against plain Python."""

import datetime as dt
import glob
import os
import uuid

import pytest

from chartloom.session import shared_dir
from chartloom.streaming import lifecycle as jobs

T0 = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


@pytest.fixture
def arrivals(spark, tmp_path):
    """Three files per side, in time order; intake 5 gets many repeated requests."""
    drafts = [(k, T0 + k * 6 * HOUR) for k in range(40)]
    requests = [(k, T0 + k * 6 * HOUR + (3 if k % 3 else 30) * HOUR) for k in range(40) if k % 5] + [
        (5, T0 + 30 * HOUR + 2 * HOUR) for _ in range(200)
    ]
    requests.sort(key=lambda r: r[1])
    for name, rows, column in (("drafts", drafts, "created_at"), ("requests", requests, "requested_at")):
        step = len(rows) // 3 + 1
        for part in range(3):
            spark.createDataFrame(rows[part * step:(part + 1) * step], f"k long, {column} timestamp").coalesce(1).write.mode(
                "append").parquet(str(tmp_path / f"{name}.parquet"))
    hits = {k for k, t in drafts if any(r == k and t <= at <= t + 24 * HOUR for r, at in requests)}
    return str(tmp_path), dict(drafts), hits, requests


def _streams(spark, root):
    return jobs.table_stream(spark, root, "drafts"), jobs.table_stream(spark, root, "requests")


def test_confirm_is_once_per_draft(spark, arrivals):
    root, _, hits, _ = arrivals
    out = jobs.drain(jobs.confirmed_drafts(*_streams(spark, root), "k"), "t").collect()
    assert sorted(r.k for r in out) == sorted(hits)


def test_expired_are_the_unconfirmed_ones_past_the_watermark(spark, arrivals):
    root, drafts, hits, requests = arrivals
    watermark = min(max(drafts.values()), max(at for _, at in requests)) - HOUR
    out = jobs.drain(jobs.expired_drafts(*_streams(spark, root), "k"), "t").collect()
    expected = {k for k, t in drafts.items() if k not in hits and t + 24 * HOUR <= watermark}
    assert {r.k for r in out} == expected and len(out) == len(expected)


def test_admission_in_batches(spark, sf_dir):
    from chartloom.operators.admission import admit
    from chartloom.sources.corpus import file_columns, table

    def rows(df):
        return sorted(map(tuple, df.collect()))

    stream = file_columns(jobs.table_stream(spark, sf_dir, "documents")).drop("content")
    assert rows(jobs.admitted_uploads(stream)) == rows(admit(file_columns(table(spark, sf_dir, "documents")).drop("content")))


@pytest.mark.parametrize("job", [jobs.confirmed_drafts, jobs.expired_drafts])
def test_no_row_waits_in_a_state_store(spark, arrivals, job):
    root, *_ = arrivals
    name = f"stateless-{uuid.uuid4().hex}"
    jobs.drain(job(*_streams(spark, root), "k"), name).collect()
    base = glob.glob(f"{shared_dir(spark).removeprefix('file:')}/streams/{name}-*")
    assert len(base) == 1 and not os.path.exists(f"{base[0]}/checkpoint/state")


def test_event_time_joins_over_several_batches(spark, arrivals):
    """In time order, one file of each side at a time: the same rows as in one batch, once each."""
    root, drafts, hits, requests = arrivals

    def pieces():
        return [jobs.table_stream(spark, root, name, maxFilesPerTrigger="1") for name in ("drafts", "requests")]

    done = [r.k for r in jobs.drain(jobs.confirmed_drafts(*pieces(), "k", delay="30 days"), "t").collect()]
    assert sorted(done) == sorted(hits)
    last = min(max(drafts.values()), max(at for _, at in requests))
    left = [r.k for r in jobs.drain(jobs.expired_drafts(*pieces(), "k", delay="5 days"), "t").collect()]
    assert sorted(left) == sorted(k for k, t in drafts.items() if k not in hits and t + 144 * HOUR <= last)
