"""URL lists, registration and the pipeline's stages."""

import datetime as dt

import corpus_pipeline
from pyspark.sql import functions as F

from chartloom.llm import url_lists
from chartloom.llm.queries import QUERIES


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


CAPTURES = "url string, fetch_time timestamp, lists string"
ENTRIES = "list string, key string, action string, at timestamp"


def judged(spark, captures, entries):
    """Columns named like the verdict's give way to it; others stay."""
    urls = spark.createDataFrame([(*c, "x") for c in captures], CAPTURES).selectExpr("*", "true AS blocked", "'k' AS key", "7 AS row", "8 AS period", "9 AS _spread")
    rows = url_lists.judge_captures(urls, spark.createDataFrame(entries, ENTRIES)).collect()
    return sorted(((r["url"], r["fetch_time"], r["lists"]) for r in rows), key=lambda x: (x[0] or "", x[1] or day(0)))


def test_captures_meet_only_entries_active_at_fetch_time(spark):
    url = "http://a.bad.org/x/y"
    entries = [
        ("spam", "bad.org", "add", day(10)), ("spam", "bad.org", "remove", day(100)), ("spam", "bad.org", "add", day(200)),
        ("paths", "a.bad.org/x", "add", day(150)),
    ]
    got = judged(spark, [(url, day(n)) for n in (9, 10, 99, 100, 160, 250)], entries)
    assert [x[2] for x in got] == ["", "spam", "spam", "", "paths", "paths,spam"]


def test_a_far_fetch_time_does_not_multiply_the_list(spark):
    entries = spark.createDataFrame([("l", f"h{i % 50}.org", ("add", "remove")[i // 50 % 2], day(i)) for i in range(1000)], ENTRIES)
    captures = [(f"http://h{i % 60}.org/", day(i % 365)) for i in range(500)] + [("http://h1.org/", dt.datetime(9999, 1, 1))]
    urls = spark.createDataFrame(captures, "url string, fetch_time timestamp")
    asked = urls.select(url_lists._period(F.col("fetch_time")).alias("period"), F.explode(url_lists.keys_of(F.col("url"))).alias("key"))
    assert url_lists.active_cells(asked, entries).count() < 20_000
    rows = url_lists.judge_captures(urls.selectExpr("*", "1 AS key", "2 AS row", "3 AS _spread"), entries).collect()
    assert len(rows) == 501 and {(r["key"], r["row"], r["_spread"]) for r in rows} == {(1, 2, 3)}
    # The last entry of each host decides after the last day.
    gone = {i % 50: i // 50 % 2 for i in range(1000)}
    assert [r["blocked"] for r in rows if r["fetch_time"].year == 9999] == [gone[1] == 0]


def test_ties_nulls_and_repeats(spark):
    entries = [("l", "b.c", "add", day(1)), ("l", "b.c", "remove", day(1)), ("l", None, "add", day(1)), ("m", "d.e", "add", day(1)), ("m", "d.e", "add", day(2))]
    captures = [(None, day(5)), ("http://b.c/", None), ("http://b.c/", day(5)), ("no url", day(5)), ("HTTP://D.E", day(5)), ("HTTP://D.E", day(5))]
    got = judged(spark, captures, entries)
    assert len(got) == 6 and sorted(x[2] for x in got) == ["", "", "", "", "m", "m"]
    assert judged(spark, [], entries) == []
    assert [x[2] for x in judged(spark, captures[:1], [])] == [""]


def test_all_numbered_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
    assert set(QUERIES) <= set(names)


def test_stages_keep_the_columns_and_take_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"file://{tmp_path}/{number}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        counts.append(docs.count())
        if number < 4:
            assert docs.columns == columns
            assert docs.select("doc_id").distinct().count() == counts[-1]
    assert counts[0] > counts[1] > counts[2] >= counts[3] >= counts[4] > 0.6 * counts[0]
    assert docs.select("doc_id").distinct().count() == counts[4]


def test_stages_take_an_empty_table(spark, sf_dir):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
