"""Hot groups and plan shape."""

import random

import pytest
from pyspark.sql import functions as F

from chartloom.operators.admission import admit
from chartloom.operators.ranking import next_match, position_in_group
from chartloom.plans import QUERIES


def test_position_in_a_hot_group(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), i * 3) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, pos long")
    got = {(r.g, r.pos): r.rank for r in position_in_group(df, "g", "pos", "rank", cell_bits=6).collect()}
    seen = {}
    for g, pos in rows:
        assert got[g, pos] == seen.get(g, 0)
        seen[g] = seen.get(g, 0) + 1


def test_next_match_with_a_hot_key(spark):
    rng = random.Random(11)
    rows = [(i, "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), rng.randrange(2000), rng.choice("smx")) for i in range(2500)]
    df = spark.createDataFrame(rows, "id long, k string, t long, kind string")
    got = next_match(df, "k", F.col("t"), F.col("kind") == "s", F.col("kind") == "m", "hit", cell_bits=6).collect()
    assert len(got) == sum(kind == "s" for *_, kind in rows)
    for r in got:
        later = [t for _, k, t, kind in rows if kind == "m" and k is not None and k == r.k and t >= r.t]
        assert r.hit == (min(later) if later else None)


def test_admission_combines_before_the_shuffle(spark):
    files = spark.range(1000).select(
        F.lit(1).alias("intake_no"), F.col("id").alias("file_index"), F.lit("a.pdf").alias("filename"),
        F.when(F.col("id") == 700, "text/plain").otherwise("application/pdf").alias("content_type"), F.lit(10).alias("size_bytes"),
    )
    verdict = admit(files)
    row = verdict.first()
    assert (row.reason, row.first_bad_index, row.n_files) == ("type", 700, 1000)
    plan = verdict._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("HashAggregate") >= 2


def test_admission_reasons(spark):
    rows = [
        (1, 0, "a.pdf", "application/pdf", 21 << 20), (1, 1, "b.txt", "text/plain", 1),
        (2, 0, "a.pdf", "application/pdf", 18 << 20), (2, 1, "b.pdf", "application/pdf", 17 << 20), (2, 2, "c.pdf", "application/pdf", 16 << 20),
        (3, 0, "a.pdf", "application/pdf", 30 << 20), (3, 1, "b.txt", "text/plain", 30 << 20),
        (4, 0, "a.pdf", "application/pdf", 20 << 20),
    ]
    files = spark.createDataFrame(rows, "intake_no int, file_index int, filename string, content_type string, size_bytes long")
    announced = spark.createDataFrame([(i,) for i in range(1, 6)], "intake_no int")
    got = {r.intake_no: r for r in admit(files, intakes=announced).collect()}
    assert [got[i].reason for i in range(1, 6)] == ["size", "set", "body", None, "no_files"]
    assert got[1].first_bad_index == 0 and got[4].admitted


def test_hot_file_name_is_split_by_adaptive_execution(spark):
    from chartloom.operators.lineage import attach_sources

    hot = spark.range(60_000).select(
        F.lit(1).alias("intake_no"), F.col("id").alias("file_index"),
        F.when(F.col("id") % 3 < 2, "hot.pdf").otherwise(F.concat(F.lit("f"), F.col("id"))).alias("filename"),
        F.sha2(F.col("id").cast("string"), 256).alias("sha256"),
    )
    sources = spark.createDataFrame([(1, 0, "x/hot.pdf", None, "E"), (1, 1, None, "hot.pdf", "L")],
                                    "intake_no int, source_pos int, path string, filename string, exam string")
    saved = {k: spark.conf.get(k, None) for k in (
        "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for k, value in zip(saved, ("-1", "64k", "64k", "-1")):
        spark.conf.set(k, value)
    try:
        joined = attach_sources(hot.repartition(16), sources, ("exam",))
        assert joined.groupBy("exam").count().orderBy("exam").collect()[-1][:] == ("E", 40_000)
        total = joined.select(F.sum(F.hash("sha256", "exam")))
        total.collect()
        assert "skew=true" in total._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, value in saved.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)


BATCH = sorted(name for name in QUERIES if not name.startswith("stream_") and not name.endswith("_roundtrip"))


@pytest.mark.parametrize("name", BATCH)
def test_plan_stays_inside_spark_operators(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "PythonUDF", "InPandas", "CollectLimit"):
        assert bad not in plan


@pytest.mark.parametrize("name", ["eye_gold", "needs_repair", "measurements_long", "exam_summary", "patient_header", "report_metrics"])
def test_document_is_parsed_once_without_data_shuffles(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("VariantExpressionEvalUtils.parseJson(CASE") == 1
    # The only exchange spreads narrow input rows over the cores of a small session.
    assert plan.count("Exchange") == plan.count("Exchange RoundRobinPartitioning")


def test_stages_too_large_to_compile_are_not_fused(spark, sf_dir):
    # Above 8,000 bytes the JVM interprets a method; Spark's own limit of 65,535 lets such stages through.
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    rows = QUERIES["eye_gold"](spark, sf_dir)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    assert rows.count() == 2 * spark.read.parquet(f"{sf_dir}/orders.parquet").count()
