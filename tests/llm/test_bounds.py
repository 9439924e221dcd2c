"""What tasks and finished steps hold: batches on their way to Python, shuffle files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from chartloom.llm.common import BOUNDS_CONF, reachable, stage


def _sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])


def test_batches_are_bounded_by_bytes(spark):
    texts = reachable(spark).range(4000, numPartitions=1).select(F.repeat(F.lit("0123456789"), 500).alias("text"))
    found = texts.mapInArrow(_sizes, "n long, size long").agg(F.sum("n").alias("n"), F.max("size").alias("size")).first()
    assert found["n"] == 4000
    assert found["size"] < 5_000_000  # 20 MB before


def _shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum("shuffle_" in str(name) for name in manager.getAllFiles().mkString("\n").splitlines())


def test_a_stored_step_leaves_no_shuffle_files(spark):
    rows = reachable(spark).range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.sum("id").alias("total"))
    before = _shuffle_files(spark)
    stored = stage(rows, "sums")
    assert _shuffle_files(spark) <= before
    assert {(r["k"], r["total"]) for r in stored.collect()} == {(k, sum(range(k, 1000, 10))) for k in range(10)}


def test_options_of_the_caller_stay(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, "1m")
    assert reachable(spark).conf.get(key) == "1m"
    spark.conf.unset(key)
    assert reachable(spark).conf.get(key) == BOUNDS_CONF[key]
