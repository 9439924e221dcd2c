"""Work folder, staged tables and Arrow helpers of the operators in this package."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.session import shared_dir

#: Documents are handled in groups of about so many bytes, which bounds the arrays of a task.
CHUNK_BYTES = 1 << 20

#: Options that bound what a task and a finished step hold, set where the caller has set none.  Results do not depend on them.
BOUNDS_CONF = {
    # A batch on its way to Python is held outside the heap, and again in the worker, for every task at work.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    # A step's shuffle files go when the step ends: its rows are stored or with the driver by then.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers started on this machine import the package from where the driver has it, and bound batches and shuffle files.

    On a cluster the package is installed on the executors.
    """
    for key, value in BOUNDS_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def stage(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it again, so that a lost executor costs no recomputation."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it while a column has it, so that no caller's column is overwritten."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(column: str, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds``; a row without id falls into fold 1 (it is never held out)."""
    text = F.col(column).cast("string")
    return F.coalesce(F.pmod(F.crc32(text.cast("binary")), F.lit(folds)), F.lit(1)).cast("int")


def text_groups(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Row offset and UTF-8 bytes of consecutive documents, about ``limit`` bytes at a time.  Null is empty."""
    values = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    size = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(size):
        done = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, done + limit, "right")))
        yield begin, [t or b"" for t in values.slice(begin, end - begin).to_pylist()]
        begin = end
