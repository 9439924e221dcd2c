"""Plan staging helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.session import shared_dir


def stage(rows: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: nothing is computed anew after a loss, and its size is known."""
    path = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def evaluate_once(rows: DataFrame) -> DataFrame:
    """Pass rows through a one-element generator before a filter on computed columns.

    A filter on a computed column is normally pushed below the projection by
    copying the expression, which would parse or walk a document twice.  Output
    of a generator stays where it is.
    """
    return rows.select(F.inline(F.array(F.struct(*[F.col(f"`{name}`") for name in rows.columns]))))


def join_splittable(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join whose hot keys on the left can be split at run time.

    Adaptive execution splits a skewed partition only between two shuffles of the
    join itself.  When ``right`` was just grouped by the same keys, its grouping
    shuffle would be reused and the join could not be split.  One more derived key
    gives the (already reduced) right side a shuffle of its own.
    """
    spread = F.xxhash64(*keys)
    joined = left.withColumn("_spread", spread).join(right.withColumn("_spread", spread), [*keys, "_spread"], how)
    return joined.drop("_spread")
