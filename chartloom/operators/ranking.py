"""Order-dependent operators that never gather one group in one task.

Rows are cut into (group, range) cells whose size is set by the width of a cell, and
only one summary row per cell meets the other cells of its group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartloom.operators.staging import join_splittable


def position_in_group(
    rows: DataFrame, group: str, position: str, out: str, cell_bits: int = 16
) -> DataFrame:
    """Zero-based rank by an integer ``position`` that is unique within its group.

    A cell spans 2**cell_bits positions.
    """
    cells = rows.withColumn("_cell", F.shiftright(position, cell_bits))
    before = W.partitionBy(group).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        cells.groupBy(group, "_cell").agg(F.count("*").alias("_n"))
        .select(
            F.col(group).alias("_group"), F.col("_cell").alias("_in"),
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        )
    )
    inside = W.partitionBy(group, "_cell").orderBy(position)
    ranked = cells.withColumn("_rank", F.row_number().over(inside) - 1)
    # Null-safe, so that rows without a group keep their place too.
    same = F.col(group).eqNullSafe(F.col("_group")) & F.col("_cell").eqNullSafe(F.col("_in"))
    return (
        ranked.join(offsets, same)
        .withColumn(out, (F.col("_offset") + F.col("_rank")).cast("bigint"))
        .select(*rows.columns, out)
    )


def next_match(
    events: DataFrame,
    key: str,
    time_us: Column,
    is_start: Column,
    is_match: Column,
    out: str,
    cell_bits: int = 16,
) -> DataFrame:
    """Start rows with the time of the first matching row at or after them, NULL when none.

    ``time_us`` is an integer time in microseconds.  Rows of a key are first reduced to its distinct times.  Those are cut
    into cells of 2**cell_bits microseconds and the cells into coarser ones of 2**(2*cell_bits) (72 minutes by default), so
    no window sees more than 2**cell_bits rows, however many rows a key has within a cell; over the coarse cells of a key
    their number is that of the time range.  One row leaves per start row.  A row without a key matches nothing.
    """
    rows = events.select(
        "*", time_us.alias("_t"), F.when(is_match, time_us).alias("_m"), is_start.alias("_s"),
    )
    fine, coarse = F.shiftright("_t", cell_bits).alias("_fine"), F.shiftright("_t", 2 * cell_bits).alias("_coarse")
    times = (
        rows.where(F.col(key).isNotNull() & (F.col("_s") | F.col("_m").isNotNull()))
        .groupBy(F.col(key).alias("_key"), "_t").agg(F.min("_m").alias("_m"))
        .select("_key", "_t", fine, coarse, "_m")
    )
    # Descending order makes "from here on" a growing frame, which is linear to evaluate.
    here = W.partitionBy("_key", "_coarse", "_fine").orderBy(F.desc("_t")).rowsBetween(W.unboundedPreceding, 0)
    later = W.partitionBy("_key", "_coarse").orderBy(F.desc("_fine")).rowsBetween(W.unboundedPreceding, -1)
    beyond = W.partitionBy("_key").orderBy(F.desc("_coarse")).rowsBetween(W.unboundedPreceding, -1)
    cells = times.groupBy("_key", "_coarse", "_fine").agg(F.min("_m").alias("_first"))
    blocks = cells.groupBy("_key", "_coarse").agg(F.min("_first").alias("_first"))
    cells = cells.select("_key", "_coarse", "_fine", F.min("_first").over(later).alias("_later"))
    blocks = blocks.select("_key", "_coarse", F.min("_first").over(beyond).alias("_beyond"))
    found = (
        times.withColumn("_here", F.min("_m").over(here))
        .join(cells, ["_key", "_coarse", "_fine"], "left").join(blocks, ["_key", "_coarse"], "left")
        .select(F.col("_key").alias(key), "_t", F.coalesce("_here", "_later", "_beyond").alias(out))
    )
    return join_splittable(rows.where("_s"), found, [key, "_t"], "left").select(*events.columns, out)
