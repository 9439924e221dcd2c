"""Admission of uploaded file sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.config import ALLOWED_TYPES, Limits

FAULTS = ("type", "size")


def file_fault(content_type: Column, size_bytes: Column, limits: Limits = Limits()) -> Column:
    """Reason a single file is refused, NULL when it is fine; the type is looked at first."""
    return F.when(~F.coalesce(content_type.isin(*ALLOWED_TYPES), F.lit(False)), FAULTS[0]).when(
        size_bytes > limits.max_file, FAULTS[1]
    )


def admit(
    files: DataFrame,
    limits: Limits = Limits(),
    intake: str = "intake_no",
    intakes: DataFrame | None = None,
) -> DataFrame:
    """One verdict per intake; the first refused file in upload order decides.

    Index and reason travel in one integer, so the aggregate keeps fixed-width
    buffers: it combines map-side by hashing, whatever the size of an intake.
    ``intakes`` lists announced sets and adds the ones that sent no file at all.
    """
    fault = file_fault(F.col("content_type"), F.col("size_bytes"), limits)
    code = F.when(fault == FAULTS[0], 0).when(fault == FAULTS[1], 1)
    body = F.col("size_bytes") + F.octet_length("filename") + F.octet_length("content_type")
    totals = files.groupBy(intake).agg(
        F.count("*").alias("n_files"),
        F.sum("size_bytes").cast("bigint").alias("total_bytes"),
        F.sum(body).cast("bigint").alias("_body"),
        F.min(F.col("file_index") * 2 + code).alias("_first"),
    )
    if intakes is not None:
        totals = intakes.select(intake).join(totals, intake, "left")
    return verdicts(totals, limits, intake)


def verdicts(totals: DataFrame, limits: Limits = Limits(), intake: str = "intake_no") -> DataFrame:
    """Verdict of each set from its n_files, total_bytes, _body and _first (2 x index + fault of the first refused file)."""
    first = F.col("_first")
    reason = (
        F.when(F.coalesce(F.col("n_files"), F.lit(0)) == 0, "no_files")
        .when(F.col("_body") > limits.max_body, "body")
        .when(first.isNotNull(), F.when(first % 2 == 0, FAULTS[0]).otherwise(FAULTS[1]))
        .when(F.col("total_bytes") > limits.max_set, "set")
    )
    return totals.select(
        intake,
        F.coalesce(F.col("n_files"), F.lit(0)).cast("bigint").alias("n_files"),
        F.coalesce(F.col("total_bytes"), F.lit(0)).cast("bigint").alias("total_bytes"),
        reason.alias("reason"),
        F.when(reason.isin(*FAULTS), F.floor(first / 2)).cast("bigint").alias("first_bad_index"),
        reason.isNull().alias("admitted"),
    )
