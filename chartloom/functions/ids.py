"""Identifiers and storage keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartloom.functions.text import basename, drop_prefix

# Fixed shapes: prefix, compact UTC time (a fraction is tolerated), 8 hex digits.
INTAKE_SHAPE = r"^intake-\d{8}T\d{6}([.,]\d+)?Z-[0-9A-Fa-f]{8}$"
COMPACT_TIME = "yyyyMMdd'T'HHmmss'Z'"


def parse_compact_time(value: Column) -> Column:
    """Calendar timestamp of the compact form, NULL when it does not exist."""
    whole = F.concat(F.left(value, F.lit(15)), F.lit("Z"))
    return F.try_to_timestamp(whole, F.lit(COMPACT_TIME))


def intake_time(intake_id: Column) -> Column:
    return parse_compact_time(drop_prefix(intake_id, "intake-"))


def valid_intake_id(intake_id: Column) -> Column:
    return F.coalesce(
        intake_id.rlike(INTAKE_SHAPE) & intake_time(intake_id).isNotNull(), F.lit(False)
    )


def valid_case_id(case_id: Column) -> Column:
    swapped = F.concat(F.lit("intake-"), drop_prefix(case_id, "case-"))
    return F.coalesce(case_id.startswith("case-") & valid_intake_id(swapped), F.lit(False))


def case_id_of(intake_id: Column) -> Column:
    return F.concat(F.lit("case-"), drop_prefix(intake_id, "intake-"))


def created_date_of(case_id: Column) -> Column:
    """Partition date carried by a case or intake id, so no scan is needed to find it."""
    day = F.split_part(case_id, F.lit("-"), F.lit(2)).substr(1, 8)
    return F.try_to_timestamp(day, F.lit("yyyyMMdd")).cast("date")


def case_key(case_id: Column, stored_name: Column) -> Column:
    return F.concat(F.lit("cases/"), case_id, F.lit("/"), stored_name)


def promoted_key(case_id: Column, key: Column) -> Column:
    return case_key(case_id, basename(key))


def owned_by_case(case_id: Column, path: Column) -> Column:
    return path.startswith(F.concat(F.lit("cases/"), case_id, F.lit("/")))
