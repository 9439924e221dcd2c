"""Envelope contract of an extracted document, checked row by row without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom import config as c
from chartloom.functions.variants import as_list, as_map, at, is_array, is_object, is_string, strict_root

TEXT_FIELDS = ("schema_version", "generated_on", "language")
OBJECT_FIELDS = ("patient", "facility", "conventions", "extraction_notes")
OTHER_FIELDS = ("source_files", "exams")


def _blank(value: Column) -> Column:
    """Absent or JSON null."""
    return value.isNull() | F.is_variant_null(value)


def _official(key: Column) -> Column:
    return key.isin(*c.EXAM_KEYS)


def _exam_fault(entry: Column) -> Column:
    payload = entry["value"]
    sources = as_list(at(payload, "source"))
    readable = F.forall(sources, lambda s: F.is_variant_null(s) | is_string(s))
    return (
        F.when(~_official(entry["key"]), "unknown_key")
        .when(~is_object(payload), "exam")
        .when(~F.coalesce(readable, F.lit(False)), "source")
    )


def check_contract(documents: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``is_valid``, the first failing ``reason``, its exam key and all unknown keys.

    Several failing exam keys are reported by the smallest one, so that a rerun
    names the same key.  Envelope keys match exactly, including their case.
    """
    kept = [name for name in documents.columns if name != raw]
    fields = ", ".join(f"{name}: variant" for name in (*TEXT_FIELDS, *OBJECT_FIELDS, *OTHER_FIELDS))
    parsed = documents.select(*kept, strict_root(F.col(raw)).alias("_root"))
    opened = parsed.select(
        *kept,
        F.coalesce(F.is_variant_null("_root") & F.col("_root").isNotNull(), F.lit(False)).alias("_null_root"),
        F.try_variant_get("_root", "$", f"struct<{fields}>").alias("_doc"),
    )
    doc = {name: F.col(f"_doc.{name}") for name in (*TEXT_FIELDS, *OBJECT_FIELDS, *OTHER_FIELDS)}
    typed = F.col("_doc").isNotNull()
    for name in TEXT_FIELDS:
        typed = typed & (_blank(doc[name]) | is_string(doc[name]))
    for name in (*OBJECT_FIELDS, "exams"):
        typed = typed & (_blank(doc[name]) | is_object(doc[name]))
    listed = F.forall(as_list(doc["source_files"]), lambda item: F.is_variant_null(item) | is_object(item))
    typed = typed & (_blank(doc["source_files"]) | F.coalesce(listed, F.lit(False)))
    staged = opened.select(
        *kept, "_null_root", typed.alias("_typed"),
        (~_blank(doc["patient"])).alias("_has_patient"),
        as_map(doc["exams"]).alias("_exams"),
    )
    faults = F.filter(
        F.transform(
            F.map_entries("_exams"),
            lambda e: F.struct(e["key"].alias("key"), _exam_fault(e).alias("reason")),
        ),
        lambda f: f["reason"].isNotNull(),
    )
    judged = staged.select(
        *kept, "_null_root", "_typed", "_has_patient", F.col("_exams").isNotNull().alias("_has_exams"),
        F.array_min(faults).alias("_fault"),
        F.array_except(
            F.map_keys("_exams"), F.array(*[F.lit(k) for k in c.EXAM_KEYS])
        ).alias("_unknown"),
    )
    reason = (
        F.when(F.col("_null_root"), "patient")
        .when(~F.col("_typed"), "json")
        .when(~F.col("_has_patient"), "patient")
        .when(~F.col("_has_exams"), "exams")
        .otherwise(F.col("_fault.reason"))
    )
    return judged.select("*", reason.alias("reason")).select(
        *kept,
        F.col("reason").isNull().alias("is_valid"),
        "reason",
        F.when(F.col("reason").isin("unknown_key", "exam", "source"), F.col("_fault.key")).alias("offending_key"),
        F.when(F.col("_typed"), F.array_join(F.array_sort("_unknown"), ",")).alias("unknown_keys"),
    )


def is_preview(value: Column) -> Column:
    """Shape test of an intake preview: id text, file list, analysis object or list, message text."""
    analysis = at(value, "analysis")
    return F.coalesce(
        is_object(value)
        & is_string(at(value, "intakeId"))
        & is_array(at(value, "files"))
        & (is_object(analysis) | is_array(analysis))
        & is_string(at(value, "message")),
        F.lit(False),
    )
