"""Decision-support rules.  Every rule has an explicit missing state.

Columns named ``reference_*`` keep the two-valued reading, in which a missing
measurement falls to the negative branch; the plain columns are the safe ones.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom import config as c
from chartloom.functions.text import eye_label, pt_number

MISSING = "missing"


def toric_flags(gold: DataFrame, thresholds: c.Thresholds = c.Thresholds()) -> DataFrame:
    size = F.abs("astigmatism_d")
    hit = size >= thresholds.toric_min_d
    return gold.select(
        "case_id", "eye", size.alias("astigmatism"),
        F.coalesce(hit, F.lit(False)).alias("is_toric"),
        F.when(hit, c.TORIC).otherwise(c.NON_TORIC).alias("reference_label"),
        F.when(size.isNull(), MISSING).when(hit, c.TORIC).otherwise(c.NON_TORIC).alias("label"),
        F.when(hit, c.TORIC_WORD).otherwise(c.NON_TORIC_WORD).alias("word"),
    )


def endothelium_flags(gold: DataFrame, thresholds: c.Thresholds = c.Thresholds()) -> DataFrame:
    density = F.col("cell_density_cells_per_mm2")
    below = density < thresholds.endothelial_cutoff
    return gold.select(
        "case_id", "eye", density.alias("density"),
        F.coalesce(below, F.lit(False)).alias("below_cutoff"),
        F.when(below, c.BELOW_CUTOFF).otherwise(c.ABOVE_CUTOFF).alias("reference_label"),
        F.when(density.isNull(), MISSING).when(below, c.BELOW_CUTOFF).otherwise(c.ABOVE_CUTOFF).alias("label"),
    )


def branch_grid(gold: DataFrame, thresholds: c.Thresholds = c.Thresholds()) -> DataFrame:
    """Both branches of the cell-density question for every eye, the taken one marked."""
    flags = endothelium_flags(gold, thresholds)
    branch = F.col("branch")
    chosen = branch == F.col("below_cutoff")
    return flags.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("branch")).select(
        "case_id", "eye", "branch",
        F.concat(eye_label(F.col("eye")), F.lit(" · "), F.when(branch, "Sim").otherwise("Não")).alias("title"),
        chosen.alias("selected"),
        F.when(chosen, c.BRANCH_CHOSEN).otherwise(c.BRANCH_NOT_CHOSEN).alias("badge"),
        F.when(~chosen, "neutral").when(branch, "warning").otherwise("success").alias("tone"),
        F.concat(pt_number(F.col("density")), F.lit(" células/mm²")).alias("density_text"),
        F.when(branch, c.BELOW_CUTOFF).otherwise(c.ABOVE_CUTOFF).alias("consequence"),
    )


def age_years(birth: Column, as_of: dt.date) -> Column:
    """Completed years on a fixed day."""
    had_birthday = F.month(birth) * 100 + F.dayofmonth(birth) <= as_of.month * 100 + as_of.day
    return F.lit(as_of.year) - F.year(birth) - F.when(had_birthday, 0).otherwise(1)


def age_cohort(age: Column, thresholds: c.Thresholds = c.Thresholds()) -> Column:
    return (
        F.when(age.isNull(), MISSING)
        .when(age < thresholds.age_young_below, "A")
        .when(age <= thresholds.age_senior_above, "B")
        .otherwise("C")
    )


def keratoconus_gate(tkc: Column) -> Column:
    """Informative only: a non-blank grade counts as positive."""
    return F.coalesce(tkc != "", F.lit(False))


def altered_tissue_percent(flap: Column, ablation: Column, pachymetry: Column) -> Column:
    return F.try_divide((flap + ablation) * F.lit(100.0), pachymetry)


def residual_bed(flap: Column, ablation: Column, pachymetry: Column) -> Column:
    return pachymetry - flap - ablation


def final_curvature(before: Column, change: Column) -> Column:
    return before - change


def conclusion_level(*required: Column) -> Column:
    """Partial as soon as one required metric is missing."""
    gap = F.lit(False)
    for value in required:
        gap = gap | value.isNull()
    return F.when(gap, "partial").otherwise("complete")


def reasons(gold: DataFrame, thresholds: c.Thresholds = c.Thresholds()) -> DataFrame:
    """Reason list of each eye, in fixed order, joined to one text."""
    found = F.array_compact(F.array(
        F.when(F.abs("astigmatism_d") > thresholds.astigmatism_reason_d, "Astigmatismo corneano acima de 1,00 D"),
        F.when(F.col("art_max").isNull(), "ARTmax não identificado"),
        F.when(F.col("kmax_d").isNull(), "Kmax não identificado"),
    ))
    return gold.select(
        "case_id", "eye", F.size(found).cast("bigint").alias("n_reasons"),
        F.array_join(found, "; ").alias("reasons"),
        conclusion_level(F.col("art_max"), F.col("kmax_d")).alias("conclusion"),
        keratoconus_gate(F.col("tkc")).alias("tkc_positive"),
    )


def acd_consistent(external_mm: Column, internal_mm: Column, pachymetry_um: Column, tolerance_um: float) -> Column:
    """External minus internal chamber depth should equal the corneal thickness."""
    return F.abs((external_mm - internal_mm) * F.lit(1000.0) - pachymetry_um) <= tolerance_um


def identity_conflicts(identities: DataFrame, group: str = "case_id") -> DataFrame:
    """Do all documents of a case name the same person?

    More than one distinct value is the same as minimum and maximum differing, so
    one map-side-combined pass is enough however many documents a case has.
    """
    checks = identities.groupBy(group).agg(
        F.count("*").alias("n_documents"),
        (F.min("name") != F.max("name")).alias("name_conflict"),
        (F.min("birth_date") != F.max("birth_date")).alias("birth_conflict"),
    )
    return checks.select(
        "*",
        F.when(
            F.coalesce(F.col("name_conflict") | F.col("birth_conflict"), F.lit(False)), c.REPORT_BLOCKED
        ).otherwise(c.REPORT_DONE).alias("report"),
    )
