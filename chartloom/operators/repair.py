"""Completeness test, repair-file selection and the null-filling merge."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom import config as c
from chartloom.functions.text import basename
from chartloom.functions.variants import as_map, at, fill_missing, is_number, is_object
from chartloom.operators.staging import evaluate_once, stage

PENTACAM = "exams.pentacam_corneal_tomography"


def _eye_shape() -> str:
    tree: dict = {}
    for path in (path for paths in c.REPAIR_PATHS.values() for path in paths):
        *parents, last = path.split(".")
        node = tree
        for name in parents:
            node = node.setdefault(name, {})
        node[last] = "variant"

    def ddl(node: dict | str) -> str:
        if isinstance(node, str):
            return node
        return "struct<" + ", ".join(f"`{k}`: {ddl(v)}" for k, v in node.items()) + ">"

    return ddl(tree)


def number_at_any(eye: Column, paths: tuple[str, ...]) -> Column:
    """True when at least one path below the eye holds a JSON number."""

    def leaf(path: str) -> Column:
        return reduce(lambda node, name: node.getField(name), path.split("."), eye)

    return reduce(or_, [is_number(leaf(path)) for path in paths])


def completeness(cases: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per case: which of the four metrics each eye lacks, and whether a repair pass is due.

    A case without the tomography exam never needs one.
    """
    eye = _eye_shape()
    eyes = ", ".join(f"{name}: {eye}" for name in c.EYES)
    staged = cases.select(
        "case_id", *keep, at(F.col("analysis"), PENTACAM, f"struct<eyes: struct<{eyes}>>").alias("_exam")
    )

    def present_flags(name: str) -> Column:
        return F.struct(*[
            number_at_any(F.col(f"_exam.eyes.{name}"), paths).alias(metric)
            for metric, paths in c.REPAIR_PATHS.items()
        ])

    flagged = staged.select(
        "case_id", *keep, F.col("_exam").isNotNull().alias("_has_exam"),
        *[present_flags(name).alias(f"_{name}") for name in c.EYES],
    )
    complete = {
        name: reduce(and_, [F.col(f"_{name}.{metric}") for metric in c.REPAIR_PATHS]) for name in c.EYES
    }
    missing = F.concat_ws(",", *[
        F.when(~F.col(f"_{name}.{metric}"), F.lit(f"{name}.{metric}"))
        for name in c.EYES for metric in c.REPAIR_PATHS
    ])
    return flagged.select(
        "case_id", *keep,
        *[complete[name].alias(f"{name.lower()}_complete") for name in c.EYES],
        missing.alias("missing_metrics"),
        (F.col("_has_exam") & ~reduce(and_, complete.values())).alias("needs_repair"),
    )


def repair_files(cases: DataFrame, files: DataFrame) -> DataFrame:
    """Uploaded files (case_id, file_index, filename, …) a repair pass has to look at again.

    Only incomplete cases, and only files the tomography exam names as source.
    """
    listed = cases.select(
        "case_id", "analysis", at(F.col("analysis"), f"{PENTACAM}.source", "array<string>").alias("_sources")
    )
    judged = completeness(listed, keep=("_sources",)).select("case_id", "_sources", "needs_repair")
    wanted = (
        evaluate_once(judged).where("needs_repair")
        .select("case_id", F.explode("_sources").alias("_source"))
        .select("case_id", basename(F.col("_source")).alias("filename"))
    )
    return files.join(wanted, ["case_id", "filename"], "left_semi")


def _with_member(holder: Column, key: str, value: Column) -> Column:
    return F.to_variant_object(
        F.map_zip_with(as_map(holder), F.create_map(F.lit(key), value), lambda _k, old, new: F.coalesce(new, old))
    )


def merged_document(analysis: Column, repair: Column) -> Column:
    """The analysis with missing values of each eye filled from a repair document.

    Eyes are never created: both documents must hold the eye as an object.
    """
    exams, exam = at(analysis, "exams"), at(analysis, PENTACAM)
    eyes = at(analysis, f"{PENTACAM}.eyes")

    def eye(name: str) -> Column:
        old, extra = at(analysis, f"{PENTACAM}.eyes.{name}"), at(repair, f"eyes.{name}")
        return F.when(is_object(old) & is_object(extra), fill_missing(old, extra))

    filled = F.create_map(*[part for name in c.EYES for part in (F.lit(name), eye(name))])
    merged = F.map_zip_with(as_map(eyes), filled, lambda _name, old, new: F.coalesce(new, old))
    kept = F.to_variant_object(F.map_filter(merged, lambda _name, value: value.isNotNull()))
    return F.when(
        is_object(eyes) & is_object(at(repair, "eyes")),
        _with_member(
            analysis, "exams",
            _with_member(exams, "pentacam_corneal_tomography", _with_member(exam, "eyes", kept)),
        ),
    ).otherwise(analysis)


def best_attempts(repairs: DataFrame, raw: str = "raw") -> DataFrame:
    """(case_id, _raw): of all attempts that decode to an object, the one with most repair metrics.

    Of equally good ones the latest by ``attempt``, if that column exists, then the largest text.
    """
    parsed = evaluate_once(repairs.select("*", F.try_parse_json(raw).alias("_parsed")))
    objects = parsed.where(is_object(F.col("_parsed")))
    eyes = ", ".join(f"{name}: {_eye_shape()}" for name in c.EYES)
    shaped = objects.withColumn("_eyes", at(F.col("_parsed"), "eyes", f"struct<{eyes}>"))
    found = reduce(lambda a, b: a + b, [
        F.coalesce(number_at_any(F.col(f"_eyes.{name}"), paths).cast("int"), F.lit(0))
        for name in c.EYES for paths in c.REPAIR_PATHS.values()
    ])
    latest = F.col("attempt") if "attempt" in repairs.columns else F.lit(0)
    order = F.struct(found.alias("found"), latest.alias("attempt"), F.col(raw).alias("text"))
    return shaped.groupBy("case_id").agg(F.max(order).alias("_best")).select("case_id", F.col("_best.text").alias("_raw"))


def apply_repairs(cases: DataFrame, repairs: DataFrame, raw: str = "raw") -> DataFrame:
    """Merge second-pass extractions into the cases that need them; everything else is untouched.

    ``repairs`` may hold several attempts per case; they are reduced to the best and written to the shared
    folder first, so a case with very many attempts costs one row and their size is known when the join is planned: a small table
    is broadcast within Spark's own limit, and a larger one makes the join a shuffle of both.  Documents are read, judged and merged in one
    pass.  An undecodable repair is ignored.
    """
    keep = tuple(name for name in cases.columns if name not in ("case_id", "analysis"))
    best = stage(best_attempts(repairs, raw), "repairs").select("case_id", F.try_parse_json("_raw").alias("_repair"))
    judged = evaluate_once(completeness(cases, keep=("analysis", *keep)))
    due = F.col("needs_repair") & F.col("_repair").isNotNull()
    return judged.join(best, "case_id", "left").select(
        "case_id", *keep, F.when(due, merged_document(F.col("analysis"), F.col("_repair"))).otherwise(F.col("analysis")).alias("analysis"),
    )


def fill_metrics(gold: DataFrame, repair_gold: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Typed variant of the merge: one row per (case, eye) on both sides, target first."""
    extra = repair_gold.select("case_id", "eye", *[F.col(m).alias(f"_r_{m}") for m in metrics])
    rest = [name for name in gold.columns if name not in metrics]
    return gold.join(extra, ["case_id", "eye"], "left").select(
        *rest, *[F.coalesce(F.col(m), F.col(f"_r_{m}")).alias(m) for m in metrics]
    )
