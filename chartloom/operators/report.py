"""Report tables over normalized eyes and compiled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom import config as c
from chartloom.functions.text import (
    capitalize_first, eye_label, file_kind, humanize_key, join_filled, last_segment, leading_number, percent,
    pt_number,
)
from chartloom.functions.variants import OBJECT_MAP, as_list, as_map, at, first_present, text
from chartloom.operators.normalize import shape_of
from chartloom.operators.staging import evaluate_once


def _count(items: Column) -> Column:
    """Length of an array, zero for a missing one."""
    return F.when(items.isNotNull(), F.size(items)).otherwise(0).cast("bigint")


def exam_label(key: Column) -> Column:
    """Label of an exam key, or the key in words; four fixed labels live in the plan as a literal map."""
    labels = F.create_map(*[F.lit(x) for pair in c.EXAM_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, key), humanize_key(key))


def birth_date(patient: Column) -> Column:
    """Unified birth date: plain text, or the normalized member of an object."""
    value = at(patient, "birth_date")
    return F.when(
        at(value, "normalized").isNotNull(),
        F.coalesce(at(value, "normalized", "string"), F.lit(c.VALUE_MISSING)),
    ).otherwise(F.coalesce(text(value), F.lit(c.VALUE_MISSING)))


def patient_name(patient: Column, fallback: str = c.PATIENT_MISSING) -> Column:
    """Full name; an empty name counts as missing too."""
    name = at(patient, "full_name", "string")
    return F.coalesce(F.when(name != "", name), F.lit(fallback))


def patients(cases: DataFrame) -> DataFrame:
    """Patient header of each case: name, birth date, warning text when it really is text."""
    patient = F.col("_patient")
    return cases.select(
        "case_id", at(F.col("analysis"), "patient").alias("_patient"),
        text(at(F.col("analysis"), "extraction_notes.clinical_use_warning")).alias("warning"),
    ).select(
        "case_id", patient_name(patient).alias("patient_name"), birth_date(patient).alias("birth_date"), "warning"
    )


def with_birth_date(cases: DataFrame) -> DataFrame:
    """Cases whose document carries the unified birth date as plain text."""
    doc = F.col("analysis")
    unified = birth_date(at(doc, "patient"))
    as_json = F.parse_json(F.to_json(F.create_map(F.lit("v"), unified)))
    base = F.coalesce(as_map(at(doc, "patient")), F.expr("cast(map() as map<string,variant>)"))
    patient = F.to_variant_object(F.map_zip_with(
        base, F.create_map(F.lit("birth_date"), at(as_json, "v")), lambda _k, old, new: F.coalesce(new, old)
    ))
    updated = F.to_variant_object(F.map_zip_with(
        as_map(doc), F.create_map(F.lit("patient"), patient), lambda _k, old, new: F.coalesce(new, old)
    ))
    return cases.withColumn("analysis", updated)


def measurements(gold: DataFrame) -> DataFrame:
    """Twelve lineage rows per case: six metrics of each eye, unpivoted row by row.

    ``kind`` and ``confidence`` are the reported constants; the checked pair next
    to them tells a missing value apart.
    """
    label = eye_label(F.col("eye"))
    pentacam = F.concat(F.lit("Pentacam "), label)
    document = F.coalesce(last_segment(F.col("source_file")), pentacam)
    rows = []
    for position, (metric, name, full_name, unit, screen, field) in enumerate(c.METRIC_CATALOG):
        source, origin, shown_eye = pentacam, document, label
        if metric == "cell_density_cells_per_mm2":
            source = F.concat(F.lit("Microscopia especular "), label)
            origin = F.coalesce(last_segment(F.col("microscopy_file")), pentacam)
        elif metric == "axial_length_mm":
            source = F.concat(F.lit("Biometria "), label)
            origin, shown_eye = F.lit(c.AXIAL_LENGTH_DOCUMENT), F.col("eye")
        rows.append(F.struct(
            F.lit(position).cast("bigint").alias("position"), F.lit(metric).alias("metric"),
            F.concat(F.lit(name + " · "), shown_eye).alias("name"),
            F.lit(full_name).cast("string").alias("full_name"), F.col(metric).alias("value"),
            F.lit(unit).cast("string").alias("unit"), source.alias("source"), origin.alias("document"),
            F.lit(screen).alias("screen"), F.lit(field).alias("field"),
        ))
    missing = F.col("value").isNull()
    return gold.select("case_id", "eye", F.inline(F.array(*rows))).select(
        "*",
        pt_number(F.col("value")).alias("value_text"),
        F.lit(c.KIND_RAW).alias("kind"), F.lit(c.CONFIDENT).alias("confidence"),
        F.when(missing, c.KIND_MISSING).otherwise(c.KIND_RAW).alias("kind_checked"),
        F.when(missing, c.SUSPECT).otherwise(c.CONFIDENT).alias("confidence_checked"),
    )


def consistent_counts(gold: DataFrame) -> DataFrame:
    """Values of a case, those reported as sure and those that are really there.

    Every value of ``measurements`` carries the reported constant, and only a present one the checked mark, so each eye row
    is reduced to one number before the shuffle and nothing is unpivoted.
    """
    present = sum((F.col(row[0]).isNotNull().cast("bigint") for row in c.METRIC_CATALOG[1:]), F.col(c.METRIC_CATALOG[0][0]).isNotNull().cast("bigint"))
    totals = gold.select("case_id", present.alias("_present")).groupBy("case_id").agg(
        (F.count("*") * len(c.METRIC_CATALOG)).alias("n_data"), F.sum("_present").alias("consistent_checked")
    )
    return totals.select("case_id", "n_data", F.col("n_data").alias("consistent"), "consistent_checked")


def document_reviews(entries: DataFrame) -> DataFrame:
    """Review row of each source file: display name, file name, status, detail."""
    exam, eye = F.col("exam"), F.col("eye")
    pages = F.coalesce(
        F.array_join(at(F.col("pages"), "", "array<string>"), ","), F.try_variant_get("pages", "$", "string"), F.lit("?")
    )
    shown_eye = F.when(eye != "", F.concat(F.lit(" · "), eye_label(eye))).otherwise("")
    return entries.select(
        "case_id", "index",
        F.when(exam != "", F.concat(capitalize_first(exam), F.coalesce(shown_eye, F.lit(""))))
        .otherwise("Documento").alias("name"),
        last_segment(F.col("path")).alias("filename"),
        F.lit(c.STATUS_PROCESSED).alias("status"),
        F.concat(
            F.when(F.col("type") == "application/pdf", F.concat(pages, F.lit(" páginas"))).otherwise("Imagem"),
            F.lit(" disponível no caso."),
        ).alias("detail"),
    )


def file_summaries(entries: DataFrame) -> DataFrame:
    """Exam · eye · page count of each source; pages count only when they are a list."""
    pages = F.size(as_list(F.col("pages")))
    name = F.coalesce(
        F.col("path"), F.col("filename"), F.concat(F.lit("Arquivo "), (F.col("index") + 1).cast("string"))
    )
    line = join_filled(
        " · ", F.col("exam"), F.col("eye"), F.when(pages > 0, F.concat(pages.cast("string"), F.lit(" páginas")))
    )
    return entries.select(
        "case_id", "index", name.alias("file_name"), file_kind(name).alias("icon"),
        F.when(pages >= 0, pages).cast("bigint").alias("n_pages"),
        F.when(line == "", c.FILE_SUMMARY_FALLBACK).otherwise(line).alias("summary"),
    )


def received(reviews: DataFrame, group: str = "case_id") -> DataFrame:
    """Received-of-total per group, with the tone of the badge."""
    totals = reviews.groupBy(group).agg(
        F.count_if(F.col("status") != c.STATUS_NOT_SENT).alias("received"), F.count("*").alias("total")
    )
    return totals.withColumn(
        "tone", F.when(F.col("received") == F.col("total"), "success").otherwise("warning")
    )


def find_first(rows: DataFrame, group: str, key: str, value: str, order: str) -> DataFrame:
    """First row of each group whose key equals the value."""
    rest = [name for name in rows.columns if name != group]
    hit = rows.where(F.col(key) == value).groupBy(group).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return hit.select(group, *[F.col(f"_row.{name}").alias(name) for name in rest])


def exam_summaries(cases: DataFrame) -> DataFrame:
    """One row per exam of a case: label, eyes present, source list.  Row-local."""
    exams = as_map(at(F.col("analysis"), "exams"))
    listed = evaluate_once(cases.select("case_id", exams.alias("_exams")))
    entry = listed.select("case_id", F.explode("_exams").alias("exam_key", "_exam"))
    sources = at(F.col("_exam"), "source", "array<string>")
    return entry.select(
        "case_id", "exam_key", exam_label(F.col("exam_key")).alias("label"),
        F.array_join(F.array_sort(F.map_keys(as_map(at(F.col("_exam"), "eyes")))), ", ").alias("eyes"),
        F.when(F.size(sources) > 0, F.array_join(sources, ", ")).alias("sources"),
    )


def case_counts(cases: DataFrame) -> DataFrame:
    """Exam types and listed files of each case."""
    doc = F.col("analysis")
    return cases.select(
        "case_id",
        _count(F.map_keys(as_map(at(doc, "exams")))).alias("n_exams"),
        _count(as_list(at(doc, "source_files"))).alias("n_files"),
    )


def conventions(cases: DataFrame) -> DataFrame:
    """Key/value rows of the conventions object."""
    members = as_map(at(F.col("analysis"), "conventions"))
    listed = evaluate_once(cases.select("case_id", members.alias("_m")))
    return listed.select("case_id", F.explode("_m").alias("key", "_value")).select("case_id", "key", F.coalesce(F.try_variant_get("_value", "$", "string"), F.lit("null")).alias("value"))


def metric_cards(cases: DataFrame) -> DataFrame:
    """Four summary cards per case, straight from the document."""
    doc = F.col("analysis")
    eye_quality = {
        eye: F.coalesce(
            F.try_variant_get(first_present(
                at(doc, f"exams.pentacam_corneal_tomography.eyes.{eye}.quality"),
                at(doc, f"exams.pentacam_corneal_tomography.eyes.{eye}.general.quality"),
            ), "$", "string"),
            F.lit(c.QUALITY_MISSING),
        )
        for eye in c.EYES
    }
    n_files = _count(as_list(at(doc, "source_files")))
    values = [
        n_files.cast("string"),
        F.lit(str(len(c.EYES) * len(c.METRIC_CATALOG))),
        F.concat(eye_quality["OD"], F.lit(" / "), eye_quality["OS"]),
        F.lit(c.CONSOLIDATION_VALUE),
    ]
    cards = F.array(*[
        F.struct(
            F.lit(i).cast("bigint").alias("position"), F.lit(label).alias("label"), value.alias("value"),
            F.lit(detail).alias("detail"), F.lit("success").alias("tone"),
        )
        for i, ((label, detail), value) in enumerate(zip(c.METRIC_CARDS, values))
    ])
    return cases.select("case_id", F.inline(cards))


def metric_progress(gold: DataFrame) -> DataFrame:
    """Progress of every metric and eye; metrics are counted side by side, so only one row per eye is unpivoted."""
    metrics = [row[0] for row in c.METRIC_CATALOG]
    totals = gold.groupBy("eye").agg(F.count("*").alias("_total"), *[F.count(name).alias(name) for name in metrics])
    rows = totals.select("eye", "_total", F.inline(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.col(name).alias("completed")) for name in metrics
    ])))
    return rows.select(
        "metric", "eye", "completed", (F.col("_total") - F.col("completed")).alias("pending"),
        percent(F.col("completed"), F.col("_total")).alias("percentage"),
    )


def case_progress(gold: DataFrame) -> DataFrame:
    """Progress over all metrics of a case; each eye row is reduced to two numbers before the shuffle."""
    done = sum((F.col(row[0]).isNotNull().cast("bigint") for row in c.METRIC_CATALOG[1:]), F.col(c.METRIC_CATALOG[0][0]).isNotNull().cast("bigint"))
    totals = gold.select("case_id", done.alias("_done")).groupBy("case_id").agg(
        F.sum("_done").alias("completed"), (F.count("*") * len(c.METRIC_CATALOG)).alias("_total")
    )
    return totals.select(
        "case_id", "completed", (F.col("_total") - F.col("completed")).alias("pending"),
        percent(F.col("completed"), F.col("_total")).alias("percentage"),
    )


def eyes_side_by_side(gold: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Eye rows to OD/OS columns; the two eyes are fixed, so no pass is spent on finding them."""
    picks = [
        F.max(F.when(F.col("eye") == eye, F.col(name))).alias(f"{name}_{eye.lower()}")
        for name in columns for eye in c.EYES
    ]
    return gold.groupBy("case_id").agg(*picks)


def renested_document(analysis: Column) -> Column:
    """The document with normalized eyes written back under all three exams.

    Unknown members of an eye survive.  A value that has no source is null.
    """
    empty = F.expr("cast(map() as map<string,variant>)")

    def overlay(members: Column, extra: dict[str, Column]) -> Column:
        pairs = F.create_map(*[x for k, v in extra.items() for x in (F.lit(k), F.coalesce(v, F.parse_json(F.lit("null"))))])
        return F.to_variant_object(F.map_zip_with(
            F.coalesce(members, empty), pairs, lambda _k, old, new: F.coalesce(new, old)
        ))

    def pick(shapes: Column, specs: tuple[str, ...]) -> Column:
        return first_present(*[field(shapes, spec) for spec in specs])

    def field(shapes: Column, spec: str) -> Column:
        holder, path = spec.split(":")
        value = shapes[f"_{holder}"]
        for name in path.split("."):
            value = value.getField(name)
        return value

    def shape(name: str, value: Column) -> Column:
        """All configured paths of an object from one walk; a path taken by itself is walked again for each test of its value."""
        return F.try_variant_get(value, "$", shape_of(name)).alias(f"_{name}")

    def as_variant(value: Column) -> Column:
        return at(F.parse_json(F.to_json(F.create_map(F.lit("v"), value))), "v")

    def members_at(value: Column, path: str) -> Column:
        """Members of the object at a path, taken out of the document once: an object on the way would be copied whole."""
        return at(value, path, OBJECT_MAP)

    def found(index: int, eye: str) -> Column:
        return F.struct(
            at(analysis, f"exams.pentacam_corneal_tomography.eyes.{eye}").alias("cornea"),
            first_present(
                at(analysis, f"exams.iol_calculation.eyes.{eye}"), at(analysis, f"exams.iol_calculation.eyes.AO.{eye}")
            ).alias("biometry"),
            at(analysis, f"exams.specular_microscopy.eyes.{eye}").alias("endothelium"),
            at(analysis, f"exams.pentacam_corneal_tomography.source[{index}]").alias("source_file"),
        )

    holders = ("cornea", "biometry", "endothelium")

    def with_shapes(h: Column) -> Column:
        return F.struct(*[h[name].alias(name) for name in (*holders, "source_file")], *[shape(name, h[name]) for name in holders])

    def with_objects(h: Column) -> Column:
        chosen = {name: pick(h, specs) for name, specs in c.NORMALIZE_OBJECTS.items()}
        return F.struct(
            *[h[name].alias(name) for name in (*holders, "source_file", *[f"_{name}" for name in holders])],
            *[value.alias(name) for name, value in chosen.items()],
        )

    def with_object_shapes(h: Column) -> Column:
        return F.struct(
            *[h[name].alias(name) for name in (*holders, "source_file", *[f"_{name}" for name in holders], *c.NORMALIZE_OBJECTS)],
            *[shape(name, h[name]) for name in c.NORMALIZE_OBJECTS],
        )

    def with_other_eyes(h: Column) -> Column:
        biometry = h["biometry"]
        astigmatism = F.coalesce(
            pick(h, c.ASTIGMATISM_PATHS),
            as_variant(leading_number(F.try_variant_get(field(h, c.ASTIGMATISM_TEXT_PATH), "$", "string"))),
        )
        new_biometry = overlay(as_map(biometry), {
            "axial_length_mm": pick(h, c.NORMALIZE_NUMBERS["axial_length_mm"]),
            "keratometry": overlay(members_at(biometry, "keratometry"), {"astigmatism_d": astigmatism}),
        })
        new_endothelium = overlay(as_map(h["endothelium"]), {
            "cell_density_cells_per_mm2": pick(h, c.NORMALIZE_NUMBERS["cell_density_cells_per_mm2"])
        })
        return F.struct(h.alias("h"), new_biometry.alias("iol"), new_endothelium.alias("microscopy"))

    def rebuilt(e: Column) -> Column:
        h = e["h"]
        cornea = h["cornea"]
        values = {name: pick(h, specs) for name, specs in c.NORMALIZE_NUMBERS.items()}
        coma = F.concat(
            F.coalesce(F.try_variant_get(pick(h, c.COMA_FALLBACK_PATHS), "$", "string"), F.lit("NaN")), F.lit(" µm")
        )
        zernike = F.coalesce(
            h["zernike"], F.to_variant_object(F.create_map(F.lit("5mm"), F.create_map(F.lit("z31_coma"), coma)))
        )
        new_cornea = overlay(as_map(cornea), {
            "source_file": h["source_file"],
            "quality": F.coalesce(pick(h, c.QUALITY_PATHS), F.parse_json(F.lit(f'"{c.QUALITY_MISSING}"'))),
            "anterior_cornea": overlay(members_at(cornea, "anterior_cornea"), {"kmax_d": values["kmax_d"]}),
            "pachymetry": overlay(members_at(cornea, "pachymetry"), {"thinnest_um": values["thinnest_um"]}),
            "belin_ambrosio": overlay(as_map(h["ectasia"]), {"d": values["bad_d"], "art_max": values["art_max"]}),
            "topometric_indices_8mm": F.coalesce(h["topometric"], F.parse_json(F.lit('{"tkc":null}'))),
            "cataract_preop": F.coalesce(h["cataract"], F.parse_json(F.lit('{"total_corneal_z40_6mm_um":null}'))),
            "corneal_rings": overlay(members_at(cornea, "corneal_rings"), {"zernike": zernike}),
            "iol": e["iol"], "endothelium": e["microscopy"],
        })
        return F.struct(new_cornea.alias("pentacam"), e["iol"].alias("iol"), e["microscopy"].alias("microscopy"))

    # Lambda variables bind each intermediate object once per eye.
    eyes = F.array(*[found(i, eye) for i, eye in enumerate(c.EYES)])
    for step in (with_shapes, with_objects, with_object_shapes, with_other_eyes, rebuilt):
        eyes = F.transform(eyes, step)

    def written_back(parts: Column) -> Column:
        def eyes_of(exam: str) -> Column:
            return F.to_variant_object(F.create_map(*[
                x for i, eye in enumerate(c.EYES) for x in (F.lit(eye), F.get(parts, F.lit(i))[exam])
            ]))

        return overlay(as_map(analysis), {"exams": overlay(members_at(analysis, "exams"), {
            exam: overlay(members_at(analysis, f"exams.{exam}"), {"eyes": eyes_of(part)}) for exam, part in (
                ("pentacam_corneal_tomography", "pentacam"), ("iol_calculation", "iol"), ("specular_microscopy", "microscopy"),
            )
        })})

    return F.get(F.transform(F.array(eyes), written_back), F.lit(0))
