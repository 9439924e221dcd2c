"""Normalizer: drifting exam layouts to one typed row per case and eye."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom import config as c
from chartloom.functions.text import leading_number
from chartloom.functions.variants import at, first_present, number, present

METRICS = (
    "thinnest_um", "kmax_d", "bad_d", "art_max", "z31_coma_um", "z40_6mm_um",
    "axial_length_mm", "astigmatism_d", "cell_density_cells_per_mm2",
)


def parse_cases(documents: DataFrame, raw: str = "raw") -> DataFrame:
    """Replace the JSON text by one VARIANT column, parsed once; undecodable rows stay NULL."""
    kept = [name for name in documents.columns if name != raw]
    return documents.select(*kept, F.try_parse_json(F.col(raw)).alias("analysis"))


def _nested(paths: list[tuple[str, str]]) -> dict:
    """Tree of member names for (dotted path, leaf type) pairs."""
    tree: dict = {}
    for path, leaf in paths:
        node = tree
        *parents, last = path.split(".")
        for name in parents:
            node = node.setdefault(name, {})
        node[last] = leaf
    return tree


def _ddl(tree: dict | str) -> str:
    """Struct type text of such a tree: one cast then resolves every path in a single walk."""
    if isinstance(tree, str):
        return tree
    return "struct<" + ", ".join(f"`{name}`: {_ddl(node)}" for name, node in tree.items()) + ">"


def paths_type(paths: list[tuple[str, str]]) -> str:
    """Type text that reads (dotted path, leaf type) pairs out of a document in one walk."""
    return _ddl(_nested(paths))


def _paths_of(holder: str) -> list[str]:
    """All configured paths read from one object, in order and without repeats."""
    listed = [spec for paths in c.NORMALIZE_NUMBERS.values() for spec in paths]
    listed += [spec for paths in c.NORMALIZE_OBJECTS.values() for spec in paths]
    listed += [*c.QUALITY_PATHS, c.COMA_TEXT_PATH, *c.COMA_FALLBACK_PATHS]
    listed += [*c.ASTIGMATISM_PATHS, c.ASTIGMATISM_TEXT_PATH, c.TKC_PATH]
    return list(dict.fromkeys(path for owner, path in (spec.split(":") for spec in listed) if owner == holder))


def shape_of(holder: str) -> str:
    return paths_type([(path, "variant") for path in _paths_of(holder)])


def _field(spec: str) -> Column:
    """Column of a configured "object:path"; absent parents give NULL."""
    holder, path = spec.split(":")
    value = F.col(f"_{holder}")
    for name in path.split("."):
        value = value.getField(name)
    return value


def _chain(specs: tuple[str, ...]) -> Column:
    return first_present(*[_field(spec) for spec in specs])


def _exam_shape(raw_eye: bool) -> str:
    cornea = "variant" if raw_eye else shape_of("cornea")
    eyes = {eye: cornea for eye in c.EYES}
    both = {eye: "variant" for eye in c.EYES}
    return _ddl({
        "pentacam_corneal_tomography": {"source": "array<string>", "eyes": eyes},
        "iol_calculation": {"eyes": {**both, "AO": both}},
        "specular_microscopy": {"source": "array<string>", "eyes": {eye: shape_of("endothelium") for eye in c.EYES}},
    })


def _eye_struct(index: int, eye: str, strict: bool) -> Column:
    pentacam = F.col("_exams.pentacam_corneal_tomography")
    iol = F.col("_exams.iol_calculation")
    micro = F.col("_exams.specular_microscopy")
    usable = F.lit(True)
    if strict:
        usable = pentacam.getField("source").isNotNull() & iol.isNotNull() & micro.isNotNull()
    return F.struct(
        F.lit(eye).alias("eye"),
        usable.alias("_usable"),
        F.get(pentacam.getField("source"), F.lit(index)).alias("source_file"),
        F.get(micro.getField("source"), F.lit(0)).alias("microscopy_file"),
        pentacam.getField("eyes").getField(eye).alias("_cornea"),
        first_present(
            iol.getField("eyes").getField(eye), iol.getField("eyes").getField("AO").getField(eye)
        ).alias("_biometry"),
        micro.getField("eyes").getField(eye).alias("_endothelium"),
    )


def eye_documents(
    cases: DataFrame, strict: bool = True, keep: tuple[str, ...] = (), raw_eye: bool = False
) -> DataFrame:
    """One row per case and eye with the three exam sub-documents side by side.

    ``strict`` drops a case that lacks an exam (or the tomography source list);
    otherwise its eyes come out with NULL metrics.
    """
    exams = at(F.col("analysis"), "exams", _exam_shape(raw_eye))
    eyes = F.array(*[_eye_struct(i, eye, strict) for i, eye in enumerate(c.EYES)])
    return (
        cases.select("case_id", *keep, exams.alias("_exams"))
        .select("case_id", *keep, F.inline(eyes))
        .where("_usable")
        .drop("_usable")
    )


def normalize(
    cases: DataFrame, strict: bool = True, keep: tuple[str, ...] = (), raw_eye: bool = False
) -> DataFrame:
    """Typed gold rows.  A missing metric is NULL, never NaN.

    ``raw_eye`` keeps the untouched eye document next to the typed columns.
    """
    eyes = eye_documents(cases, strict, keep, raw_eye)
    base = ["case_id", *keep, "eye", "source_file", "microscopy_file"]
    if raw_eye:
        eyes = eyes.withColumn("raw_eye", present(F.col("_cornea"))).withColumn(
            "_cornea", F.try_variant_get("raw_eye", "$", shape_of("cornea"))
        )
        base.append("raw_eye")
    # Object-level fallback first: once an object is there, its sibling is never consulted.
    objects = eyes.select(
        *base, "_cornea", "_endothelium",
        F.try_variant_get("_biometry", "$", shape_of("biometry")).alias("_biometry"),
        *[
            F.try_variant_get(_chain(specs), "$", shape_of(name)).alias(f"_{name}")
            for name, specs in c.NORMALIZE_OBJECTS.items()
        ],
        _chain(c.NORMALIZE_OBJECTS["zernike"]).isNotNull().alias("_has_zernike"),
    )
    coma_text = F.when(F.col("_has_zernike"), _field(c.COMA_TEXT_PATH)).otherwise(_chain(c.COMA_FALLBACK_PATHS))
    chosen = objects.select(
        *base,
        *[_chain(specs).alias(f"_v_{name}") for name, specs in c.NORMALIZE_NUMBERS.items()],
        _chain(c.ASTIGMATISM_PATHS).alias("_v_astigmatism_d"),
        F.try_variant_get(_field(c.ASTIGMATISM_TEXT_PATH), "$", "string").alias("_astigmatism_text"),
        F.try_variant_get(coma_text, "$", "string").alias("_coma_text"),
        F.try_variant_get(_chain(c.QUALITY_PATHS), "$", "string").alias("_quality"),
        F.try_variant_get(_field(c.TKC_PATH), "$", "string").alias("tkc"),
    )
    values = {name: number(F.col(f"_v_{name}")) for name in c.NORMALIZE_NUMBERS}
    values["astigmatism_d"] = F.when(
        F.col("_v_astigmatism_d").isNotNull(), number(F.col("_v_astigmatism_d"))
    ).otherwise(leading_number(F.col("_astigmatism_text")))
    values["z31_coma_um"] = leading_number(F.col("_coma_text"))
    return chosen.select(
        *base,
        F.coalesce(F.col("_quality"), F.lit(c.QUALITY_MISSING)).alias("quality"),
        *[values[name].alias(name) for name in METRICS],
        "tkc",
    )
