"""File lineage: which stored file each extracted source belongs to."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom import config as c
from chartloom.functions.ids import owned_by_case, promoted_key
from chartloom.functions.text import basename
from chartloom.functions.variants import OBJECT_MAP, as_list, as_map, at, is_object, text
from chartloom.operators.staging import evaluate_once, join_splittable


def attach_sources(
    files: DataFrame, sources: DataFrame, payload: tuple[str, ...], intake: str = "intake_no"
) -> DataFrame:
    """Every uploaded file with its first listed source, matched by path base name or by file name.

    Each source offers its one or two names as join keys, which turns the
    either-or match into one equi-join.  The candidates of a name are reduced to
    the first one before they meet the files; files without a source keep NULLs
    and sources without a file drop out.
    """
    names = F.array_compact(F.array_distinct(F.array(
        basename(F.coalesce(F.col("path"), F.lit(""))), F.col("filename"),
    )))
    offered = sources.select(intake, "source_pos", *payload, F.explode(names).alias("_name"))
    first = (
        offered.groupBy(intake, "_name")
        .agg(F.min_by(F.struct(*payload), "source_pos").alias("_source"))
        .withColumnRenamed("_name", "filename")
    )
    return join_splittable(files, first, [intake, "filename"], "left").select(
        *[F.col(name) for name in files.columns], *[F.col(f"_source.{name}").alias(name) for name in payload]
    )


def enriched_sources(
    files: DataFrame, sources: DataFrame, payload: tuple[str, ...] = ("exam", "eye"), intake: str = "intake_no"
) -> DataFrame:
    """Source entries as stored with the analysis: one per upload, in upload order by ``index``."""
    joined = attach_sources(files, sources, payload, intake)
    return joined.select(
        intake, F.col("file_index").alias("index"), F.col("filename").alias("path"),
        F.col("content_type").alias("type"), "size_bytes", "sha256", *payload,
    )


def with_defaults(analysis: Column, generated_on: dt.date) -> Column:
    """Fill absent envelope fields; a field that is present but null stays null."""
    defaults = {
        "schema_version": c.DEFAULT_SCHEMA_VERSION,
        "generated_on": generated_on.isoformat(),
        "language": c.DEFAULT_LANGUAGE,
    }
    extra = F.create_map(*[
        part for key, value in defaults.items() for part in (F.lit(key), F.parse_json(F.lit(f'"{value}"')))
    ])
    return F.to_variant_object(F.map_zip_with(as_map(analysis), extra, lambda _k, old, new: F.coalesce(old, new)))


def gather_files(files: DataFrame, intake: str = "intake_no") -> DataFrame:
    """(intake, _uploads): the files of each admitted set in upload order.

    Admission bounds the bytes and name lengths of a set, so no group can outgrow one document.  Bytes stay out of it.
    """
    entry = F.struct("file_index", "filename", "content_type", "size_bytes", "sha256", "key")
    return files.groupBy(intake).agg(F.array_sort(F.collect_list(entry)).alias("_uploads"))


def _with(members: Column, changes: dict[str, Column]) -> Column:
    """An object with some members set."""
    new = F.create_map(*[part for key, value in changes.items() for part in (F.lit(key), value.cast("variant"))])
    empty = F.expr(f"cast(map() as {OBJECT_MAP})")
    return F.to_variant_object(F.map_zip_with(F.coalesce(members, empty), new, lambda _k, old, changed: F.coalesce(changed, old)))


def enriched_document(analysis: Column, uploads: Column) -> Column:
    """The document with one source entry per upload, in upload order, inside the row.

    An entry keeps every member of the first listed source that names the file by the base name of its path or by file
    name, and gets the upload's index, path, type, size and hash.  Listed sources without a file go.
    """
    listed = F.filter(F.coalesce(as_list(at(analysis, "source_files")), F.array().cast("array<variant>")), is_object)

    def entry(file: Column) -> Column:
        def names(source: Column) -> Column:
            path = basename(F.coalesce(text(at(source, "path")), F.lit("")))
            return (path == file["filename"]) | F.coalesce(text(at(source, "filename")) == file["filename"], F.lit(False))

        return _with(as_map(F.get(F.filter(listed, names), F.lit(0))), {
            "index": file["file_index"], "path": file["filename"], "type": file["content_type"],
            "size_bytes": file["size_bytes"], "sha256": file["sha256"],
        })

    sources = F.to_variant_object(F.transform(uploads, entry))
    return _with(as_map(analysis), {"source_files": sources})


def document_matches(analysis: Column, uploads: Column) -> Column:
    """Do the document's sources and the stored files agree position by position?  The row-local form of ``verify_manifest``."""
    sources = as_list(at(analysis, "source_files"))

    def fine(file: Column, place: Column) -> Column:
        source = F.get(sources, place)
        return (
            (text(at(source, "sha256")) == file["sha256"]) & (basename(text(at(source, "path"))) == file["filename"])
            & file["key"].startswith("drafts/")
        )

    pairs = F.transform(uploads, lambda file, place: F.coalesce(fine(file, place), F.lit(False)))
    return F.coalesce((F.size(sources) == F.size(uploads)) & F.forall(pairs, lambda ok: ok), F.lit(False))


def promoted_document(analysis: Column, case_id: Column, uploads: Column) -> Column:
    """The document with the path of each source rewritten to the case key of the file at its position."""
    def moved(source: Column, place: Column) -> Column:
        key = promoted_key(case_id, F.get(uploads, place)["key"])
        return F.when(is_object(source) & key.isNotNull(), _with(as_map(source), {"path": key})).otherwise(source)

    sources = F.transform(as_list(at(analysis, "source_files")), moved)
    return F.when(sources.isNotNull(), _with(as_map(analysis), {"source_files": F.to_variant_object(sources)})).otherwise(analysis)


def verify_manifest(files: DataFrame, sources: DataFrame, intake: str = "intake_no") -> DataFrame:
    """Per intake: do stored files and analysed sources agree position by position?

    Same count, equal hash, equal base name, and a key inside the draft area.
    """
    left = files.select(
        intake, F.col("file_index").alias("index"), F.col("filename"), F.col("sha256").alias("_file_hash"),
        "key", F.lit(True).alias("_has_file"),
    )
    right = sources.select(intake, "index", "path", F.col("sha256").alias("_source_hash"))
    fine = (
        F.col("_has_file")
        & (F.col("_file_hash") == F.col("_source_hash"))
        & (basename(F.col("path")) == F.col("filename"))
        & F.col("key").startswith("drafts/")
    )
    return (
        left.join(right, [intake, "index"], "full_outer")
        .groupBy(intake)
        .agg(
            F.bool_and(F.coalesce(fine, F.lit(False))).alias("matches"),
            F.sum(F.when(F.coalesce(fine, F.lit(False)), 0).otherwise(1)).cast("bigint").alias("n_faults"),
        )
    )


def promote_sources(sources: DataFrame, files: DataFrame, case_id: Column, intake: str = "intake_no") -> DataFrame:
    """Rewrite the path of each source to the case key of the file at the same position."""
    keys = files.select(intake, F.col("file_index").alias("index"), "key")
    joined = sources.withColumn("case_id", case_id).join(keys, [intake, "index"], "left")
    moved = F.when(F.col("key").isNotNull(), promoted_key(F.col("case_id"), F.col("key")))
    rest = [name for name in sources.columns if name != "path"]
    return joined.select("case_id", *rest, F.coalesce(moved, F.col("path")).alias("path"))


def source_entries(cases: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per listed source file of each case, in order."""
    shape = "array<struct<path: string, filename: string, type: string, exam: string, eye: string, pages: variant>>"
    listed = evaluate_once(cases.select("case_id", *keep, at(F.col("analysis"), "source_files", shape).alias("_files")))
    return listed.select("case_id", *keep, F.posexplode("_files").alias("index", "_f")).select(
        "case_id", *keep, F.col("index").cast("bigint").alias("index"), "_f.*")


def owned_sources(entries: DataFrame) -> DataFrame:
    """Only the entries whose path lies under the prefix of their own case."""
    return entries.where(owned_by_case(F.col("case_id"), F.col("path")))
