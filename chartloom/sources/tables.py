"""Partitioned tables of the life-cycle and their sinks.

Layout: ``<root>/drafts``, ``<root>/draft_files``, ``<root>/files`` and ``<root>/cases``, each split by the
UTC day carried in the ids, so that reads of a period and erasures touch few
folders.  A case counts as committed once its row is in ``cases``; its file rows appear in
the same commit (see ``generations``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.functions.ids import promoted_key
from chartloom.functions.text import pretty_json
from chartloom.operators.lifecycle import erased_objects, expired_drafts, promote, route_confirms
from chartloom.operators.lineage import document_matches, promoted_document
from chartloom.operators.staging import stage
from chartloom.sources import generations as g

TABLES = ("drafts", "draft_files", "files", "cases")


def _versioned(rows: DataFrame) -> DataFrame:
    return rows if "version" in rows.columns else rows.withColumn("version", F.lit(0).cast("bigint"))


def write_drafts(drafts: DataFrame, files: DataFrame, root: str, period: str = g.DAILY) -> None:
    """Stage drafts (intake_id, created_at, analysis) with their file rows (intake_id, …, key).

    Rows may carry a ``version``; the highest one of a draft or file stays, in whatever order they arrive.
    """
    spark = drafts.sparkSession
    changes = g.upsert(spark, root, "draft_files", _versioned(files), ["intake_id", "key"], period)
    g.switch(spark, root, changes + g.upsert(spark, root, "drafts", _versioned(drafts), ["intake_id"], period))


def read_drafts(spark: SparkSession, root: str) -> DataFrame:
    return g.read(spark, root, "drafts")


def read_draft_files(spark: SparkSession, root: str) -> DataFrame:
    return g.read(spark, root, "draft_files")


def commit_cases(cases: DataFrame, files: DataFrame, root: str, period: str = g.DAILY) -> None:
    """Write file rows (case_id, file_index, key, …) and the marker rows, which appear together.

    Keys move from the draft area to the case area on the way.  A run that dies in
    between leaves nothing that readers see.  Committing again adds nothing; a higher ``version`` of a case or file outdoes the stored one.
    """
    spark = cases.sparkSession
    moved = files.withColumn("key", promoted_key(F.col("case_id"), F.col("key")))
    changes = g.upsert(spark, root, "files", _versioned(moved), ["case_id", "key"], period)
    g.switch(spark, root, changes + g.upsert(spark, root, "cases", _versioned(cases), ["case_id"], period))


def read_cases(spark: SparkSession, root: str, ids: DataFrame | None = None, period: str = g.DAILY) -> DataFrame:
    """Committed cases, those of ``ids`` (case_id) if given: their days become partition filters."""
    if ids is None:
        return g.read(spark, root, "cases")
    wanted = ids.select("case_id").distinct()
    days = [row[0] for row in wanted.select(g.day_of(F.col("case_id"), period)).distinct().collect()]
    return g.read(spark, root, "cases", days).join(wanted, "case_id", "left_semi")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """File rows of committed cases only."""
    return g.read(spark, root, "files").join(read_cases(spark, root).select("case_id"), "case_id", "left_semi")


def erase_cases(spark: SparkSession, root: str, ids: DataFrame, period: str = g.DAILY) -> DataFrame:
    """Remove cases for good, files and marker in one commit.  Safe to repeat.

    Returns per id how many objects went, its marker included, and whether it was found at all.
    """
    files, cases = g.present(spark, root, "files"), g.present(spark, root, "cases")
    none = spark.createDataFrame([], "case_id string, key string")
    answer = stage(erased_objects(none if files is None else files, none if cases is None else cases, ids), "erased")
    changes = g.without(spark, root, "files", ids, "case_id", period)
    g.switch(spark, root, changes + g.without(spark, root, "cases", ids, "case_id", period))
    return answer


def discard_drafts(spark: SparkSession, root: str, ids: DataFrame, period: str = g.DAILY) -> None:
    """Remove drafts and their files in one commit; ids that are not there are ignored."""
    changes = g.without(spark, root, "draft_files", ids, "intake_id", period)
    g.switch(spark, root, changes + g.without(spark, root, "drafts", ids, "intake_id", period))


def confirm_drafts(
    spark: SparkSession, root: str, requests: DataFrame, requested_at: str = "requested_at", ttl_hours: int = 24, period: str = g.DAILY,
) -> DataFrame:
    """Answer confirm requests (intake_id, requested_at), commit what they confirm and clear its drafts away.

    Drafts carry ``created_at``, ``analysis`` and ``files``, the uploads in order.  The sources of a committed document point to the case's own
    files.  A run that dies after the commit leaves drafts of committed cases; asking again answers the same, adds nothing and clears them.
    """
    drafts, stored = read_drafts(spark, root), g.present(spark, root, "cases")
    judged = drafts.select("intake_id", "created_at", "analysis", document_matches(F.col("analysis"), F.col("files")).alias("manifest_ok"))
    cases = spark.createDataFrame([], "case_id string") if stored is None else stored.select("case_id")
    answers = stage(route_confirms(requests, judged, cases, requested_at, ttl_hours), "answers")
    confirmed = answers.where("outcome = 'confirmed'").select("intake_id").distinct()
    named = promote(drafts.join(confirmed, "intake_id", "left_semi"))
    documents = named.select("case_id", promoted_document(F.col("analysis"), F.col("case_id"), F.col("files")).alias("analysis"))
    files = promote(read_draft_files(spark, root).join(confirmed, "intake_id", "left_semi")).drop("intake_id")
    commit_cases(documents, files, root, period)
    discard_drafts(spark, root, confirmed, period)
    return answers


def sweep_drafts(spark: SparkSession, root: str, as_of: Column, ttl_hours: int = 24, period: str = g.DAILY) -> DataFrame:
    """Discard every draft whose time to live is over; returns their ids."""
    over = stage(expired_drafts(read_drafts(spark, root), as_of, ttl_hours).select("intake_id"), "swept")
    discard_drafts(spark, root, over, period)
    return over


def purge(spark: SparkSession, root: str) -> int:
    """Delete what erasing, discarding and outdone versions have left behind."""
    return g.purge(spark, root, TABLES)


def write_listing(listing: DataFrame, path: str) -> None:
    """Case list as JSON lines, null fields kept."""
    listing.select(
        F.col("case_id").alias("caseId"), F.col("patient_name").alias("patientName"),
        F.col("analysis_key").alias("analysisKey"),
    ).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def pretty_document(analysis: Column) -> Column:
    """Indented JSON text of a compiled document, two spaces a level."""
    return pretty_json(F.to_json(analysis))


def write_pretty(cases: DataFrame, path: str) -> None:
    """Indented documents as (case_id, text) rows, each text on its own in a JSON line; the files are compressed, as most of it is spaces."""
    cases.select("case_id", pretty_document(F.col("analysis")).alias("document")).write.mode("overwrite").json(path, compression="gzip")


def write_requests(lines: DataFrame, path: str) -> None:
    """Request lines as a JSONL file set for an offline batch."""
    lines.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def write_silver(documents: DataFrame, path: str, raw: str = "raw") -> None:
    """Parse once and keep the VARIANT; later reads fetch only the paths they use."""
    kept = [name for name in documents.columns if name != raw]
    documents.select(*kept, F.try_parse_json(F.col(raw)).alias("analysis")).write.mode("overwrite").parquet(path)
