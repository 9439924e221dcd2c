"""File-set scans: metadata first, bytes only where the size bound allows them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.config import MARKER_NAME, Limits
from chartloom.functions.text import basename, sha256
from chartloom.operators.staging import evaluate_once
from chartloom.session import prepare


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """Every object below a folder without reading its bytes: (path, size_bytes, modified_at)."""
    found = (
        prepare(spark).read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    )
    return found.select(
        "path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at")
    )


def under_prefix(objects: DataFrame, prefix: str) -> DataFrame:
    return objects.where(F.contains(F.col("path"), F.lit("/" + prefix.strip("/") + "/")))


def child_prefixes(objects: DataFrame, prefix: str) -> DataFrame:
    """Distinct names directly below a prefix, as a delimiter listing gives them."""
    name = F.regexp_extract("path", f"/{prefix.strip('/')}/([^/]+)/", 1)
    return objects.select(name.alias("case_id")).where(F.col("case_id") != "").distinct()


def scan_files(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """Hash every file within the size bound; larger ones are listed as ``too_large`` without a hash.

    The bound is a predicate on the scan, so bytes of an oversized file are never
    loaded.  The content column stays in this select and out of any shuffle.
    """
    raw = prepare(spark).read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = raw.where(F.col("length") <= limits.max_file).select(
        "path", F.col("length").alias("size_bytes"), sha256(F.col("content")).alias("sha256"),
        F.lit("hashed").alias("state"),
    )
    large = raw.where(F.col("length") > limits.max_file).select(
        "path", F.col("length").alias("size_bytes"), F.lit(None).cast("string").alias("sha256"),
        F.lit("too_large").alias("state"),
    )
    both = small.unionByName(large)
    return both.select(basename(F.col("path")).alias("filename"), "*")


def read_documents(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """Compiled case documents below ``path``: (case_id, raw), one file each, within the size bound.

    Larger ones are listed by ``document_rejects``.
    """
    raw = (
        prepare(spark).read.format("binaryFile")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", MARKER_NAME).load(path)
    )
    return raw.where(F.col("length") <= limits.max_document).select(
        F.regexp_extract("path", "/cases/([^/]+)/", 1).alias("case_id"),
        F.decode("content", "UTF-8").alias("raw"),
    )


def document_rejects(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """Case documents ``read_documents`` leaves out: (case_id, path, size_bytes, reason), without their bytes."""
    raw = (
        prepare(spark).read.format("binaryFile")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", MARKER_NAME).load(path)
    )
    return raw.where(F.col("length") > limits.max_document).select(
        F.regexp_extract("path", "/cases/([^/]+)/", 1).alias("case_id"), "path",
        F.col("length").alias("size_bytes"), F.lit("too_large").alias("reason"),
    )


def split_readable(documents: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(parsed documents, rejects with their text): one bad document never stops the rest."""
    kept = [name for name in documents.columns if name != raw]
    parsed = evaluate_once(documents.select(*kept, raw, F.try_parse_json(F.col(raw)).alias("analysis")))
    good = parsed.where(F.col("analysis").isNotNull()).select(*kept, "analysis")
    return good, parsed.where(F.col("analysis").isNull()).select(*kept, raw)
