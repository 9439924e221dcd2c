"""Training-corpus pipeline: quality, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import compression, line_windows, mixing, near_dedup, packing
from chartloom.llm.common import reachable, read_table, work_path

QUALITY_SCORE = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of at least 0.3."""
    model = compression.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = compression.score(docs, model, "_score")
    return scored.where(F.col("_score") >= QUALITY_SCORE).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of repeated windows; a document with nothing left goes."""
    cut = line_windows.dedup_lines(docs)
    left = cut.where("n_removed = 0 OR n_removed < n_lines")
    counted = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return counted.select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the smallest id."""
    reachable(spark)
    classes = near_dedup.near_duplicates(docs).where("doc_id = class_id OR class_id IS NULL").select(F.col("doc_id").alias("_id")).distinct()
    kept = docs.join(classes, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their rate towards the target weights keeps."""
    return mixing.thin(docs, read_table(spark, sf_dir, "labels"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids and places in sequences."""
    reachable(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality classifier", quality), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup_stage),
    ("mixing to target weights", mix), ("best-fit packing", pack),
]

#: Compression, MinHash and tokenizers are not SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = work_path(spark, f"stage-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
