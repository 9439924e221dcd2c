"""Token ids in ORC: run-length encoded integers, row indexes and Bloom filters on document ids.

Documents are range-partitioned and sorted by id, so files, stripes and row groups cover
disjoint id ranges: a lookup reads only stripes whose statistics and Bloom filters allow
the id, and a full read takes stripes in parallel.  Each file carries running positions;
only one total per file is needed to turn them into global ones.

Null texts are empty texts and have the end id only.  Rows without an id come first; rows
with the same id keep the order of their texts.  An empty table gives an empty result.
Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from chartloom.llm.common import text_groups, whole_text, work_path
from chartloom.llm.tokens import encoder

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start_in_file", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType())),
])
STRIPE_BYTES = 32 << 20
ROW_INDEX_STRIDE = 2000


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append one id to each run of a flat array; also gives the run borders."""
    borders = np.concatenate(([0], np.cumsum(counts + 1)))
    out = np.full(borders[-1], end_id, "<u4")
    keep = np.ones(borders[-1], bool)
    keep[borders[1:] - 1] = False
    out[keep] = ids
    return out, borders


def encode(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """One row per document in the order of each partition, with positions counted from its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = 0
        for batch in batches:
            doc_id = batch.column(0)
            for at, texts in text_groups(batch):
                flat, borders = with_end(*encoder(tokenizer_path).encode(texts), end_id)
                yield pa.RecordBatch.from_arrays([
                    doc_id.slice(at, len(texts)),
                    pa.array(start + borders[:-1]),
                    pa.array(np.diff(borders)),
                    pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(flat.view(np.int32))),
                ], names=SCHEMA.names)
                start += int(borders[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    (
        encode(docs, tokenizer_path, end_id).write
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", ROW_INDEX_STRIDE)
        .option("maxRecordsPerFile", 0)  # positions count from the start of a file
        .option("compression", "zstd").orc(path)
    )


def _part_number(column: str = "file") -> Column:
    """Files of one write are numbered in the order of the ids."""
    return F.regexp_extract(column, r"part-(\d+)", 1).cast("long")


def read_tokens(spark: SparkSession, path: str, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids.  ``doc_ids`` become a filter that the scan uses to skip stripes and row groups.

    The table of file offsets has one short row per file, which bounds what is broadcast.
    """
    stored = spark.read.schema(SCHEMA).orc(path).withColumn("file", F.col("_metadata.file_name"))
    totals = stored.groupBy("file").agg(F.max(F.col("start_in_file") + F.col("n_tokens")).alias("total"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        totals.withColumn("part", _part_number())
        .select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    )
    if doc_ids is not None:
        stored = stored.where(F.col("doc_id").isin(list(doc_ids)))
    return (
        stored.join(F.broadcast(offsets), "file")
        .select("doc_id", (F.col("offset") + F.col("start_in_file")).alias("start"), "n_tokens", "ids")
    )


def digest(tokens: DataFrame) -> DataFrame:
    """crc32 of each document's ids as little-endian unsigned 32-bit integers."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            flat = np.asarray(ids.values).astype("<u4", copy=False).tobytes()
            borders = np.asarray(ids.offsets).tolist()
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(borders, borders[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return tokens.mapInArrow(run, schema)


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write all documents below the shared folder and read them back with global positions."""
    path = work_path(docs.sparkSession, "orc-tokens")
    write_tokens(docs, path, tokenizer_path, end_id)
    return read_tokens(docs.sparkSession, path)
