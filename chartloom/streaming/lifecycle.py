"""Streaming form of the draft life-cycle: admission, confirm, expiry.

A job is an ordinary streaming DataFrame, or a ``DraftJob`` whose state lies in
narrow tables; ``drain`` runs one over all data that is available now, with its
checkpoint in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from chartloom.config import Limits
from chartloom.operators.admission import admit
from chartloom.session import prepare, shared_dir

DELAY = "1 hour"


def table_stream(spark: SparkSession, sf_dir: str, name: str, **options: str) -> DataFrame:
    """Stream over one table, stored either as a folder of files or as a single file."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = prepare(spark).read.parquet(path).schema
    reader = spark.readStream.schema(schema).options(**options)
    first = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").first()
    if first and first[0].rstrip("/").endswith(f"/{name}.parquet"):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(path)


def run_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run in the shared folder; a job that has to resume is given a fixed one instead."""
    return f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class DraftJob:
    """Drafts (key, created_at) against requests (key, requested_at) in event time: what was confirmed, or what expired."""

    drafts: DataFrame
    requests: DataFrame
    key: str
    ttl_hours: int
    delay: str
    expired: bool


def run_batches(rows: DataFrame, base: str, take: Callable[[DataFrame, int], None]) -> None:
    """Call ``take`` once per micro-batch of what is available; a replay gets the same number again."""
    running = (
        rows.writeStream.foreachBatch(take).option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start()
    )
    running.awaitTermination()


def drain(stream: DataFrame | DraftJob, name: str) -> DataFrame:
    """Run a job over everything available and return its output table."""
    if isinstance(stream, DraftJob):
        return _drain_drafts(stream, run_folder(stream.drafts.sparkSession, name))
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    running = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/out")
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def drain_batches(stream: DataFrame, name: str, handle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``handle`` per micro-batch; a replayed batch overwrites its own folder, so output is exactly once."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        handle(batch).write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    running = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out").drop("batch_id")


def _micros(spark: SparkSession, interval: str) -> int:
    return spark.range(1).select(F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL {interval})")).first()[0]


def _drain_drafts(job: DraftJob, base: str) -> DataFrame:
    """Each micro-batch is stored as narrow rows and joined with the stored ones that a draft or request can still meet.

    As with Spark's own joins in event time, the watermark is the smaller of both sides' latest times less the
    delay, rows that come later than it are dropped, and stored rows that it has passed are not read any more.  Nothing is
    held in memory between batches, so the join can spill.
    """
    spark, key = job.drafts.sparkSession, job.key
    ttl, delay = job.ttl_hours * 3_600_000_000, _micros(spark, job.delay)
    rows = job.drafts.select(key, F.unix_micros(F.col("created_at").cast(TimestampType())).alias("at_us"), F.lit(True).alias("is_draft")).unionByName(
        job.requests.select(key, F.unix_micros(F.col("requested_at").cast(TimestampType())).alias("at_us"), F.lit(False).alias("is_draft"))
    )
    kind = dict(rows.dtypes)[key]
    stored = f"`{key}` {kind}, at_us long, is_draft boolean, batch_id long"
    found = f"`{key}` {kind}, created_us long, batch_id long"

    def marks(batch_id: int) -> tuple[int | None, int | None]:
        if batch_id < 0:
            return None, None
        return tuple(spark.read.schema("draft_us long, request_us long").parquet(f"{base}/marks/batch_id={batch_id}").first())

    def watermark(sides: tuple[int | None, int | None]) -> int | None:
        return None if None in sides else min(sides) // 1000 * 1000 - delay

    def take(batch: DataFrame, batch_id: int) -> None:
        seen = marks(batch_id - 1)
        passed = watermark(seen)
        fresh = batch if passed is None else batch.where(F.col("at_us") > passed)
        fresh.write.mode("overwrite").parquet(f"{base}/events/batch_id={batch_id}")
        events = spark.read.schema(stored).parquet(f"{base}/events").where(F.col("batch_id") <= batch_id)
        latest = events.where(F.col("batch_id") == batch_id).agg(*[F.max(F.when(side, F.col("at_us"))) for side in (F.col("is_draft"), ~F.col("is_draft"))]).first()
        seen = tuple(max((t for t in pair if t is not None), default=None) for pair in zip(seen, latest))
        spark.createDataFrame([seen], "draft_us long, request_us long").write.mode("overwrite").parquet(f"{base}/marks/batch_id={batch_id}")
        if passed is not None:
            events = events.where(F.col("at_us") > passed - ttl)
        drafts = events.where("is_draft").select(key, F.col("at_us").alias("created_us"))
        requests = events.where("NOT is_draft").select(F.col(key).alias("_key"), "at_us")
        meet = (F.col(key) == F.col("_key")) & F.col("at_us").between(F.col("created_us"), F.col("created_us") + ttl)
        if job.expired:
            until = watermark(seen)
            over = F.lit(False) if until is None else F.col("created_us") + ttl <= until
            out = drafts.where(over).join(requests, meet, "left_anti")
        else:
            out = drafts.join(requests, meet, "left_semi").groupBy(key).agg(F.min("created_us").alias("created_us"))
            if batch_id:
                told = spark.read.schema(found).parquet(f"{base}/out").where(F.col("batch_id") < batch_id)
                out = out.join(told, key, "left_anti")
        out.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    run_batches(rows, base, take)
    return spark.read.schema(found).parquet(f"{base}/out").select(key, F.timestamp_micros("created_us").alias("created_at"))


def confirmed_drafts(
    drafts: DataFrame, requests: DataFrame, key: str, ttl_hours: int = 24, delay: str = DELAY
) -> DraftJob:
    """Drafts confirmed in time, each once however often the confirm is repeated."""
    return DraftJob(drafts, requests, key, ttl_hours, delay, expired=False)


def expired_drafts(
    drafts: DataFrame, requests: DataFrame, key: str, ttl_hours: int = 24, delay: str = DELAY
) -> DraftJob:
    """Drafts whose time to live passed, by event time, without a confirm."""
    return DraftJob(drafts, requests, key, ttl_hours, delay, expired=True)


def admitted_uploads(files: DataFrame, limits: Limits = Limits(), name: str = "admission") -> DataFrame:
    """Admission verdicts of arriving file sets; the files of one intake arrive together."""
    return drain_batches(files, name, lambda batch: admit(batch, limits))
