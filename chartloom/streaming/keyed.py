"""Keyed state across micro-batches: draft states and admission of sets that arrive in pieces.

Rows may come in any order, over any number of micro-batches and restarts.  No watermark is set, so no row is late and
none is lost; the state of a key goes a while after its last change (``keep_ms``, real time).  A job with the
same base folder goes on where the last run stopped.  Each micro-batch writes what changed to a folder of
its own, which a replay overwrites.  Draft states are such tables themselves: a micro-batch joins its rows with the stored
ones of its keys.  Sets that arrive in pieces keep theirs in RocksDB.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chartloom.config import Limits
from chartloom.operators.admission import FAULTS, verdicts
from chartloom.streaming.lifecycle import run_batches

#: Micro-batches between two snapshots of the draft states, so that no batch reads more folders than these.
FEW = 256
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_keyed(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, base: str) -> DataFrame:
    """Feed everything available to the processor and return all it has put out so far, with its batch."""
    spark = rows.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    changed = rows.groupBy(key).transformWithState(processor, schema, "Update", "None")
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        running = changed.writeStream.foreachBatch(write).outputMode("update").option(
            "checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        running.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    return spark.read.schema(f"{schema}, batch_id long").parquet(f"{base}/out")


def latest(changes: DataFrame, key: str) -> DataFrame:
    """The last change of each key, reduced before the shuffle."""
    names = [name for name in changes.columns if name not in (key, "batch_id")]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*names), "batch_id").alias("_row"))
    return last.select(key, *[F.col(f"_row.{name}").alias(name) for name in names])


def draft_events(drafts: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Drafts (key, created_at) and requests (key, requested_at, action) as rows of one stream."""
    created = drafts.select(key, F.unix_micros("created_at").alias("at_us"), F.lit("create").alias("action"))
    return created.unionByName(requests.select(key, F.unix_micros("requested_at").alias("at_us"), "action")).where(F.col(key).isNotNull())


def draft_changes(events: DataFrame, key: str, base: str, ttl_hours: int = 24, keep_ms: int | None = None) -> DataFrame:
    """key, created_us, confirm_us, discard_us of every draft seen so far.

    The first confirm and the first discard of a draft in its time to live; requests that come before their draft wait for it.
    """
    spark, ttl_us = events.sparkSession, ttl_hours * 3_600_000_000
    kind = dict(events.dtypes)[key]
    schema = f"`{key}` {kind}, created_us long, confirm_us long, discard_us long"
    asked_schema = f"`{key}` {kind}, at_us long, action string"

    def stored(name: str, columns: str, start: int, last: int, now: int) -> DataFrame:
        """Rows of the snapshot before ``start`` and of the batches from there to ``last``, those of forgotten keys left out."""
        columns = f"{columns}, changed_ms long, batch_id long"
        rows = spark.read.schema(columns).parquet(f"{base}/{name}").where(F.col("batch_id").between(start, last))
        if start:
            rows = rows.unionByName(spark.read.schema(columns).parquet(f"{base}/kept/{name}").where(F.col("batch_id") == start - 1))
        return rows if keep_ms is None else rows.where(F.col("changed_ms") >= now - keep_ms)

    def take(batch: DataFrame, batch_id: int) -> None:
        now = int(time.time() * 1000)
        stamp = F.lit(now).alias("changed_ms")
        batch.select(key, "at_us", "action", stamp).write.mode("overwrite").parquet(f"{base}/events/batch_id={batch_id}")
        fresh = spark.read.schema(asked_schema).parquet(f"{base}/events/batch_id={batch_id}")
        drafts = fresh.where("action = 'create'").groupBy(key).agg(F.min("at_us").alias("_created"))
        asked = fresh.where("action <> 'create'")
        if batch_id:
            waiting = stored("events", asked_schema, batch_id // FEW * FEW, batch_id - 1, now).where("action <> 'create'").join(drafts, key, "left_semi")
            asked = asked.unionByName(waiting.select(*asked.columns))
            known = latest(stored("out", schema, batch_id // FEW * FEW, batch_id - 1, now), key).join(fresh.select(key).distinct(), key, "left_semi")
            drafts = drafts.join(known.drop("changed_ms"), key, "full_outer")
        else:
            drafts = drafts.select("*", *[F.lit(None).cast("bigint").alias(c) for c in ("created_us", "confirm_us", "discard_us")])
        drafts = drafts.where("coalesce(created_us, _created) IS NOT NULL").select(
            key, F.coalesce("created_us", "_created").alias("created_us"), F.col("created_us").isNull().alias("_new"), "confirm_us", "discard_us"
        )
        asked = asked.select(F.col(key).alias("_key"), "at_us", (F.col("action") == "confirm").alias("_confirm"))
        meet = (F.col(key) == F.col("_key")) & F.col("at_us").between(F.col("created_us"), F.col("created_us") + ttl_us)
        firsts = drafts.join(asked, meet, "left").groupBy(key, "created_us", "_new", "confirm_us", "discard_us").agg(
            F.min(F.when(F.col("_confirm"), F.col("at_us"))).alias("_c"), F.min(F.when(~F.col("_confirm"), F.col("at_us"))).alias("_d")
        )
        # A later request than the stored one changes nothing.
        sooner = [F.col(new) < F.coalesce(old, F.col(new) + 1) for new, old in (("_c", "confirm_us"), ("_d", "discard_us"))]
        changed = firsts.where(F.col("_new") | F.coalesce(sooner[0], F.lit(False)) | F.coalesce(sooner[1], F.lit(False)))
        changed.select(
            key, "created_us", F.least("confirm_us", "_c").alias("confirm_us"), F.least("discard_us", "_d").alias("discard_us"), stamp,
        ).write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")
        if (batch_id + 1) % FEW == 0:
            snapshot(batch_id, now)

    def snapshot(batch_id: int, now: int) -> None:
        """The last row of every draft and the requests that still wait for theirs."""
        start = batch_id // FEW * FEW
        rows = {name: stored(name, columns, start, batch_id, now) for name, columns in (("out", schema), ("events", asked_schema))}
        drafts = latest(rows["out"], key)
        waiting = rows["events"].where("action <> 'create'").join(drafts, key, "left_anti").groupBy(key, "at_us", "action").agg(F.max("changed_ms").alias("changed_ms"))
        for name, kept in (("out", drafts), ("events", waiting)):
            kept.write.mode("overwrite").parquet(f"{base}/kept/{name}/batch_id={batch_id}")

    run_batches(events, base, take)
    return latest(spark.read.schema(f"{schema}, batch_id long").parquet(f"{base}/out"), key)


def state_at(drafts: DataFrame, as_of: Column, ttl_hours: int = 24) -> DataFrame:
    """State of every draft at a moment, as the batch form gives it: what came later has not happened yet."""
    now = F.unix_micros(as_of)
    confirm, discard = (F.when(F.col(c) <= now, F.col(c)) for c in ("confirm_us", "discard_us"))
    state = (
        F.when(confirm <= F.coalesce(discard, confirm), "confirmed")
        .when(discard.isNotNull(), "discarded")
        .when(now > F.col("created_us") + ttl_hours * 3_600_000_000, "expired")
        .otherwise("open")
    )
    return drafts.withColumn("state", state)


def confirmed(drafts: DataFrame, key: str) -> DataFrame:
    """Drafts confirmed in time, once each, with the time of the first confirm."""
    return drafts.where("confirm_us IS NOT NULL").select(
        key, F.timestamp_micros("created_us").alias("created_at"), F.timestamp_micros("confirm_us").alias("confirmed_at")
    )


def expired(drafts: DataFrame, key: str, as_of: Column, ttl_hours: int = 24) -> DataFrame:
    """Drafts whose time to live is over at a moment, without a confirm in it."""
    over = F.unix_micros(as_of) >= F.col("created_us") + ttl_hours * 3_600_000_000
    return drafts.where(F.col("confirm_us").isNull() & over).select(key, F.timestamp_micros("created_us").alias("created_at"))


class SetCollector(StatefulProcessor):
    """Totals of an intake's files; a verdict once as many came as were announced.  A file index counts once."""

    def __init__(self, intake: str, keep_ms: int | None):
        self.out = Row(intake, "n_files", "total_bytes", "_body", "_first", "complete")
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "n long, size long, body long, first long, done boolean", self.keep_ms)
        self.seen = handle.getMapState("seen", "file_index long", "there boolean", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.total.get()
        n, size, body, first, done = (0, 0, 0, None, False) if known is None else tuple(known)
        announced, fresh = 0, set()
        for row in rows:
            announced = max(announced, row.n_announced)
            if row.file_index in fresh or (n and self.seen.containsKey((row.file_index,))):
                continue
            fresh.add(row.file_index)
            size, body = size + row.size_bytes, body + row.body
            if row.code is not None:
                first = row.code if first is None else min(first, row.code)
        complete = n + len(fresh) >= announced
        if not complete or n:
            for index in fresh:
                self.seen.updateValue((index,), (True,))
        n += len(fresh)
        if fresh:
            self.total.update((n, size, body, first, complete or done))
        if fresh or (complete and not done):
            yield self.out(key[0], n, size, body, first, complete)

    def close(self) -> None:
        pass


def admitted_sets(
    files: DataFrame, base: str, limits: Limits = Limits(), intake: str = "intake_no", keep_ms: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(verdicts, open sets) of the intakes seen so far.

    ``files`` has a column ``n_announced``, the number of files of the set.  A set that is not whole has no
    verdict; it is listed with what came so far, and ``judge_incomplete`` closes it when its time is up.
    """
    from chartloom.operators.admission import file_fault

    fault = file_fault(F.col("content_type"), F.col("size_bytes"), limits)
    code = F.when(fault == FAULTS[0], 0).when(fault == FAULTS[1], 1)
    rows = files.select(
        intake, F.col("file_index").cast("long").alias("file_index"), F.col("size_bytes").cast("long").alias("size_bytes"),
        (F.col("size_bytes") + F.octet_length("filename") + F.octet_length("content_type")).cast("long").alias("body"),
        (F.col("file_index") * 2 + code).cast("long").alias("code"), F.col("n_announced").cast("long").alias("n_announced"),
    )
    kind = dict(rows.dtypes)[intake]
    schema = f"{intake} {kind}, n_files long, total_bytes long, _body long, _first long, complete boolean"
    sums = latest(run_keyed(rows, intake, SetCollector(intake, keep_ms), schema, base), intake)
    return verdicts(sums.where("complete"), limits, intake), sums.where("NOT complete").select(intake, "n_files", "total_bytes")


def judge_incomplete(open_sets: DataFrame, intake: str = "intake_no") -> DataFrame:
    """Verdict of sets whose files did not all come in time."""
    return open_sets.select(
        intake, "n_files", "total_bytes", F.lit("incomplete").alias("reason"), F.lit(None).cast("long").alias("first_bad_index"), F.lit(False).alias("admitted"),
    )
