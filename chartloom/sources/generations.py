"""Tables whose days (or months) are replaced as a whole: new files first, one small commit last.

Layout below a root:

    <root>/<table>/gen=<id>/day=<day>/…   row files; every write goes to a generation of its own
    <root>/_commits/commit=<n>/…          one file per commit: table, gen, day, replaces

A commit adds a generation to the live ones of a table and day, or replaces them.  Rows of a generation that no commit
names are not there for readers, so a job that dies before its commit leaves every earlier row in place
and can be run again.  One commit may name several tables; they change together.  Folders that are not live any
more go with ``purge``.  One writer at a time per root, and one period for all that is done with it.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.functions.ids import created_date_of
from chartloom.session import prepare

GEN, DAY = "gen", "day"
COMMITS = "_commits"
COMMIT_SCHEMA = "table string, gen string, day string, replaces boolean, commit long"


#: Date patterns of the folders: one per day, or one per month for tables with few rows a day.
DAILY, MONTHLY = "yyyyMMdd", "yyyyMM"


def day_of(key: Column, period: str = DAILY) -> Column:
    """Folder of the UTC day (or month) that an id carries; ids without one share a folder."""
    return F.coalesce(F.date_format(created_date_of(key), f"'d'{period}"), F.lit("none"))


def _read_or_none(read) -> DataFrame | None:
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def commits(spark: SparkSession, root: str) -> DataFrame:
    """All commits so far: one row per table, generation and day they name."""
    found = _read_or_none(lambda: prepare(spark).read.schema(COMMIT_SCHEMA).parquet(f"{root}/{COMMITS}"))
    return spark.createDataFrame([], COMMIT_SCHEMA) if found is None else found


def live(spark: SparkSession, root: str, table: str) -> DataFrame:
    """gen and day of the folders that hold the present rows of a table."""
    named = commits(spark, root).where(F.col("table") == table)
    last = named.groupBy(DAY).agg(F.max(F.when(F.col("replaces"), F.col("commit"))).alias("_last"))
    kept = named.join(last, DAY).where("gen IS NOT NULL AND commit >= coalesce(_last, 0)")
    return kept.select(GEN, DAY).distinct()


def read(spark: SparkSession, root: str, table: str, days: list[str] | None = None) -> DataFrame:
    """Present rows, of some days if given (these become partition filters)."""
    stored = prepare(spark).read.parquet(f"{root}/{table}")
    if days is not None:
        stored = stored.where(F.col(DAY).isin(days))
    # One short row per live folder: small enough for Spark to broadcast by its own limit, and to prune folders with.
    return stored.join(live(spark, root, table), [GEN, DAY], "left_semi").drop(GEN, DAY)


def present(spark: SparkSession, root: str, table: str, days: list[str] | None = None) -> DataFrame | None:
    """``read``, or None if the table was never written."""
    return _read_or_none(lambda: read(spark, root, table, days))


def add_generation(rows: DataFrame, root: str, table: str, key: str, period: str = DAILY) -> str:
    """Write rows to a generation of their own, which no reader sees before a commit names it."""
    gen = f"g{uuid.uuid4().hex}"
    # One shuffle by day keeps the number of files per folder low; AQE splits a day
    # that is much larger than the others.
    rows.withColumn(DAY, day_of(F.col(key), period)).hint("rebalance", DAY).write.partitionBy(DAY).parquet(f"{root}/{table}/gen={gen}")
    return gen


def written_days(spark: SparkSession, root: str, table: str, gen: str) -> list[str]:
    """Days a generation holds, from its folders; a few hundred per year at most."""
    found = _read_or_none(lambda: spark.read.parquet(f"{root}/{table}/gen={gen}"))
    return [] if found is None else [row[0] for row in found.select(DAY).distinct().collect()]


def switch(spark: SparkSession, root: str, changes: list[tuple[str, str | None, str, bool]]) -> None:
    """The commit: (table, generation or None, day, replaces) rows in one file, which appears at once or not at all."""
    if not changes:
        return
    last = commits(spark, root).agg(F.max("commit")).first()[0] or 0
    rows = spark.createDataFrame(changes, "table string, gen string, day string, replaces boolean")
    rows.coalesce(1).write.parquet(f"{root}/{COMMITS}/commit={last + 1}")


def _spool(rows: DataFrame, root: str) -> DataFrame:
    """Rows written below the root and read again, so that later steps do not compute them anew."""
    path = f"{root}/_incoming/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def newest(rows: DataFrame, keys: list[str], root: str) -> DataFrame:
    """Of the rows of a key the one with the highest ``version``, of equal versions the one with the largest text.

    A narrow count of key hashes finds the keys that come more than once (and others with the same hash); only their rows are
    written out as text and put in order.
    """
    names, digest = rows.columns, F.xxhash64(*keys)
    counted = rows.groupBy(digest.alias("_digest")).agg(F.count("*").alias("_n"))
    twice = _spool(counted.where("_n > 1").select("_digest"), root)
    if twice.isEmpty():
        return rows
    several = rows.join(twice, digest == twice["_digest"], "left_semi")
    best = several.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct("version", F.to_json(F.struct(*names)))).alias("_row"))
    picked = best.select(*[F.col(f"_row.{name}").alias(name) for name in names])
    return _spool(rows.join(twice, digest == twice["_digest"], "left_anti").unionByName(picked), root)


def upsert(spark: SparkSession, root: str, table: str, incoming: DataFrame, keys: list[str], period: str = DAILY) -> list[tuple[str, str | None, str, bool]]:
    """Write rows so that the highest ``version`` of each key stays; returns the changes to commit.

    ``incoming`` has a column ``version``.  Of equal versions the stored one stays, and of several in one call the one
    with the largest text, so the result depends on no order.  Days that only gain keys get one more generation; days in which a stored row
    is outdone are written anew.
    """
    names = incoming.columns
    rows = newest(_spool(incoming, root), keys, root).withColumn(DAY, day_of(F.col(keys[0]), period))
    days = [row[0] for row in rows.select(DAY).distinct().collect()]
    stored = present(spark, root, table, days)
    if stored is None:
        gen = add_generation(rows.drop(DAY), root, table, keys[0], period)
        return [(table, gen, day, False) for day in days]
    same = [F.col(f"n.{key}").eqNullSafe(F.col(f"s.{key}")) for key in keys]
    versions = stored.select(*keys, F.col("version").alias("_stored"))
    judged = rows.alias("n").join(versions.alias("s"), same, "left").select("n.*", "_stored")
    better = _spool(judged.where("_stored IS NULL OR version > _stored"), root)
    outdone = [row[0] for row in better.where("_stored IS NOT NULL").select(DAY).distinct().collect()]
    fresh = better.select(*names)
    if outdone:
        old = read(spark, root, table, outdone)
        over = fresh.select(*keys).alias("n")
        kept = old.alias("s").join(over, same, "left_anti")
        fresh = fresh.unionByName(kept.select("s.*"), allowMissingColumns=True)
    gen = add_generation(fresh, root, table, keys[0], period)
    return [(table, gen, day, day in outdone) for day in written_days(spark, root, table, gen)]


def without(spark: SparkSession, root: str, table: str, ids: DataFrame, key: str, period: str = DAILY) -> list[tuple[str, str | None, str, bool]]:
    """Write the days that hold one of the ids again without them; returns the changes to commit.

    Only calendar days reach the driver; as literals they become partition filters, so other days are not even listed.
    """
    wanted = ids.select(key).where(F.col(key).isNotNull()).distinct()
    days = [row[0] for row in wanted.select(day_of(F.col(key), period).alias(DAY)).distinct().collect()]
    stored = present(spark, root, table, days)
    if stored is None:
        return []
    hit = [row[0] for row in stored.join(wanted, key, "left_semi").select(day_of(F.col(key), period).alias(DAY)).distinct().collect()]
    if not hit:
        return []
    gen = add_generation(read(spark, root, table, hit).join(wanted, key, "left_anti"), root, table, key, period)
    left = set(written_days(spark, root, table, gen))
    return [(table, gen if day in left else None, day, True) for day in hit]


def purge(spark: SparkSession, root: str, tables: tuple[str, ...]) -> int:
    """Delete folders of days that are not live, left-overs of jobs that died and spooled input; not while a writer is at work.

    Looks at folder names only and returns how many folders went.
    """
    jvm = spark._jvm
    gone = 0
    for table in tables:
        kept = {(row[GEN], row[DAY]) for row in live(spark, root, table).collect()}
        base = jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
        store = base.getFileSystem(spark._jsc.hadoopConfiguration())
        for gen in store.listStatus(base) if store.exists(base) else ():
            if gen.getPath().getName().startswith(f"{GEN}="):
                days = [d.getPath() for d in store.listStatus(gen.getPath()) if d.isDirectory()]
                dead = [d for d in days if (gen.getPath().getName()[4:], d.getName()[4:]) not in kept]
                for path in dead if len(dead) < len(days) else [gen.getPath()]:
                    store.delete(path, True)
                gone += len(dead)
    spool = jvm.org.apache.hadoop.fs.Path(f"{root}/_incoming")
    store = spool.getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(spool, True)
    return gone
