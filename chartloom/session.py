"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SEMANTIC_CONF = {
    # All timestamps are UTC instants.
    "spark.sql.session.timeZone": "UTC",
    # A repeated JSON key keeps its last value instead of failing the parse.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

#: The JVM compiles no method above 8,000 bytes, so a stage fused into a larger one would be interpreted row by row.
#: Such a stage runs operator by operator instead, each expression split into small methods.  Results do not depend on it.
SPEED_CONF = {"spark.sql.codegen.hugeMethodLimit": "8000"}

#: A batch on its way to Python is held outside the heap, and again in the worker, for every task at work; set where the
#: caller has set none.  Results do not depend on it.
BATCH_CONF = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options that results or compiled code depend on; sizing stays the caller's."""
    for key, value in (SEMANTIC_CONF | SPEED_CONF).items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    for key, value in BATCH_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "chartloom", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session; dots in option names are written as ``__``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SEMANTIC_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and intermediate tables.

    It is the one the cluster names in ``spark.checkpoint.dir``; where that is unset,
    a folder of the warehouse, which driver and executors share too.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
