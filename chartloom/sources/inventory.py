"""Object listings from an inventory table (key, size_bytes, …) instead of a listing in the driver.

An inventory is written in key order, so a prefix or a page is a range of keys that the Parquet statistics prune.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_inventory(objects: DataFrame, path: str) -> None:
    """Store an inventory in key order; objects with the same key stay apart."""
    objects.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(path)


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _after(prefix: str) -> str | None:
    """Smallest text above every text with the prefix, None if there is none."""
    kept = prefix.rstrip("\U0010ffff")
    if not kept:
        return None
    following = ord(kept[-1]) + 1
    return kept[:-1] + chr(0xE000 if 0xD800 <= following < 0xE000 else following)


def under_prefix(inventory: DataFrame, prefix: str) -> DataFrame:
    """Objects whose key starts with the prefix, as a key range."""
    end = _after(prefix)
    found = inventory.where(F.col("key") >= prefix)
    return found if end is None else found.where(F.col("key") < end)


def child_prefixes(inventory: DataFrame, prefix: str, delimiter: str = "/") -> DataFrame:
    """Distinct names directly below a prefix with their objects and bytes, as a delimiter listing gives them."""
    rest = F.substr("key", F.lit(len(prefix) + 1))
    name = F.substring_index(rest, delimiter, 1)
    below = under_prefix(inventory, prefix).where(F.contains(rest, F.lit(delimiter)))
    return below.groupBy(name.alias("name")).agg(F.count("*").alias("n_objects"), F.sum("size_bytes").alias("total_bytes"))


def next_page(inventory: DataFrame, prefix: str, after: str | None, size: int) -> DataFrame:
    """The next ``size`` objects of a listing in key order, after a key; keys are unique.

    The bound is a range filter, so a page reads only files that can hold it.
    """
    found = under_prefix(inventory, prefix)
    bound: Column = F.lit(True) if after is None else F.col("key") > after
    return found.where(bound).orderBy("key").limit(size)
