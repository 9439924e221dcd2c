"""Line dedup by windows of three consecutive lines, in DataFrame functions only.

Lines are the parts of a text between line feeds.  Every three consecutive lines with a word among
them form a window; windows overlap.  A window that occurs before, in the order of document id
and line, is a later occurrence, and its three lines go; lines covered by several such windows
go once.  Windows are compared by two 64-bit hashes of their lines.

A null text is an empty text for the counts and stays null.  Texts with fewer than three lines
have no window.  Rows without an id come first; rows with the same id are ordered by a hash of
their texts, and rows equal in both are one document listed twice with equal results.  Other columns pass unchanged, whatever their names, but for
``n_lines`` and ``n_removed``, which are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm.common import whole_text
from chartloom.operators.staging import join_splittable

WINDOW = 3
#: Fixed value: what is not a word.
BLANKS = " \t\n\x0b\x0c\r"


def windows(lines: Column) -> Column:
    """Array of (pos, w1, w2), one per window with a word."""
    hashed = F.transform(lines, lambda x: F.struct(
        F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), (F.btrim(x, F.lit(BLANKS)) != "").alias("word")
    ))

    def window(h: Column) -> Column:
        def one(i: Column) -> Column:
            three = [h[i + k] for k in range(WINDOW)]
            word = three[0]["word"] | three[1]["word"] | three[2]["word"]
            return F.struct(
                i.alias("pos"), F.xxhash64(*[x["a"] for x in three]).alias("w1"), F.xxhash64(*[x["b"] for x in three]).alias("w2"),
                word.alias("word"),
            )

        places = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.when(F.size(h) >= WINDOW, F.filter(F.transform(places, one), lambda w: w["word"]))

    # The hashes are computed once and handed to the lambda as a single element.
    return F.flatten(F.transform(F.array(hashed), lambda h: F.coalesce(window(h), F.expr("array()").cast(
        "array<struct<pos:int,w1:bigint,w2:bigint,word:boolean>>"
    ))))


def later_windows(docs: DataFrame) -> DataFrame:
    """_id, _th, starts: sorted first lines of all later occurrences, per document that has some."""
    found = (
        docs.select(F.col("doc_id").cast("long").alias("_id"), whole_text().alias("_text"))
        .select("_id", F.xxhash64("_text").alias("_th"), F.inline(windows(F.split("_text", "\n"))))
        .drop("word")
    )
    here = F.struct("_id", "_th", "pos")
    firsts = found.groupBy("w1", "w2").agg(F.min(here).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = join_splittable(found, firsts, ["w1", "w2"], "inner").where(here != F.col("first"))
    return later.groupBy("_id", "_th").agg(F.sort_array(F.collect_set("pos")).alias("starts"))


def kept_lines(lines: Column, starts: Column) -> Column:
    """Lines outside all windows at the sorted ``starts``; linear in both."""
    gaps = F.transform(F.sequence(F.lit(0), F.size(starts)), lambda i: F.struct(
        F.when(i == 0, 0).otherwise(F.get(starts, i - 1) + WINDOW).alias("begin"),
        F.coalesce(F.get(starts, i), F.size(lines)).alias("end"),
    ))
    filled = F.filter(gaps, lambda g: g["end"] > g["begin"])
    return F.flatten(F.transform(filled, lambda g: F.slice(lines, g["begin"] + 1, g["end"] - g["begin"])))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns with the text cut, and n_lines, n_removed; columns of these two names give way to them."""
    columns = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    # The caller's columns travel in one struct, so that none can clash with a name used here.
    rows = docs.select(
        F.struct(*columns).alias("_row"), F.col("text").alias("_whole"), F.col("doc_id").cast("long").alias("_key"), F.xxhash64(whole_text()).alias("_hash"),
    )
    joined = rows.join(later_windows(docs), F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_th")), "left")
    lines = F.split(whole_text("_whole"), "\n")
    cut = joined.select(
        "_row", "_whole", F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("starts").isNotNull(), kept_lines(lines, F.col("starts"))).alias("_kept"),
    )
    return cut.select(
        *[F.col("_row").getField(c).alias(c) for c in columns],
        F.when(F.col("_kept").isNull(), F.col("_whole")).otherwise(F.array_join("_kept", "\n")).alias("text"), "n_lines",
        F.when(F.col("_kept").isNull(), 0).otherwise(F.col("n_lines") - F.size("_kept")).cast("long").alias("n_removed"),
    )
