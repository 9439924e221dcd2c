"""What each of several filters removes, in every order of application, and its Shapley share.

Documents are judged once per filter; all else follows from how many documents of a part fail which set of filters.
Per part the removals of all coalitions of filters are tabulated (32 for five filters).  The Shapley shares
are the exact solution of a least squares problem over the coalitions, with the kernel weights

    (M - 1) / (C(M, s) s (M - s))   for coalitions of 0 < s < M filters

and the constraint that the shares sum to the removal of all filters together, solved in rationals.  The counts
of a step are differences of two coalitions: those before it and those with its filter.

A null text is an empty one and a null part the empty string.  Rows without an id are never copies of another row and no
other row is a copy of them; rows that share id and text are not copies of each other.  A document with several label rows counts as marked
if one of them marks it.  Null marks mark nothing.  An empty table has no part and gives no row.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm.common import stage, whole_text
from chartloom.operators.staging import join_splittable

LETTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITAL_PERCENT = 3
SYMBOLS = "[#$%&*|]"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACES = " \t\n\x0b\x0c\r"


def text_failures(text: Column) -> Column:
    """Bits 0 to 3: few words, few distinct words, many capitals, a symbol."""
    trimmed = F.btrim(text, F.lit(_SPACES))
    words, none = F.split(trimmed, r"[\x20\x09-\x0D]+"), (trimmed == "").cast("long")
    n, distinct = F.size(words).cast("long") - none, F.size(F.array_distinct(words)).cast("long") - none
    capitals = (F.length(text) - F.length(F.translate(text, _CAPITALS, ""))).cast("long")
    tests = (n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT_PERCENT * n, 100 * capitals > MOST_CAPITAL_PERCENT * F.length(text), text.rlike(SYMBOLS))
    return sum((test.cast("int") * (1 << bit) for bit, test in enumerate(tests)), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, failed (bits), good and toxic (0 or 1) of every document, texts compared table-wide."""
    text = whole_text()
    judged = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), text_failures(text).alias("failed"),
    )
    marks = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad"),
    )
    marked = join_splittable(judged, marks, ["doc_id"], "left")
    rows = stage(marked.select(
        "doc_id", "part", "digest", "failed", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("toxic"),
    ), "audit")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("doc_id").alias("n")).where("n > 1").drop("n")
    joined = join_splittable(rows, first, ["digest"], "left")
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << 4).otherwise(0)
    return joined.select("part", (F.col("failed") + copy).alias("failed"), "good", "toxic")


def coalition_table(failed: DataFrame, filters: int) -> DataFrame:
    """part, total, and arrays with one count per coalition: removed, good and toxic removed by at least one of its filters.

    Rows are first counted by what they fail, at most 2^filters rows a part and task, so that only those meet.
    """
    counts = failed.groupBy("part", "failed").agg(
        F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"), F.sum(F.col("toxic").cast("long")).alias("toxic"),
    )
    each = counts.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit((1 << filters) - 1))))
    hit = F.col("failed").bitwiseAND(F.col("coalition")) != 0
    removed = each.groupBy("part", "coalition").agg(
        F.sum("n").alias("total"), *[F.sum(F.when(hit, F.col(c)).otherwise(F.lit(0).cast("long"))).alias(c) for c in ("n", "good", "toxic")],
    )
    one = F.array_sort(F.collect_list(F.struct("coalition", "n", "good", "toxic")))
    table = removed.groupBy("part").agg(F.max("total").alias("total"), one.alias("c"))
    return table.select("part", "total", "c.n", "c.good", "c.toxic")


def shapley_shares(removed: list[int], filters: int) -> list[Fraction]:
    """Least squares over coalitions with kernel weights and efficiency as a constraint, by elimination in rationals."""
    if filters == 1:
        return [Fraction(removed[1] - removed[0])]
    system = [[Fraction(0)] * (filters + 2) for _ in range(filters + 1)]
    for coalition in range(1, (1 << filters) - 1):
        members = [i for i in range(filters) if coalition >> i & 1]
        size = len(members)
        weight = Fraction(filters - 1, comb(filters, size) * size * (filters - size))
        for i in members:
            for j in members:
                system[i][j] += weight
            system[i][-1] += weight * (removed[coalition] - removed[0])
    for i in range(filters):
        system[i][filters] = system[filters][i] = Fraction(1)
    system[filters][-1] = Fraction(removed[-1] - removed[0])
    for column in range(filters + 1):
        pivot = next(r for r in range(column, filters + 1) if system[r][column])
        system[column], system[pivot] = system[pivot], system[column]
        system[column] = [x / system[column][column] for x in system[column]]
        for r in range(filters + 1):
            if r != column and system[r][column]:
                factor = system[r][column]
                system[r] = [x - factor * y for x, y in zip(system[r], system[column], strict=True)]
    return [system[i][-1] for i in range(filters)]


STEP_SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def order_steps(total: int, n: list[int], good: list[int], toxic: list[int], letters: str) -> Iterator[tuple]:
    """Rows after the part of STEP_SCHEMA, for all orders of the filters."""
    filters, everything = len(letters), len(n) - 1
    shares = [share * factorial(filters) for share in shapley_shares(n, filters)]
    for order in permutations(range(filters)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = n[after] - n[before]
            yield (
                "".join(letters[k] for k in order), step, total - n[after], removed, n[1 << i] - removed, n[everything] - n[everything ^ 1 << i],
                good[after] - good[before], toxic[after] - toxic[before], int(shares[i]),
            )
            before = after


def audit_steps(failed: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order and step; ``failed`` has the columns that ``failures`` gives."""
    names = [c.split()[0] for c in STEP_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                steps = list(zip(*order_steps(row["total"], row["n"], row["good"], row["toxic"], letters), strict=True))
                kinds = [pa.string(), pa.int32(), *[pa.int64()] * 7]
                columns = [pa.array(values, kind) for values, kind in zip(steps, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(steps[0])), *columns], names=names)

    return coalition_table(failed, len(letters)).mapInArrow(run, STEP_SCHEMA)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit_steps(failures(docs, labels))
