"""Ranked search in K2-treaps over the grid of terms and documents.

A task cuts its documents into blocks and orders each block's terms by falling document count (rows) and its
documents by id (columns).  The cells of the grid that hold a term's impact in a document are the leaves of a quadtree whose
empty quadrants are left out: one bit string, four bits a cell in breadth-first order, tells which quadrants there are, and
the number of ones up to a bit is the number of the cell below.  Each cell has the largest impact below it,
stored as the drop from the cell above, so that most drops are zero or small and compress well.

An item's terms each have a row.  The row paths go down together over the same range of columns: the weighted sum of
the cells' maxima bounds the score of every document of the range, and at a single column it is the score.  The
best ranges are opened first, a bunch at a time; a range goes when its bound can no longer enter the best
documents found so far, which a task keeps from block to block.  So results are exact.  Nothing is shuffled but the best documents of each task.

The impact of a term is (10^9 tf) div (1000 tf + 20 m) with m = 50 + (50 n N) div L; a term's weight is
floor(1000 ln((2 N + 2) / (2 df + 1))).  N, L and df are those of the whole table.

Terms are known by their 64-bit hash.  Null and blank texts have no term and are in no result.  Of equal scores the smaller
id comes first, rows without an id last; rows that share an id are ranked one by one.  Item rows with
the same id are one item with the terms of all; an item without terms has no result.  Empty tables give an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chartloom.llm.common import text_groups, whole_text, work_path
from chartloom.llm.words import LOWER, U64, Prefix

#: A block ends with the document that reaches one of these.
BLOCK_TERMS, BLOCK_DOCS = 1 << 19, 1 << 16
#: Ranges opened at a time.
BUNCH = 128
#: Terms of the items that one pass over the blocks looks for (about; items are dealt to passes by a hash).
PASS_TERMS = 1 << 18
SALTS = 64
_LAST = np.iinfo(np.int64).max

IS_TERM = np.zeros(256, bool)
IS_TERM[48:58] = IS_TERM[65:91] = IS_TERM[97:123] = IS_TERM[128:] = True


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes one after another, and the number of terms of each text."""
    data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], IS_TERM[data], [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate(([0], np.cumsum(length + 1)))
    return Prefix(data).of(start, end), np.diff(np.searchsorted(start, begin))


def spread(x: np.ndarray) -> np.ndarray:
    """Bits of numbers below 2^31 moved to the even places."""
    x = x.astype(U64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << U64(shift))) & U64(mask)
    return x


def packed(raw: bytes) -> bytes:
    """Compressed inside the row: a task gets all rows of its partition in one Arrow batch."""
    return zstandard.compress(raw, 1)


def small(x: np.ndarray) -> bytes:
    """Numbers from 0 on in the narrowest unsigned type that holds them."""
    return packed(x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes())


def wide(stored: bytes, n: int) -> np.ndarray:
    raw = zstandard.decompress(stored)
    return np.frombuffer(raw, f"u{len(raw) // n}").astype(np.int32)


#: Ones among the four bits of a cell, and ones before each quadrant's bit.
_ONES = np.array([x.bit_count() for x in range(16)], np.uint8)
_BEFORE = np.array([[(x >> (4 - q)).bit_count() for q in range(4)] for x in range(16)], np.int32)


@dataclass
class Treap:
    """Cells in breadth-first order: ``quadrants`` are the four bits of each, ``first`` the number of the first cell below it, ``top`` its largest impact."""

    height: int
    quadrants: np.ndarray
    first: np.ndarray
    top: np.ndarray

    @staticmethod
    def build(row: np.ndarray, column: np.ndarray, impact: np.ndarray) -> tuple[int, list[bytes]]:
        """Height, and for the root and each level below it the bits (but for the root) and drops."""
        side = int(max(row.max(initial=0), column.max(initial=0)))
        height = max(1, side.bit_length())
        code = spread(row) << U64(1) | spread(column)
        order = np.argsort(code)
        code, top = code[order], impact[order]
        levels = []
        for _ in range(height):
            above = code >> U64(2)
            first = np.flatnonzero(np.concatenate(([True], above[1:] != above[:-1])))
            group = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(code)]))))
            bits = np.zeros(4 * len(first), bool)
            bits[4 * group + (code & U64(3)).astype(np.int64)] = True
            most = np.maximum.reduceat(top, first)
            levels.append((packed(np.packbits(bits).tobytes()), small(most[group] - top)))
            code, top = above[first], most
        return height, [small(top), *(x for level in reversed(levels) for x in level)]

    @classmethod
    def load(cls, height: int, stored: list[bytes]) -> Treap:
        top, quadrants = [wide(stored[0], 1)], []
        for level in range(height):
            pairs = np.frombuffer(zstandard.decompress(stored[1 + 2 * level]), np.uint8)
            here = np.stack((pairs >> 4, pairs & 15), axis=1).ravel()[: len(top[-1])]
            above = np.repeat(top[-1], _ONES[here])
            quadrants.append(here)
            top.append(above - wide(stored[2 + 2 * level], len(above)))
        flat = np.concatenate(quadrants)
        first = np.cumsum(_ONES[flat], dtype=np.int32)
        first += 1 - _ONES[flat].astype(np.int32)
        return cls(height, flat, first, np.concatenate(top))

    def below(self, cell: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """Cell in a quadrant of each cell, -1 where there is none."""
        here = self.quadrants[np.maximum(cell, 0)]
        there = (cell >= 0) & (here >> (3 - quadrant) & 1 > 0)
        return np.where(there, self.first[np.maximum(cell, 0)] + _BEFORE[here, quadrant], -1)


class Best:
    """The best documents of one item so far: scores falling, of equal ones ids rising."""

    def __init__(self, most: int):
        self.most, self.score, self.key, self.known = most, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def may_enter(self, score: np.ndarray, key: np.ndarray) -> np.ndarray:
        if len(self.score) < self.most:
            return score > 0
        return (score > self.score[-1]) | ((score == self.score[-1]) & (key < self.key[-1]))

    def add(self, score: np.ndarray, key: np.ndarray, known: np.ndarray) -> None:
        score, key, known = (np.concatenate(x) for x in ((self.score, score), (self.key, key), (self.known, known)))
        order = np.lexsort((~known, key, -score))[: self.most]
        self.score, self.key, self.known = score[order], key[order], known[order]


def descend(treap: Treap, row: np.ndarray, weight: np.ndarray, key: np.ndarray, known: np.ndarray, best: Best) -> None:
    """Open the best ranges of columns first until none can enter the best documents.  ``key`` rises with the columns."""
    bound, level, column = np.array([int(treap.top[0]) * weight.sum()]), np.zeros(1, np.int64), np.zeros(1, np.int64)
    cell = np.zeros((1, len(row)), np.int64)
    bound = bound[best.may_enter(bound, key[:1])]
    side = np.arange(2)[None, :, None]
    while len(bound):
        order = np.lexsort((column << (treap.height - level), -bound))
        now, later = order[:BUNCH], order[BUNCH:]
        shift = treap.height - 1 - level[now]
        quadrant = (2 * (row[None] >> shift[:, None] & 1))[:, None, :] + side
        child = treap.below(np.broadcast_to(cell[now][:, None, :], quadrant.shape), quadrant).reshape(-1, len(row))
        score = np.where(child >= 0, treap.top[child], 0).astype(np.int64) @ weight
        at = (2 * column[now][:, None] + side[:, :, 0]).ravel()
        down = np.repeat(level[now] + 1, 2)
        alive = np.flatnonzero(score > 0)
        score, at, down, child = score[alive], at[alive], down[alive], child[alive]
        single = down == treap.height
        if single.any():
            best.add(score[single], key[at[single]], known[at[single]])
        rest = ~single
        bound, level, column, cell = (
            np.concatenate((x[later], y[rest])) for x, y in ((bound, score), (level, down), (column, at), (cell, child))
        )
        open_ = best.may_enter(bound, key[column << (treap.height - level)])
        bound, level, column, cell = bound[open_], level[open_], column[open_], cell[open_]


INDEX_SCHEMA = "height int, ids array<long>, terms binary, rows binary, holders binary, n_terms int, cells array<binary>"
_NAMES = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]


def block_row(ids: pa.Array, counts: np.ndarray, term: np.ndarray, n_docs: int, n_total: int) -> pa.RecordBatch | None:
    """The index of one block of documents, of which those without terms are left out."""
    held = np.flatnonzero(counts)
    if not len(held):
        return None
    key = ids.fill_null(_LAST).to_numpy(zero_copy_only=False)[held]
    known = ids.is_valid().to_numpy(zero_copy_only=False)[held]
    order = np.lexsort((~known, key))
    column = np.empty(len(held), np.int64)
    column[order] = np.arange(len(held))
    distinct, number = np.unique(term, return_inverse=True)
    pair, tf = np.unique(number.astype(np.int64) << 32 | np.repeat(column, counts[held]), return_counts=True)
    number, at = pair >> 32, pair & 0xFFFFFFFF
    holders = np.bincount(number, minlength=len(distinct))
    row = np.empty(len(distinct), np.int64)
    row[np.argsort(-holders, kind="stable")] = np.arange(len(distinct))
    n = counts[held][order].astype(object if n_docs * int(counts.max()) > _LAST // 50 else np.int64)
    m = (50 + 50 * n * n_docs // n_total).astype(np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[at])
    height, cells = Treap.build(row[number], at, impact)
    stored_ids = pa.array(key[order], mask=~known[order])
    return pa.RecordBatch.from_arrays([
        pa.array([height], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), stored_ids),
        pa.array([distinct.tobytes()]), pa.array([row.astype("<i4").tobytes()]), pa.array([holders.astype("<i4").tobytes()]),
        pa.array([len(distinct)], pa.int32()), pa.array([cells], pa.list_(pa.binary())),
    ], names=_NAMES)


def _texts(table: DataFrame, id_column: str) -> DataFrame:
    return table.select(F.col(id_column).cast("long").alias(id_column), whole_text().alias("text"))


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = 0
        for batch in batches:
            for _, texts in text_groups(batch):
                data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
                inside = IS_TERM[data]
                inside[1:] &= ~inside[:-1]
                ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
                counts = np.add.reduceat(inside.astype(np.int64), np.concatenate(([0], ends[:-1])))
                n_docs, n_terms = n_docs + int((counts > 0).sum()), n_terms + int(counts.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n_docs]), pa.array([n_terms])], names=["docs", "terms"])

    found = docs.select(whole_text().alias("text")).mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return found[0] or 0, found[1] or 0


def build_index(docs: DataFrame, n_docs: int, n_total: int) -> DataFrame:
    """One row per block, written below the shared folder and read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, found, size = [], [], [], 0

        def block() -> Iterator[pa.RecordBatch]:
            row = block_row(pa.concat_arrays(ids), np.concatenate(counts), np.concatenate(found), n_docs, n_total)
            if row is not None:
                yield row

        for batch in batches:
            for at, texts in text_groups(batch):
                term, n = terms(texts)
                ids.append(batch.column(0).slice(at, len(texts)))
                counts.append(n)
                found.append(term)
                size += len(term)
                if size >= BLOCK_TERMS or sum(map(len, ids)) >= BLOCK_DOCS:
                    yield from block()
                    ids, counts, found, size = [], [], [], 0
        if ids:
            yield from block()

    path = work_path(docs.sparkSession, "treap")
    _texts(docs, "doc_id").mapInArrow(run, INDEX_SCHEMA).write.parquet(path)
    return docs.sparkSession.read.schema(INDEX_SCHEMA).parquet(path)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms (distinct hashes) of the items that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_groups(batch):
                term, n = terms(texts)
                owner = np.repeat(np.arange(len(texts)), n)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(texts)).take(pa.array(owner)), pa.array(term.view(np.int64)),
                ], names=["item_id", "term"])

    single = _texts(items, "item_id").mapInArrow(run, "item_id long, term long").distinct()
    return single.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))


def holders(index: DataFrame, wanted: np.ndarray) -> dict[int, int]:
    """Documents that hold each wanted term; at most one row per wanted term comes back."""
    shared = index.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for raw, held in zip(batch.column(0), batch.column(1), strict=True):
                there, at = _rows_of(np.frombuffer(raw.as_py(), U64), shared.value)
                total[there] += np.frombuffer(held.as_py(), "<i4")[at[there]]
        some = total > 0
        yield pa.RecordBatch.from_arrays([pa.array(shared.value[some].view(np.int64)), pa.array(total[some])], names=["term", "n"])

    found = index.select("terms", "holders").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {row["term"]: row["n"] for row in found.collect()}


def _rows_of(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return known[at] == wanted, at


def search_blocks(index: DataFrame, items: list[tuple[int | None, np.ndarray, np.ndarray]], most: int) -> DataFrame:
    """item, doc_id, score, salt: the best documents of each item in each task.  Items are (id, terms, weights)."""
    shared = index.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(most) for _ in shared.value]
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                ids = one.column(1).flatten()
                key, known = ids.fill_null(_LAST).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
                have, rows = np.frombuffer(one.column(2)[0].as_py(), U64), np.frombuffer(one.column(3)[0].as_py(), "<i4").astype(np.int64)
                treap = Treap.load(one.column(0)[0].as_py(), one.column(4)[0].as_py())
                for (_, term, weight), found in zip(shared.value, best, strict=True):
                    there, at = _rows_of(have, term)
                    if there.any():
                        descend(treap, rows[at[there]], weight[there], key, known, found)
        salt = TaskContext.get().partitionId() % SALTS
        for (item, _, _), found in zip(shared.value, best, strict=True):
            n = len(found.score)
            yield pa.RecordBatch.from_arrays([
                pa.array([item] * n, pa.int64()), pa.array(found.key, mask=~found.known), pa.array(found.score), pa.array([salt] * n, pa.int32()),
            ], names=["item_id", "doc_id", "score", "salt"])

    columns = index.select("height", "ids", "terms", "rows", "cells")
    return columns.mapInArrow(run, "item_id long, doc_id long, score long, salt int")


def search(index: DataFrame, items: DataFrame, n_docs: int, most: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score of each item's best documents.

    Items are looked up in passes of about PASS_TERMS terms, which bounds what is collected and broadcast.
    """
    wanted = item_terms(items)
    total = wanted.agg(F.sum(F.size("terms"))).first()[0] or 0
    passes = math.ceil(total / PASS_TERMS)
    found = []
    for number in range(passes):
        some = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == number).collect()
        if not some:
            continue
        lists = [np.array(row["terms"], np.int64).view(U64) for row in some]
        df = holders(index, np.unique(np.concatenate(lists)))
        weights = [
            np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in term.view(np.int64).tolist()], np.int64)
            for term in lists
        ]
        found.append(search_blocks(index, [(row["item_id"], t, w) for row, t, w in zip(some, lists, weights, strict=True)], most))
    if not found:
        return index.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    # First within a part of the tasks, so that the last window sees a bounded number of rows an item.
    first = F.row_number().over(W.partitionBy("item_id", "salt").orderBy(*order))
    merged = reduce(DataFrame.union, found).withColumn("rank", first).where(F.col("rank") <= most).drop("rank")
    last = F.row_number().over(W.partitionBy("item_id").orderBy(*order))
    return merged.withColumn("rank", last).where(F.col("rank") <= most).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, most: int = 50) -> DataFrame:
    n_docs, n_total = totals(docs)
    return search(build_index(docs, n_docs, n_total), items, n_docs, most)
