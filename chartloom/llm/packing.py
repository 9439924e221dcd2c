"""Best-fit packing of token pieces into sequences, large pieces matched first.

Only the number of pieces of each length matters for a packing, and there are at most
``capacity`` lengths.  The driver plans on this bounded histogram: pieces above a third of
the capacity meet at most two to a sequence, each with the largest partner that
fits, then shorter ones fill the tightest remaining gaps, longest first.  Sequences of
equal content are planned as one group, so the plan stays small however many pieces
there are.  Spark then gives each piece its rank within its length, and the rank its place.

Null texts are empty texts (one piece with the end id).  Rows with the same id are packed
one by one.  An empty table gives an empty result.  Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from chartloom.llm.common import stage, text_groups, whole_text
from chartloom.llm.orc_tokens import with_end
from chartloom.llm.tokens import encoder

CAPACITY = 4096
#: Parts of a length for ranking, so that a length with a third of all pieces is shared by many tasks.
SALTS = 1024

#: Sequences of one kind: how many, and (length, times) in the order of their places.
Group = tuple[int, tuple[tuple[int, int], ...]]


def _match_large(left: dict[int, int], capacity: int) -> list[Group]:
    """Pair the largest piece with the largest one that fits beside it, again and again."""
    groups: list[Group] = []
    order = sorted(left)
    while order:
        length = order[-1]
        n = left[length]
        i = bisect_left(order, capacity - length + 1) - 1
        if i < 0:
            groups.append((n, ((length, 1),)))
            order.pop()
            continue
        partner = order[i]
        if partner == length:
            pairs, rest = divmod(n, 2)
            if pairs:
                groups.append((pairs, ((length, 2),)))
            left[length] = rest
            if rest and len(order) > 1:
                # the odd one goes with the next smaller length
                other = order[-2]
                groups.append((1, ((length, 1), (other, 1))))
                left[other] -= 1
                left[length] = 0
            elif rest:
                groups.append((1, ((length, 1),)))
                left[length] = 0
        else:
            pairs = min(n, left[partner])
            groups.append((pairs, ((length, 1), (partner, 1))))
            left[length] -= pairs
            left[partner] -= pairs
        order = [x for x in order if left[x]] if not left[length] or not left[partner] else order
    return groups


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Group]:
    """Groups of equal sequences that hold every piece of the histogram once."""
    large = {length: n for length, n in histogram.items() if 3 * length > capacity and n}
    open_: dict[int, list[Group]] = {}
    gaps: list[int] = []

    def put(n: int, content: tuple[tuple[int, int], ...], gap: int) -> None:
        if n:
            if gap not in open_:
                insort(gaps, gap)
                open_[gap] = []
            open_[gap].append((n, content))

    for n, content in _match_large(large, capacity):
        put(n, content, capacity - sum(length * times for length, times in content))
    for length in sorted((x for x in histogram if 3 * x <= capacity), reverse=True):
        n = histogram[length]
        while n:
            i = bisect_left(gaps, length)
            if i == len(gaps):
                gap, count, content = capacity, n, ()
            else:
                gap = gaps[i]
                count, content = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap], gaps[i]
            times = gap // length
            whole = min(count, n // times)
            put(whole, (*content, (length, times)), gap - times * length)
            n -= whole * times
            rest = count - whole
            if not whole and n:
                put(1, (*content, (length, n)), gap - n * length)
                n, rest = 0, rest - 1
            elif content == () and n:
                put(1, ((length, n),), gap - n * length)
                n = 0
            if content:
                put(rest, content, gap)
    return [group for gap in gaps for group in open_[gap]]


def layout(groups: list[Group]) -> dict[str, np.ndarray]:
    """For each length and range of ranks: first sequence, pieces per sequence, offset of the first of them."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for n, content in groups:
        offset = 0
        for length, times in content:
            begin = taken.get(length, 0)
            rows.append((length, begin, sequence, times, offset))
            taken[length] = begin + n * times
            offset += length * times
        sequence += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "begin", "sequence", "times", "offset"), table.T, strict=True))


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Ids of each document with the end id, cut into pieces of at most ``capacity``."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_groups(batch):
                flat, borders = with_end(*encoder(tokenizer_path).encode(texts), end_id)
                sizes = np.diff(borders)
                parts = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(texts)), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(sizes[doc] - start, capacity)
                first = borders[doc] + start
                raw = flat.tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
                columns = [
                    batch.column(0).take(pa.array(doc + at)), pa.array(piece.astype(np.int32)), pa.array(start),
                    pa.array(length), pa.array(crc, pa.int64()),
                ]
                if with_ids:
                    edges = np.concatenate((first, borders[-1:])).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(flat.view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=names + ["ids"] * with_ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, schema)


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``.

    ``rows`` are read several times and should come from a stored table.
    """
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = layout(plan(histogram, capacity))  # bounded by the number of lengths, not of pieces
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    before = W.partitionBy("_length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        salted.groupBy(F.col("length").alias("_length"), F.col("_salt").alias("_part")).agg(F.count("*").alias("_n"))
        .select("_length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = W.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = (
        salted.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(offsets, (F.col("length") == F.col("_length")) & (F.col("_salt") == F.col("_part")))
        .select(*rows.columns, (F.col("_before") + F.col("_rank")).alias("_rank"))
    )
    added = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    schema = T.StructType([*rows.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "_rank"))
            key = (places["length"] << 44) + places["begin"]
            i = np.searchsorted(key, (length << 44) + rank, "right") - 1
            turn = rank - places["begin"][i]
            sequence = places["sequence"][i] + turn // places["times"][i]
            offset = places["offset"][i] + turn % places["times"][i] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=schema.names
            )

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    return pack(stage(pieces(docs, tokenizer_path, end_id, capacity, with_ids), "pieces"), capacity)
