"""Near-duplicate classes: BagMinHash bands, then exact comparison of the bags.

Bags are the runs of five words of a text with their counts; two documents are linked at a
weighted Jaccard similarity of 0.8 or more, and a class is a connected component of links.

1. Texts with the same words are one node, named by its smallest document id.
2. Nodes that agree in all registers of a band share a bucket.  Each is compared with the
   bucket's smallest node only, so a bucket of n texts costs n comparisons, never n * n.
3. Nodes that chains of links join need not meet.  In buckets that still hold several components, a
   node outside the component of the bucket's smallest one meets the others only if their profiles allow a
   link: the counts of the runs that a text shares with any other text in question, summed in 64 slots by hash.
   The overlap of two bags is at most the sum of the slots' smaller counts, so no link is lost; pairs that
   cannot be links are never emitted.
4. The first such meeting is with the bucket's 8 smallest outside nodes, which mostly joins the
   links among outside nodes to components before all others meet.

Comparisons stream through tasks by centre and salt, so a very large class is shared by
many tasks.  Nothing about all documents reaches the driver.

Texts without words (null, empty, blank) form one class among themselves.  A row without an
id takes the class of its words if a row with an id has the same ones, else its class is null.
Rows that share an id are one node: it is linked if one of their texts is.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chartloom.llm.bagminhash import bags, signatures, similarity
from chartloom.llm.common import stage, text_groups, whole_text
from chartloom.llm.words import U64, Documents, mix
from chartloom.operators.staging import join_splittable

THRESHOLD = 0.8
BANDS, ROWS = 30, 6
#: Parts of a class that are compared with its centre in different tasks.
SALTS = 32
#: Slots of a profile, and outside nodes of a bucket that are met first.
SLOTS, CENTERS = 64, 8


def _sequence_keys(docs: Documents, count: int) -> list[np.ndarray]:
    """Two 64-bit hashes of each document's words in order."""
    place = (np.arange(len(docs.doc)) - docs.first[docs.doc]).astype(U64)
    out = []
    for salt in (1, 2):
        terms = mix(docs.hash * U64(2 * salt + 1) + mix(place * U64(2) + U64(salt)))
        sums = np.concatenate((np.zeros(1, U64), np.cumsum(terms, dtype=U64)))
        out.append(mix(sums[docs.first[1:]] - sums[docs.first[:-1]] + docs.counts.astype(U64)).view(np.int64))
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))


def sketch(docs: DataFrame, n_bands: int = BANDS, n_rows: int = ROWS) -> DataFrame:
    """doc_id, two hashes of the words, and one hash per band (none for a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_groups(batch):
                group = Documents(texts)
                signature = signatures(*bags(group), len(texts), n_bands * n_rows).reshape(len(texts), n_bands, n_rows)
                key = np.broadcast_to(mix(np.arange(1, n_bands + 1).astype(U64)), (len(texts), n_bands))
                for k in range(n_rows):
                    key = mix(key * U64(3) + signature[:, :, k])
                with_words = group.counts > 0
                edges = np.concatenate(([0], np.cumsum(np.where(with_words, n_bands, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(texts)), *map(pa.array, _sequence_keys(group, len(texts))),
                    pa.ListArray.from_arrays(pa.array(edges), pa.array(key[with_words].ravel().view(np.int64))),
                ], names=["doc_id", "k1", "k2", "bands"])

    return _texts(docs).mapInArrow(run, "doc_id long, k1 long, k2 long, bands array<long>")


def compare(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Exact similarity of the texts of ``a`` and ``b`` for distinct pairs (a, b); b may be in very many."""
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int").alias("salt"))
    roles = salted.select(F.col("a").alias("doc_id"), "b", "salt", F.lit(1).alias("role")).union(
        salted.select(F.col("b").alias("doc_id"), "b", "salt", F.lit(0).alias("role")).distinct()
    )
    rows = _texts(docs).join(roles, "doc_id").repartition("b", "salt").sortWithinPartitions("b", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, held = None, []
        for batch in batches:
            for at, texts in text_groups(batch):
                part = batch.slice(at, len(texts))
                doc, key, count = bags(Documents(texts))
                edge = np.searchsorted(doc, np.arange(len(texts) + 1))
                ids, b, role = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "b", "role"))
                out: list[tuple[int, int, float]] = []
                for i in range(len(texts)):
                    bag = key[edge[i] : edge[i + 1]], count[edge[i] : edge[i + 1]]
                    if role[i] == 0:
                        held = held if center == b[i] else []
                        center = b[i]
                        held.append(bag)  # more than one only if rows share this id
                    else:
                        out.append((ids[i], b[i], max(similarity(bag, other) for other in held)))
                columns = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                    names=["a", "b", "similarity"],
                )

    found = rows.select("doc_id", "b", "salt", "role", "text").mapInArrow(run, "a long, b long, similarity double")
    return stage(found.groupBy("a", "b").agg(F.max("similarity").alias("similarity")), "compared")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of an edge list (a, b), by smallest labels and pointer jumps."""
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        seen = join_splittable(both, labels.select(F.col("node").alias("b"), "component"), ["b"], "inner")
        least = seen.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(least, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("component").alias("next"))
        moved = stage(join_splittable(step, jump, ["label"], "left").select("node", "old", F.least("label", "next").alias("component")), "labels")
        labels = moved.select("node", "component")
        if moved.where("component <> old").isEmpty():
            return labels


def _stars(buckets: DataFrame) -> DataFrame:
    """key, a, b: every node of a bucket of at least two with the bucket's smallest node."""
    centers = buckets.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b < most").drop("most")
    rows = join_splittable(buckets, centers, ["key"], "inner")
    return rows.where("node <> b").select("key", F.col("node").alias("a"), "b")


def profiles(texts: DataFrame) -> DataFrame:
    """node, n (runs in its bag), held (per slot: runs found in other nodes' texts too), shared (sum of held).

    Nodes with several texts have no row.  One row per run is shuffled, of the given texts only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, group in text_groups(batch):
                doc, key, count = bags(Documents(group))
                total = np.zeros((len(group), SLOTS), np.int32)
                np.add.at(total, (doc, (key % U64(SLOTS)).astype(np.int64)), count)
                edges = pa.array(np.searchsorted(doc, np.arange(len(group) + 1)).astype(np.int32))
                rows = pa.array(np.arange(0, total.size + 1, SLOTS, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(group)), pa.ListArray.from_arrays(rows, pa.array(total.ravel())),
                    pa.ListArray.from_arrays(edges, pa.array(key.view(np.int64))),
                    pa.ListArray.from_arrays(edges, pa.array(count.astype(np.int32))),
                ], names=["node", "total", "keys", "counts"])

    schema = "node long, total array<int>, keys array<long>, counts array<int>"
    listed = stage(texts.select("doc_id", "text").mapInArrow(run, schema), "bags")
    each = listed.select("node", F.explode(F.arrays_zip("keys", "counts")).alias("e")).select("node", "e.keys", "e.counts")
    alone = each.groupBy("keys").agg(F.min("node").alias("node"), F.max("node").alias("most"), F.sum("counts").alias("n")).where("node = most")
    slots = alone.groupBy("node", F.pmod("keys", F.lit(SLOTS)).cast("int").alias("slot")).agg(F.sum("n").cast("int").alias("n"))
    lost = slots.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("lost"))  # at most SLOTS entries
    single = listed.groupBy("node").agg(F.count("*").alias("texts"), F.first("total").alias("total")).where("texts = 1")
    held = F.transform("total", lambda x, i: x - F.coalesce(F.try_element_at("lost", i), F.lit(0)))
    return single.join(lost, "node", "left").select("node", _sum("total").alias("n"), held.alias("held")).withColumn("shared", _sum("held"))


def _sum(values: str | Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda total, x: total + x)


def _open_buckets(judged: DataFrame, linked: DataFrame) -> DataFrame:
    """key, node, b, component, outside: buckets with nodes that no chain of links joins to their smallest one (b)."""
    labels = components(linked)
    rows = judged.select("key", F.col("a").alias("node"), "b").join(labels, "node", "left")
    rows = rows.join(labels.select(F.col("node").alias("b"), F.col("component").alias("of_b")), "b", "left")
    rows = rows.select(
        "key", "node", "b", F.coalesce("component", "node").alias("component"),
        (F.coalesce("component", "node") != F.coalesce("of_b", "b")).alias("outside"),
    )
    return join_splittable(rows, rows.where("outside").select("key").distinct(), ["key"], "inner")


def _candidates(outside: DataFrame, others: DataFrame, threshold: float) -> DataFrame:
    """a, b: outside nodes and other nodes of their buckets that may be linked and are not joined yet."""
    names = ("node", "component", "outside", "n", "shared", "held")
    left = others.select("key", *[F.col(c).alias(f"l_{c}") for c in names])
    right = outside.select("key", *[F.col(c).alias(f"r_{c}") for c in names])
    least = threshold * (F.col("l_n") + F.col("r_n")) - 1e-6
    overlap = F.least("l_shared", "r_shared")
    finer = _sum(F.zip_with("l_held", "r_held", lambda x, y: F.least(x, y)))
    # A null, for nodes without a profile, allows the pair.
    possible = F.coalesce((overlap * (1 + threshold) >= least) & (finer * (1 + threshold) >= least), F.lit(True))
    met = join_splittable(left, right, ["key"], "inner").where((F.col("l_component") != F.col("r_component")) & possible)
    return met.select(F.greatest("l_node", "r_node").alias("a"), F.least("l_node", "r_node").alias("b")).distinct()


def links(docs: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, similarity of linked nodes, enough to give all classes.  ``nodes``: node, bands."""
    star = stage(_stars(nodes.select("node", F.explode("bands").alias("key")).distinct()), "stars")
    members = star.select(F.col("a").alias("doc_id")).union(star.select("b")).distinct()
    texts = stage(_texts(docs).join(members, "doc_id"), "texts")
    linked_when = F.col("similarity") >= threshold
    compared = compare(texts, star.select("a", "b").distinct())
    buckets = stage(_open_buckets(star, compared.where(linked_when)), "open")
    inside = buckets.select(F.col("node").alias("doc_id")).distinct()
    known = stage(profiles(texts.join(inside, "doc_id")), "profiles")
    # A node with too few runs in other texts has no links at all.
    rows = stage(join_splittable(buckets, known, ["node"], "left").where(F.coalesce(F.col("shared") >= threshold * F.col("n") - 1e-6, F.lit(True))), "profiled")
    order = W.partitionBy("key").orderBy("node")
    first = rows.where("outside").withColumn("place", F.row_number().over(order)).where(F.col("place") <= CENTERS)
    met = compare(texts, stage(_candidates(first, rows, threshold).join(compared, ["a", "b"], "left_anti"), "few"))
    compared = compared.union(met)
    still = _open_buckets(star, compared.where(linked_when)).drop("b")
    rows = join_splittable(rows.drop("b", "component", "outside"), still, ["key", "node"], "inner")
    rows = stage(rows, "profiled")
    pairs = _candidates(rows.where("outside"), rows, threshold).join(compared, ["a", "b"], "left_anti")
    return compared.union(compare(texts, stage(pairs, "rest"))).where(linked_when)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, copy_of (smallest id with the same words), class_id (smallest id of the class); one row per row."""
    sketches = stage(sketch(docs), "sketches")
    groups = stage(sketches.groupBy("k1", "k2").agg(F.min("doc_id").alias("copy_of")), "groups")
    named = groups.where("copy_of IS NOT NULL").withColumnRenamed("copy_of", "doc_id")
    nodes = stage(sketches.join(named, ["doc_id", "k1", "k2"]).select(F.col("doc_id").alias("node"), "bands"), "nodes")
    classes = components(links(docs, nodes, threshold))
    found = groups.join(classes, groups.copy_of == classes.node, "left").select(
        "k1", "k2", "copy_of", F.coalesce("component", "copy_of").alias("class_id")
    )
    return join_splittable(sketches.select("doc_id", "k1", "k2"), found, ["k1", "k2"], "inner").select("doc_id", "copy_of", "class_id")
