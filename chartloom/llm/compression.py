"""Quality by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are built from passages of labelled documents.  A text is compressed
with both, passage by passage so that the dictionaries keep their weight in long texts.
The difference of the sizes, normalised by their sum, and how far the text shrinks at all
go into a logistic curve, fitted on labelled documents kept out of the dictionaries.

Training reads at most ``SAMPLE_DOCUMENTS`` documents per label, chosen by hash: a quarter
for the curve, weighted by the true counts of the labels, the others for at most
``SAMPLE_PASSAGES`` passages of ``PASSAGE_CHARS`` characters for each dictionary.  This bound is a
parameter of the fit; every document is scored as a whole.
With no labelled text of one kind all scores are the smoothed share of good labels.

Null and empty texts have a difference of 0 and get a score like others.  Rows without a label, with a null label or
without an id are not learned from; of several labels of one id each counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.common import fold, free_name, stage, text_groups, whole_text

PASSAGE_CHARS = 1500
SAMPLE_PASSAGES = 3000
SAMPLE_DOCUMENTS = 4000
DICTIONARY_BYTES = 112_640
LEVEL = 6
PASSAGE_BYTES = 1536


@dataclass(frozen=True)
class Model:
    """Dictionaries and the curve; about 0.2 MB, whatever the input."""

    good: bytes
    bad: bytes
    curve: tuple[float, ...] = ()


def _dictionary(passages: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, passages, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b"\n".join(passages)[-DICTIONARY_BYTES:]


@cache
def _compressors(good: bytes, bad: bytes):
    import zstandard

    return tuple(
        zstandard.ZstdCompressor(
            level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        for d in (good, bad)
    )


def sizes(text: bytes, good: bytes, bad: bytes) -> tuple[int, int, int]:
    """Compressed bytes with either dictionary, and the bytes of the text."""
    one, two = _compressors(good, bad)
    with_good = with_bad = 0
    for at in range(0, len(text), PASSAGE_BYTES):
        passage = text[at : at + PASSAGE_BYTES]
        with_good += len(one.compress(passage))
        with_bad += len(two.compress(passage))
    return with_good, with_bad, len(text)


def features(measured: np.ndarray) -> np.ndarray:
    """Columns of the curve from rows of ``sizes``.

    The normalised difference, the same difference in (logarithmic) bytes, how far the text
    shrinks, its length, and 1.  The first two are 0 for empty text.
    """
    good, bad, n = np.asarray(measured, float).reshape(-1, 3).T
    saved = bad - good
    return np.column_stack([
        100 * saved / np.maximum(1, good + bad), np.sign(saved) * np.log1p(np.abs(saved)),
        np.log((good + bad + 16) / (2 * n + 16)), np.log1p(n), np.ones(len(n)),
    ])


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method."""
    w, ridge = np.zeros(x.shape[1]), 1e-3
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def sample_labels(labels: DataFrame, folds: int) -> DataFrame:
    """Ids and labels that may be learned from: usable and not in the held-out fold."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good"))
    return marks.where(F.col("good").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != 0))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5) -> Model:
    marks = sample_labels(labels, folds)
    counts = {r["good"]: r["n"] for r in marks.groupBy("good").agg(F.count("*").alias("n")).collect()}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    by_hash = F.xxhash64("doc_id"), "doc_id"
    chosen = marks.where("good = 1").orderBy(*by_hash).limit(SAMPLE_DOCUMENTS).union(
        marks.where("good = 0").orderBy(*by_hash).limit(SAMPLE_DOCUMENTS)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    # At most twice SAMPLE_DOCUMENTS short rows are broadcast.
    rows = stage(
        texts.join(F.broadcast(chosen), "doc_id").withColumn("inner", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4))),
        "labelled",
    )
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text")), F.lit(PASSAGE_CHARS))
    passages: dict[int, list[bytes]] = {}
    for good in (1, 0):
        cut = (
            rows.where(f"good = {good} AND inner <> 0 AND text <> ''").select("doc_id", "text", F.explode(starts).alias("at"))
            .select(F.xxhash64("doc_id", "at").alias("h"), F.expr(f"substring(text, at, {PASSAGE_CHARS})").alias("passage"))
        )
        passages[good] = [r["passage"].encode() for r in cut.orderBy("h", "passage").limit(SAMPLE_PASSAGES).collect()]
    if not passages[0] or not passages[1]:
        return Model(b"", b"", (math.log(share / (1 - share)),))
    model = Model(_dictionary(passages[1]), _dictionary(passages[0]))
    seen = measure(rows.where("inner = 0"), model).select("sizes", "good").collect()
    x, y = features(np.array([r["sizes"] for r in seen])), np.array([r["good"] for r in seen], float)
    weight = np.where(y == 1, counts[1] / max(1, (y == 1).sum()), counts[0] / max(1, (y == 0).sum()))
    curve = fit_curve(x, y, weight * len(y) / max(1e-9, weight.sum()))
    return Model(model.good, model.bad, tuple(curve.tolist()))


def measure(docs: DataFrame, model: Model, score: str | None = None, sizes_as: str = "sizes") -> DataFrame:
    """All columns of ``docs``, the sizes of the text and, if named, the score of the curve."""
    fields = ", ".join(f"`{name}` {kind}" for name, kind in docs.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rows = [
                sizes(text, m.good, m.bad) if m.good else (0, 0, len(text))
                for _, texts in text_groups(batch) for text in texts
            ]
            columns = [*batch.columns, pa.array(rows, pa.list_(pa.int64()))]
            if score:
                x = features(np.array(rows))[:, -len(m.curve):]
                columns.append(pa.array(1 / (1 + np.exp(-np.clip(x @ np.array(m.curve), -30, 30)))))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, sizes_as, *[score] * bool(score)])

    return docs.mapInArrow(run, f"{fields}, `{sizes_as}` array<long>" + f", `{score}` double" * bool(score))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score, 0 to 1; a column that has the score's name already gives way to it."""
    docs = docs.drop(column)
    sizes_as = free_name(docs, "sizes")
    return measure(docs, model, column, sizes_as).drop(sizes_as)
