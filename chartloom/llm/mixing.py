"""Mixing to target weights with soft domain membership, in DataFrame functions only.

1. A naive Bayes classifier over binned features is learned from a labelled table (domain per
   document id): its tables have one row per feature and bin, whatever the input.
2. Each document gets posteriors p_k over the domains and a token count n.
3. Rates r >= 0 minimise the squared relative errors of the domains' expected tokens,
   sum over documents of r n p_k against the targets, by projected gradient steps in the metric of
   the token counts: r <- max(0, r - step * sum_k e_k p_k / T_k).  The errors e are those after the
   step (an implicit step), so its length is not bounded by the most common domain, and scarce
   domains meet their targets too; e solves a convex problem in as many unknowns as there are
   domains, by damped Newton steps.  Documents with equal bins have equal posteriors and thus equal
   rates, so each Newton step is one Spark aggregation over the distinct bin combinations with
   their tokens; the driver only sees sums per domain and pair of domains.  It ends when all
   errors are below TOLERANCE, or, where no rates meet the targets, at the least squares.

The targets are in proportion to ``weights`` and sized so that the domain with the largest weight
keeps its tokens: its documents have rates about 1, over-represented domains lower and scarce ones
higher rates.

Null and empty texts have no tokens, fall into the lowest bins and get a rate like others.  Rows without an id or with unknown
languages are scored too.  Labels with nulls are not learned from; several labels of one id each count.
Without labelled documents posteriors are equal; without tokens all rates are 1.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm.common import stage, whole_text
from chartloom.operators.staging import evaluate_once

DOMAINS = ("clean", "toxic", "junk")
WEIGHTS = {"clean": 0.88, "toxic": 0.06, "junk": 0.06}
#: Bins of each feature: values below the first border are bin 0.
BORDERS: dict[str, tuple[float, ...]] = {
    "symbols": (0.0005, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1),
    "shouts": (0.0005, 0.002, 0.005, 0.01, 0.02, 0.05),
    "capitals": (0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.3, 0.6),
    "variety": (0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8),
    "word_length": (2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 10.0),
    "marked": (0.5, 1.5, 2.5, 4.5),
    "words": (5.0, 20.0, 50.0, 100.0, 200.0, 500.0, 1000.0, 3000.0),
}
LANG_BINS = 16
#: Words of one domain looked for in every text, and labelled documents they are learned from.
MARKED_WORDS = 24
SAMPLE_DOCUMENTS = 4000
SMOOTHING = 0.5
#: Length of a gradient step, in units of the longest one that a plain (explicit) step could take.
STEP_LENGTH = 1e6
#: Largest relative error of a domain's expected tokens.
TOLERANCE = 1e-3
_SPACES = r"[\x20\x09-\x0D]+"


def domain_of(quality: Column, toxic: Column) -> Column:
    """Number of the domain in DOMAINS, null if a label is missing."""
    return F.when(quality == 0, 2).when((quality == 1) & (toxic == 1), 1).when((quality == 1) & (toxic == 0), 0)


def words_of(text: Column) -> Column:
    """Words without common punctuation, lower case."""
    return F.split(F.lower(text), r"[\x20\x09-\x0D.,;:!?]+")


def token_count(text: Column) -> Column:
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, _SPACES))).cast("long")


def _share(text: Column, characters: str) -> Column:
    """Share of the characters that are in a regular expression's character class."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")) / F.greatest(F.length(text), F.lit(1))


def _bin(value: Column, borders: tuple[float, ...]) -> Column:
    return sum((F.when(value >= b, 1).otherwise(0) for b in borders[1:]), F.when(value >= borders[0], 1).otherwise(0)).cast("int")


def with_bins(docs: DataFrame, marked: list[str]) -> DataFrame:
    """All columns, ``tokens`` and one bin per feature (``b_...``)."""
    text = whole_text()
    words, tokens = words_of(text), token_count(text)
    some = F.greatest(tokens, F.lit(1))
    value = {
        "symbols": _share(text, "#*$%&|<>"), "shouts": _share(text, "!"), "capitals": _share(text, "A-Z"),
        "variety": F.size(F.array_distinct(words)) / some, "word_length": F.length(text) / some,
        "marked": F.size(F.array_intersect(words, F.array(*map(F.lit, marked)))) if marked else F.lit(0), "words": tokens,
    }
    lang = F.coalesce(F.pmod(F.xxhash64("lang"), F.lit(LANG_BINS)), F.lit(0)).cast("int") if "lang" in docs.columns else F.lit(0)
    measured = evaluate_once(docs.select(
        *docs.columns, tokens.alias("tokens"), *[v.cast("double").alias(f"_{k}") for k, v in value.items()], lang.alias("b_lang")
    ))
    bins = [_bin(F.col(f"_{name}"), borders).alias(f"b_{name}") for name, borders in BORDERS.items()]
    return measured.select(*docs.columns, "tokens", *bins, "b_lang")


FEATURES = [*(f"b_{name}" for name in BORDERS), "b_lang"]


def _labelled(docs: DataFrame, labels: DataFrame, limit: int | None = None) -> DataFrame:
    marks = labels.select(
        F.col("doc_id").cast("long").alias("_id"), domain_of(F.col("quality"), F.col("toxic")).alias("domain")
    ).where("domain IS NOT NULL AND _id IS NOT NULL")
    if limit:
        marks = F.broadcast(marks.orderBy(F.xxhash64("_id"), "_id").limit(limit))  # short rows, at most ``limit``
    return docs.join(marks, docs.doc_id.cast("long") == marks._id)


def marked_words(docs: DataFrame, labels: DataFrame) -> list[str]:
    """Words that most set the second domain apart, from a bounded sample of labelled documents."""
    sample = _labelled(docs, labels, SAMPLE_DOCUMENTS)
    words = sample.select(F.col("domain").isin(1).alias("hit"), F.explode(F.array_distinct(words_of(whole_text()))).alias("word")).where("word <> ''")
    counts = words.groupBy("word").agg(F.count_if("hit").alias("in"), F.count_if(~F.col("hit")).alias("out"))
    scored = counts.where("in >= 5").withColumn("weight", F.col("in") * F.log((F.col("in") + 0.5) / (F.col("out") + 0.5)))
    return sorted(r["word"] for r in scored.where("in > out").orderBy(F.desc("weight"), "word").limit(MARKED_WORDS).collect())


def posterior_columns(binned_labelled: DataFrame) -> list[Column]:
    """Posterior of each domain as an expression over the bins."""
    prior = np.full(len(DOMAINS), SMOOTHING)
    table = {name: np.full((64, len(DOMAINS)), SMOOTHING) for name in FEATURES}
    # One row per domain, feature and bin.
    stacked = binned_labelled.select("domain", F.inline(F.array(*[
        F.struct(F.lit(name).alias("feature"), F.col(name).alias("bin")) for name in FEATURES
    ])))
    for row in stacked.groupBy("domain", "feature", "bin").agg(F.count("*").alias("n")).collect():
        table[row["feature"]][row["bin"], row["domain"]] += row["n"]
        if row["feature"] == FEATURES[0]:
            prior[row["domain"]] += row["n"]
    logs = []
    for k in range(len(DOMAINS)):
        total = F.lit(math.log(prior[k] / prior.sum()))
        for name in FEATURES:
            bins = LANG_BINS if name == "b_lang" else len(BORDERS[name[2:]]) + 1
            column = table[name][:bins, k]
            total = total + F.get(F.array(*[F.lit(float(math.log(x / column.sum()))) for x in column]), F.col(name))
        logs.append(total)
    most = F.greatest(*logs)
    parts = [F.exp(x - most) for x in logs]
    whole = sum(parts[1:], parts[0])
    return [p / whole for p in parts]


def _rate(p: list[Column], steps: list[list[float]], most: float = math.inf) -> Column:
    """The rate after all gradient steps so far, each projected onto 0 to ``most``."""
    if not steps:
        return F.lit(1.0)
    history = F.expr("array(" + ", ".join("array(" + ", ".join(f"{x!r}D" for x in e) + ")" for e in steps) + ")")
    return F.aggregate(history, F.lit(1.0), lambda r, e: F.least(F.lit(most), F.greatest(F.lit(0.0), r - sum((e[k] * p[k] for k in range(1, len(p))), e[0] * p[0]))))


def fit_rates(cells: DataFrame, weights: dict[str, float], most: float = math.inf) -> list[list[float]]:
    """Gradient steps over stored (tokens, p0, p1, ...) rows, for rates of at most ``most``."""
    p = [F.col(f"p{k}") for k in range(len(DOMAINS))]
    n = F.col("tokens").cast("double")
    pairs = [(i, j) for i in range(len(p)) for j in range(i, len(p))]
    first = cells.agg(*[F.sum(n * x) for x in p], *[F.sum(n * p[i] * p[j]) for i, j in pairs]).first()
    natural = np.array([x or 0.0 for x in first[: len(p)]])
    if not natural.sum():
        return []
    w = np.array([weights[d] for d in DOMAINS])
    target = np.maximum(w * natural[w.argmax()] / w.max(), 1.0)

    def square(sums) -> np.ndarray:
        gram = np.zeros((len(p), len(p)))
        for (i, j), x in zip(pairs, sums, strict=True):
            gram[i, j] = gram[j, i] = x / (target[i] * target[j])
        return gram

    damping = np.linalg.eigvalsh(square(first[len(p) :]))[-1] / STEP_LENGTH
    steps: list[list[float]] = []

    def measure(e: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Value and gradient of the convex function that the step minimises, and its curvature."""
        free = _rate(p, steps, most) - sum((float(x) * p[k] for k, x in enumerate(e / target)), F.lit(0.0))
        rows = cells.select(n.alias("n"), *p, free.alias("x")).where("x > 0").withColumn("r", F.least("x", F.lit(most)))
        m, r = F.col("n"), F.col("r")
        inside = F.when(F.col("x") < most, m)
        found = rows.agg(F.sum(m * r * (2 * F.col("x") - r)), *[F.sum(m * r * x) for x in p], *[F.sum(inside * p[i] * p[j]) for i, j in pairs]).first()
        found = [x or 0.0 for x in found]
        value = found[0] / 2 + e.sum() + damping / 2 * (e @ e)
        return value, 1 + damping * e - np.array(found[1 : 1 + len(p)]) / target, square(found[1 + len(p) :]) + damping * np.eye(len(p))

    error = (natural - target) / target
    while np.abs(error).max() >= TOLERANCE:
        e = np.zeros(len(p))
        value, slope, curve = measure(e)
        # Held tokens differ from those that the step asks for by ``slope``, relative to the targets.
        while np.abs(slope).max() >= TOLERANCE / 100:
            move, size = np.linalg.solve(curve, slope), 1.0
            tried = measure(e - move)
            while tried[0] > value - size * 1e-4 * (slope @ move) and size > 1e-9 and np.abs(tried[1]).max() >= TOLERANCE / 100:
                size /= 2
                tried = measure(e - size * move)
            if size <= 1e-9:  # nothing left but rounding
                break
            e, (value, slope, curve) = e - size * move, tried
        steps.append((e / target).tolist())
        last, error = error, damping * e - slope
        # Targets out of reach: a step as long as STEP_LENGTH plain ones no longer changes what is held.
        if np.abs(error - last).max() < TOLERANCE / 10:
            break
    return steps


@dataclass(frozen=True)
class Mix:
    """What is learned from a corpus: looked-for words, posteriors over the bins, gradient steps; and the binned rows."""

    marked: list[str]
    posteriors: list[Column]
    steps: list[list[float]]
    binned: DataFrame
    #: Largest rate.
    most: float

    def apply(self, rows: DataFrame) -> DataFrame:
        """Add posteriors and the rate to binned rows."""
        named = [f"p_{d}" for d in DOMAINS]
        # Posteriors are used once per step and domain below, so they are computed before.
        known = evaluate_once(rows.withColumns(dict(zip(named, self.posteriors, strict=True))))
        return known.withColumn("rate", _rate([F.col(n) for n in named], self.steps, self.most))


def learn(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, most: float = math.inf) -> Mix:
    short = docs.select(*[c for c in ("doc_id", "lang", "text") if c in docs.columns])
    marked = marked_words(short, labels)
    binned = stage(with_bins(short, marked).select(F.col("doc_id").cast("long"), "tokens", *FEATURES), "binned")
    p = posterior_columns(_labelled(binned, labels))
    cells = binned.groupBy(*FEATURES).agg(F.sum("tokens").alias("tokens"))
    cells = stage(cells.select("tokens", *[x.alias(f"p{k}") for k, x in enumerate(p)]), "cells")
    return Mix(marked, p, fit_rates(cells, weights, most), binned, most)


def document_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """doc_id, tokens, ``p_<domain>`` and rate of every row."""
    found = learn(docs, labels, weights)
    return found.apply(found.binned).select("doc_id", "tokens", *[f"p_{d}" for d in DOMAINS], "rate")


def thin(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """The rows of ``docs`` that their rate keeps, by a hash of their id.

    Rates are fitted between 0 and 1, as no copies are made: what is kept is what the fit expects.
    A scarce domain then stays below its target, as near as the least squares come.
    """
    found = learn(docs, labels, weights, 1.0)
    short = [c for c in ("doc_id", "lang", "text") if c in docs.columns]
    rows = found.apply(with_bins(docs.select(F.struct(*docs.columns).alias("_row"), *short), found.marked))
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(8)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return evaluate_once(rows.select("_row", (part < F.col("rate")).alias("_kept"))).where("_kept").select("_row.*")
