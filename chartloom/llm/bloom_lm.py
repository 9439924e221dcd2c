"""Bigram language model in a log-frequency Bloom filter, with an exact unigram base.

Counts are quantised to powers of ``STEP`` and an n-gram of level q is in the filter as (n-gram, 1)
to (n-gram, q); its count is read back by probing levels until one is missing.  The filter is
cut into segments that are built in separate tasks; its size follows the corpus up to
``MAX_BITS``.  When more n-grams are seen than fit at ``BITS_PER_ENTRY``, the rarest counts stay
out of the filter, so that its error rate stays and the broadcast is bounded; they are looked
up in the written tables of counts by joins, so no cutoff changes a count.  A bigram that is neither in the filter nor in a
second one, of the bigrams left out that were seen twice or more, was seen once at most: exactly once where it stands in a
text that was learned from, so that most of what stayed out needs no join.

All bigrams are counted.  The ``HEAD_WORDS`` most frequent tokens (a parameter of the model) are broadcast
with exact counts and left mass, 6 MB, and have small numbers; a bigram of two of them is kept under these
numbers, others under a hash.  What other tokens need is asked for by joins of narrow distinct keys:

    p(b | a) = max(c'(a b) - D, 0) / c(a) + l(a) p(b),  p(b) = (c'(b) + 0.1) / (N' + 0.1 (V + 1))

with c' a count as the filter holds it and l(a) the mass that the discount leaves, so probabilities of
all tokens after a context sum to 1 but for the filter's false positives.  The base score uses exact counts: frequent tokens from
the broadcast table, all others through a join, which thereby meets no hot key.

Token hashes have 64 bits (63 for tokens that are not broadcast).  Null and empty texts are one end token.  Rows without an id are learned from
(they are in no held-out fold).  Repeated ids are scored row by row.  Other columns are ignored.
With nothing to learn from, N and V are 0 and every token has the same probability of 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm.common import fold, stage, text_groups, whole_text
from chartloom.llm.words import U64, Documents, mix

HEAD_WORDS = 1 << 18
STEP = 1.25
DISCOUNT = 0.75
BITS_PER_ENTRY = 12
PROBES = 8
SEGMENT_BITS = 1 << 18
MAX_BITS = 1 << 28
#: Tokens a task gathers before it passes on their counts.
FLUSH_TOKENS = 1 << 21

END, BEGIN = (mix(np.array([x], U64))[0] for x in (0xE0D, 0xBE61))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with an end per document, the token before each, and borders of documents."""
    docs = Documents(texts, lower=True)
    borders = docs.first + np.arange(len(texts) + 1)
    out = np.full(borders[-1], END, U64)
    out[np.arange(len(docs.hash)) + docs.doc] = docs.hash
    before = np.concatenate((out[:1], out[:-1]))
    before[borders[:-1]] = BEGIN
    return out, before, borders


#: Bits of a frequent token's number; ``HEAD_WORDS`` stays below the number that marks the begin of a text.
PLACE_BITS = 20
BEGIN_PLACE = (1 << PLACE_BITS) - 1
#: Codes of tokens and bigrams that are hashes have this bit, so they are negative as signed values.
HASHED = U64(1 << 63)


def bigram_code(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Bigram of two codes: both numbers where both are frequent, otherwise a hash."""
    return np.where((before | token) < HASHED, before << U64(PLACE_BITS) | token, mix(before * U64(3) + token + U64(0xB16)) | HASHED)


def bigram_key(code: np.ndarray) -> np.ndarray:
    """What the filter holds for a bigram."""
    return mix(code + U64(0xB16A))


def _raw_level(n: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(n, 1)) / math.log(STEP) + 1e-9).astype(np.int64)


#: Powers that start a level: only those with a whole number before the next one (2, 3 and 6 have none at a step of 1.25).
EMPTY = sorted(set(range(1, 16)) - set(_raw_level(np.arange(1, 64)).tolist()))
RAW = np.setdiff1d(np.arange(1, 256), EMPTY)


def level_of(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(RAW, _raw_level(n)) + 1


def level_sql(n: str) -> Column:
    raw = F.lit(1) + F.floor(F.log(n) / F.lit(math.log(STEP)) + F.lit(1e-9))
    return sum((-(raw >= F.lit(e)).cast("int") for e in EMPTY), raw).cast("int")


def count_at(level: np.ndarray) -> np.ndarray:
    """Smallest count of a level, 0 for level 0."""
    return np.where(level > 0, STEP ** (RAW[np.maximum(level, 1) - 1] - 1.0), 0.0)


def first_probe(key: np.ndarray, level: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of (key, level): the first probe and the step to the next one (double hashing)."""
    x = mix(key + mix(np.atleast_1d(level).astype(U64)))
    return x, (x >> U64(32)) | U64(1)


def probes(key: np.ndarray, level: int | np.ndarray) -> Iterator[np.ndarray]:
    """Places inside its segment of each probe for (key, level)."""
    x, step = first_probe(key, level)
    for _ in range(PROBES):
        yield x & U64(SEGMENT_BITS - 1)
        x = x + step


class LogFrequencyFilter:
    """Segments of bits; n-grams go to segments by the upper bits of their hash."""

    def __init__(self, segments: np.ndarray):
        self.segments = segments.reshape(-1)
        self.count = len(segments)

    def levels(self, key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), np.int64)
        base = ((key >> U64(33)) % U64(self.count)).astype(np.int64) * (SEGMENT_BITS // 8)
        left, level = np.arange(len(key)), 0
        while len(left):
            level += 1
            left = left[self._holds(base[left], key[left], level)]
            out[left] = level
        return out

    def _holds(self, start: np.ndarray, key: np.ndarray, level: int) -> np.ndarray:
        """Which keys all probes of a level find; most others are given up after the first few."""
        x, step = first_probe(key, level)
        here, found = np.arange(len(key)), np.ones(len(key), bool)
        for number in range(PROBES):
            at = x & U64(SEGMENT_BITS - 1)
            byte = self.segments[start + (at >> U64(3)).astype(np.int64)]
            found &= (byte >> (at & U64(7)).astype(np.uint8)) & 1 != 0
            if number in (0, 2) and 4 * np.count_nonzero(found) < 3 * len(found):
                here, start, x, step = here[found], start[found], x[found], step[found]
                found = np.ones(len(here), bool)
            x = x + step
        return here[found]


def segment_bytes(key: np.ndarray, level: np.ndarray) -> bytes:
    """One segment that holds all levels of its n-grams."""
    bits = np.zeros(SEGMENT_BITS, bool)
    who = np.repeat(np.arange(len(key)), level)
    each = np.arange(len(who)) - np.repeat(np.cumsum(level) - level, level) + 1
    for at in probes(key[who], each):
        bits[at.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


@dataclass(frozen=True)
class Model:
    """Bounded by HEAD_WORDS and MAX_BITS."""

    total: int
    distinct: int
    smoothed_total: float
    head: np.ndarray
    head_count: np.ndarray
    left_mass: np.ndarray
    #: Least counts of unigrams and bigrams in the filter.
    least: tuple[int, int]
    begin_count: int
    begin_left: float
    segments: np.ndarray
    #: Levels of the head as the filter gives them, probed once.
    head_level: np.ndarray
    #: Filter of the bigrams seen twice or more that are not in the other one.
    several: np.ndarray

    def place(self, token: np.ndarray) -> np.ndarray:
        """Index in the sorted head, -1 for other tokens."""
        return place_in(self.head, token)


def place_in(head: np.ndarray, token: np.ndarray) -> np.ndarray:
    if not len(head):
        return np.full(len(token), -1)
    i = np.minimum(np.searchsorted(head, token), len(head) - 1)
    return np.where(head[i] == token, i, -1)


def codes(place: np.ndarray, token: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of tokens and of the tokens before them: numbers of frequent ones, otherwise the hash."""
    code = np.where(place >= 0, place.astype(U64), token | HASHED)
    before = np.concatenate((code[:1], code[:-1]))
    before[start] = BEGIN_PLACE
    return code, before


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct value, smallest first, one place and how often it occurs; and the order that sorts the values."""
    order = np.argsort(values)
    ranked = values[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(ranked)), bool), ranked[1:] != ranked[:-1])))
    return order[first], np.diff(np.concatenate((first, [len(ranked)]))), order


def _counted(docs: DataFrame, columns: str, gather) -> DataFrame:
    """Counts of what ``gather`` (texts to arrays of 64-bit values) finds, summed in each task before the shuffle."""
    names = [c.split()[0] for c in columns.split(", ")]

    def rows(parts: list[np.ndarray]) -> pa.RecordBatch:
        table = np.concatenate(parts, axis=1)
        one, n, _ = runs(table[0])
        return pa.RecordBatch.from_arrays([*(pa.array(c[one].view(np.int64)) for c in table), pa.array(n)], names=[*names, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for _, texts in text_groups(batch):
                parts.append(gather(texts))
                size += parts[-1].shape[1]
                if size >= FLUSH_TOKENS:
                    yield rows(parts)
                    parts, size = [], 0
        if parts:
            yield rows(parts)

    found = docs.select("text").mapInArrow(run, f"{columns}, n long")
    return found.groupBy(*names).agg(F.sum("n").alias("n"))


def _cutoffs(histogram: list[tuple[int, int, int]]) -> tuple[int, int]:
    """Least counts of unigrams and bigrams with which all levels fit; (kind, count, how many)."""
    one, two = 1, 1
    while True:
        entries = sum(
            int(level_of(np.array([n]))[0]) * times for kind, n, times in histogram if n >= (one if kind == 1 else two)
        )
        if entries * BITS_PER_ENTRY <= MAX_BITS or not histogram:
            return one, two
        one, two = (one, two + 1) if two <= 2 * one else (one + 1, two)


def quantised(n: Column) -> Column:
    """Smallest count of the level of a count."""
    return F.pow(F.lit(STEP), F.floor(F.log(n) / F.lit(math.log(STEP)) + F.lit(1e-9)))


def filter_of(held: DataFrame, entries: int) -> np.ndarray:
    """Segments with all levels of (kind, key, level); kind 1 is a token, 2 a bigram's code.  At most ``MAX_BITS``."""
    segments = max(1, math.ceil(min(entries * BITS_PER_ENTRY, MAX_BITS) / SEGMENT_BITS))

    def place_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, key = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(U64)
            key = np.where(kind == 1, key, bigram_key(key))
            segment = ((key >> U64(33)) % U64(segments)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(segment), pa.array(key.view(np.int64)), batch.column(2)], names=["segment", "key", "level"])

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        bits = segment_bytes(rows["key"].to_numpy(np.int64).view(U64), rows["level"].to_numpy(np.int64))
        return pd.DataFrame({"segment": [rows["segment"].iloc[0]], "bits": [bits]})

    built = held.mapInArrow(place_keys, "segment int, key long, level int").groupBy("segment").applyInPandas(build, "segment int, bits binary")
    table = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
    for row in built.collect():
        table[row["segment"]] = np.frombuffer(row["bits"], np.uint8)
    return table


def that_may_match(table: DataFrame, asked: DataFrame, model: Broadcast) -> DataFrame:
    """Rows (key, n) of bigrams that can answer a question; ``asked`` are the keys that texts not learned from ask for.

    Texts learned from ask only for what the model's filter of bigrams seen several times lets through.  Only a saving before
    the join: with more keys than ``MAX_BITS`` suits more rows pass, and none that is asked for is dropped.
    """
    keys = asked.select(F.lit(2).alias("kind"), "key", F.lit(1).alias("level"))
    shared = table.sparkSession.sparkContext.broadcast(filter_of(keys, asked.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [LogFrequencyFilter(segments) for segments in (model.value.several, shared.value)]
        for batch in batches:
            key, wanted = bigram_key(batch.column(0).to_numpy().view(U64)), batch.column(1).to_numpy() > 1
            for held in filters:
                left = np.flatnonzero(~wanted)
                wanted[left] = held.levels(key[left]) > 0
            yield batch.filter(pa.array(wanted))

    return table.select("key", "n").mapInArrow(run, "key long, n long")


def fit(docs: DataFrame, folds: int) -> tuple[Model, tuple[DataFrame, DataFrame]]:
    """The model; (key, n, left), count and mass left after each token that is not broadcast; (key, n), bigrams that are not in the filter."""
    training = docs.where(fold("doc_id", folds) != 0).select(whole_text().alias("text"))
    unigrams = stage(_counted(training, "key long", lambda texts: tokens(texts)[0][None]), "unigrams")
    facts = unigrams.agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum(quantised(F.col("n"))).alias("smoothed")).first()
    top = unigrams.orderBy(F.desc("n"), "key").limit(HEAD_WORDS).toArrow()
    head, head_count = np.array(top["key"], np.int64).view(U64), np.array(top["n"], np.int64)
    # The head is a range in the order of (count, key), and so is the rest.
    rest = F.lit(True)
    if len(head):
        last, least = int(head[-1].view(np.int64)), int(head_count[-1])
        rest = (F.col("n") < least) | ((F.col("n") == least) & (F.col("key") > last))
    order = np.argsort(head)
    head, head_count = head[order], head_count[order]
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def pairs(texts: list[bytes]) -> np.ndarray:
        token, before, _ = tokens(texts)
        code, ahead = codes(place_in(shared.value, token), token, before == BEGIN)
        pair = bigram_code(ahead, code)
        return np.stack([pair, np.where(pair < HASHED, U64(0), ahead)])

    # The token before is written only where the bigram's code does not tell it.
    bigrams = stage(_counted(training, "key long, before long", pairs), "bigrams", "zstd")
    both = unigrams.select(F.lit(1).alias("kind"), "key", "n").union(bigrams.select(F.lit(2), "key", "n"))
    # Counts above the limit of this histogram are all kept by any cutoff that can be needed.
    histogram = both.groupBy("kind", F.least("n", F.lit(10_000)).alias("count")).agg(F.count("*").alias("times"))
    sizes = [tuple(r) for r in histogram.collect()]
    one, two = _cutoffs(sizes)
    held = both.where(F.when(F.col("kind") == 1, F.col("n") >= one).otherwise(F.col("n") >= two)).select("kind", "key", level_sql("n").alias("level"))
    entries = held.agg(F.sum("level")).first()[0] or 0
    table = filter_of(held, entries)
    again = bigrams.where((F.col("n") > 1) & (F.col("n") < two)).select(F.lit(2).alias("kind"), "key", F.lit(1).alias("level"))
    several = filter_of(again, sum(times for kind, n, times in sizes if kind == 2 and 1 < n < two))
    context = F.when(F.col("key") >= 0, F.shiftright("key", PLACE_BITS)).otherwise(F.col("before"))
    kept = F.greatest(quantised(F.col("n")) - F.lit(DISCOUNT), F.lit(0.0))
    used = stage(bigrams.groupBy(context.alias("key")).agg(F.sum(kept).alias("used")), "used")
    begins, begin_used, head_used = training.count(), 0.0, np.zeros(len(head))
    frequent = used.where("key >= 0").toArrow()  # at most one row for each broadcast token, and the begin
    places, sums = np.array(frequent["key"], np.int64), np.array(frequent["used"], float)
    head_used[places[places != BEGIN_PLACE]] = sums[places != BEGIN_PLACE]
    begin_used = float(sums[places == BEGIN_PLACE].sum())
    code = F.col("key").bitwiseOR(F.lit(-(1 << 63)))
    left = (F.lit(1.0) - F.coalesce("used", F.lit(0.0)) / F.col("n")).alias("left")
    words = stage(
        unigrams.where(rest).select(code.alias("key"), "n").join(used.where("key < 0"), "key", "left").select("key", "n", left), "words"
    )
    level = LogFrequencyFilter(table).levels(head)
    if one > 1:
        level = np.where(level > 0, level, level_of(head_count))
    model = Model(
        facts["total"] or 0, facts["distinct"], facts["smoothed"] or 0.0, head, head_count, 1 - head_used / np.maximum(1, head_count),
        (one, two), begins, 1 - begin_used / max(1, begins), table, level, several,
    )
    return model, (words, bigrams.where(F.col("n") < two).select("key", "n"))


#: Tokens left open, as lists side by side: codes of the token and the one before it, the bigram's level (``ASK`` where its
#: count has to be asked for), and ``wait`` if their part of the score is missing.  A token that is not broadcast always
#: lacks its part of the base.  Where both are broadcast, only the bigram's code is kept (``ask``): it tells all but the count.
OPEN = {"token": pa.int64(), "before": pa.int64(), "level": pa.int16(), "wait": pa.bool_()}
OPEN_SQL = "token array<long>, before array<long>, level array<smallint>, wait array<boolean>"
ASK = -1


def own_counts(key: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """How often each place's key occurs in its own document."""
    doc = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    distinct, place = np.unique(key, return_inverse=True)
    _, size, order = runs(doc * len(distinct) + place)
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(size, size)
    return out


def smoothed(seen: np.ndarray, mass: np.ndarray, alone: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Probability of a token from its context's count and left mass, its own probability and its bigram's level."""
    pair = np.maximum(count_at(level) - DISCOUNT, 0)
    return np.where(seen > 0, mass * alone + pair / np.maximum(seen, 1), alone)


def common_parts(model: Model, key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What a count adds to the score of a bigram of two broadcast tokens, over that of one never seen."""
    before, token = key >> PLACE_BITS, key & BEGIN_PLACE
    begin = before == BEGIN_PLACE
    at = np.where(begin, 0, before)
    seen = np.where(begin, model.begin_count, model.head_count[at])
    mass = np.where(begin, model.begin_left, model.left_mass[at])
    alone = (count_at(model.head_level[token]) + 0.1) / (model.smoothed_total + 0.1 * (model.distinct + 1))
    with_, without = (np.log10(np.minimum(smoothed(seen, mass, alone, level), 1.0)) for level in (level_of(n), np.zeros(len(n), np.int64)))
    return with_ - without


def finish(model: Model, token: np.ndarray, before: np.ndarray, level: np.ndarray, words: tuple, pairs: tuple) -> tuple:
    """Of open tokens: whether each lacks its part of the base, whether it was seen, that part, and the score's part.

    ``words`` (codes, counts, left masses) and ``pairs`` (codes, counts) are the answers for at least these tokens; what has none was never seen.
    """
    def answered(codes_: np.ndarray, asked: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
        known, one = np.unique(codes_, return_index=True)
        at = place_in(known, asked)
        return [np.where(at >= 0, v[one][at] if len(known) else 0, 0) for v in values]

    def counts(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether codes are broadcast, their counts and left masses."""
        common = (code >= 0) & (code != BEGIN_PLACE)
        at = np.where(common, code, 0)
        n, left = answered(words[0], code, words[1], words[2])
        if len(model.head):
            n, left = np.where(common, model.head_count[at], n), np.where(common, model.left_mass[at], left)
        n, left = np.where(code == BEGIN_PLACE, model.begin_count, n), np.where(code == BEGIN_PLACE, model.begin_left, left)
        return common, n, left

    common, own, _ = counts(token)
    quantum = count_at(np.where(own > 0, level_of(own), 0))
    if len(model.head):
        quantum = np.where(common, count_at(model.head_level[np.where(common, token, 0)]), quantum)
    alone = (quantum + 0.1) / (model.smoothed_total + 0.1 * (model.distinct + 1))
    _, seen, mass = counts(before)
    level, open_ = level.astype(np.int64), np.flatnonzero(level == ASK)
    code = bigram_code(before[open_].view(U64), token[open_].view(U64))
    (n,) = answered(pairs[0], code.view(np.int64), pairs[1])
    level[open_] = np.where(n > 0, level_of(n), 0)
    p = smoothed(seen, mass, alone, level)
    base = np.log10((own + 0.1) / (model.total + 0.1 * (model.distinct + 1)))
    return ~common, ~common & (own > 0), np.where(common, 0.0, base), np.log10(np.minimum(p, 1.0))


def score_texts(model: Model, texts: list[bytes], learned: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """``learned`` marks documents that the counts were taken from: a bigram that such a text holds n times has a count of at
    least n, and one that is not in the filter a count below the cutoff, so where the two meet no join is needed; nor where
    it is not among those seen several times, as it then stands there alone.  Per document: tokens, known frequent ones, their part of the base, the model's score; and the tokens left open (``OPEN``, ``ask``)."""
    token, before, borders = tokens(texts)
    filter_ = LogFrequencyFilter(model.segments)
    distinct, inverse = np.unique(token, return_inverse=True)
    known = model.place(distinct)
    place = known[inverse]
    exact = np.where(place >= 0, model.head_count[place] if len(model.head) else 0, 0)
    base = np.log10((exact + 0.1) / (model.total + 0.1 * (model.distinct + 1)))
    level = np.zeros(len(distinct), np.int64)
    level[known >= 0] = model.head_level[known[known >= 0]]
    level[known < 0] = filter_.levels(distinct[known < 0])
    alone = ((count_at(level) + 0.1) / (model.smoothed_total + 0.1 * (model.distinct + 1)))[inverse]
    # Without cutoffs, what the filter does not have was not seen.
    no_alone = (level == 0)[inverse] & (model.least[0] > 1)
    context = np.concatenate(([-1], place[:-1]))
    start = before == BEGIN
    context[start] = -1
    unseen = ((level == 0) & (known < 0))[inverse] & (model.least[0] == 1)
    no_context = ~start & (context < 0) & ~np.concatenate(([False], unseen[:-1]))
    seen, mass = np.zeros(len(token)), np.ones(len(token))
    seen[start], mass[start] = model.begin_count, model.begin_left if model.begin_count else 1.0
    at = np.flatnonzero(context >= 0)
    seen[at], mass[at] = model.head_count[context[at]], model.left_mass[context[at]]
    code, ahead = codes(place, token, start)
    key = bigram_code(ahead, code)
    keys, back = np.unique(key, return_inverse=True)
    pair_level = filter_.levels(bigram_key(keys))[back]
    no_pair = (pair_level == 0) & (model.least[1] > 1)
    if learned is not None and model.least[1] > 1:
        ask = np.flatnonzero(no_pair & np.repeat(learned, np.diff(borders)))
        wanted = np.zeros(len(keys), bool)
        wanted[back[ask]] = True
        alone_there = np.zeros(len(keys), bool)
        alone_there[wanted] = LogFrequencyFilter(model.several).levels(bigram_key(keys[wanted])) == 0
        once = alone_there[back[ask]]
        pair_level[ask[once]] = 1
        no_pair[ask[once]] = False
        ask = ask[~once]
        own = own_counts(key[ask], np.searchsorted(ask, borders))
        sure = own == model.least[1] - 1
        pair_level[ask[sure]] = level_of(own[sure])
        no_pair[ask[sure]] = False
    # A bigram of a token that was never seen was not seen either.
    no_pair &= ~(unseen | (~start & np.concatenate(([False], unseen[:-1]))))
    # Of two broadcast tokens only the count is open: it is scored as never seen here, and ``common_parts`` adds the rest.
    later = no_pair & (key < HASHED)
    closed = ~(no_alone | no_context | (no_pair & ~later))
    p = smoothed(seen, mass, alone, pair_level)
    cut = borders[:-1]
    rare = place < 0
    left = np.flatnonzero(rare | ~closed)
    values = (code.view(np.int64), ahead.view(np.int64), np.where(no_pair, ASK, pair_level).astype(np.int16), ~closed)
    ask = np.flatnonzero(later)
    return {
        "n_tokens": np.diff(borders), "head_known": np.add.reduceat((~rare).astype(np.int64), cut),
        "head_base": np.add.reduceat(np.where(rare, 0.0, base), cut),
        "score": np.add.reduceat(np.where(closed, np.log10(np.minimum(p, 1.0)), 0.0), cut),
        **{name: pa.array(v[left], kind) for (name, kind), v in zip(OPEN.items(), values, strict=True)},
        "open_borders": np.searchsorted(left, borders), "ask": pa.array(key[ask].view(np.int64)), "ask_borders": np.searchsorted(ask, borders),
    }


def score(docs: DataFrame, model: Model, words: DataFrame, bigrams: DataFrame, folds: int) -> DataFrame:
    """Every row with exact base and model score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["row", "doc_id", "held_out", "n_tokens", "head_known", "head_base", "score", *OPEN, "ask"]
    schema = (
        "row long, doc_id long, held_out boolean, n_tokens long, head_known long, head_base double, score double, "
        f"{OPEN_SQL}, ask array<long>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            held_out = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for at, texts in text_groups(batch, "text"):
                found = score_texts(shared.value, texts, ~held_out[at : at + len(texts)])
                n = len(texts)
                left = [pa.ListArray.from_arrays(pa.array(found["open_borders"].astype(np.int32)), found[c]) for c in OPEN]
                left.append(pa.ListArray.from_arrays(pa.array(found["ask_borders"].astype(np.int32)), found["ask"]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + n)), batch.column(0).slice(at, n), batch.column(1).slice(at, n),
                    *(pa.array(found[c]) for c in names[3:7]), *left,
                ], names=names)
                row += n

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", folds) == 0).alias("held_out"), whole_text().alias("text")
    )
    scored = stage(rows.mapInArrow(run, schema), "scored", "zstd")

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, lists = batch.column(0).to_numpy(), {name: batch.column(i) for i, name in enumerate(OPEN, 1) if name != "wait"}
            token, before, level = (c.flatten().to_numpy() for c in lists.values())
            open_ = np.flatnonzero(level == ASK)
            where = np.repeat(np.arange(len(row)), pc.list_value_length(lists["token"]).to_numpy())[open_]
            key, place = np.unique(bigram_code(before[open_].view(U64), token[open_].view(U64)).view(np.int64), return_inverse=True)
            one, _, _ = runs(where * len(key) + place)
            yield pa.RecordBatch.from_arrays([pa.array(row[where[one]]), pa.array(key[place[one]])], names=["row", "key"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, key, n = (c.to_numpy() for c in batch.columns)
            distinct, place = np.unique(row, return_inverse=True)
            parts = np.bincount(place, common_parts(shared.value, key, n), len(distinct))
            yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(parts)], names=["row", "part"])

    # Each document asks once for a word or bigram; its answers are no more than its own tokens.
    waiting = F.filter(F.zip_with("before", "wait", lambda b, w: F.when(w, b)), lambda b: b < 0)
    asked = F.array_distinct(F.concat(F.filter("token", lambda x: x < 0), waiting))
    answers = (
        scored.select("row", F.explode(asked).alias("key")).join(words.hint("shuffle_hash"), "key").select("row", "key", "n", "left")
    )
    if model.least[1] > 1:
        # Bigrams of broadcast tokens need nothing but their count: a sum per document comes back, in a step of its own.
        def common(table: DataFrame) -> DataFrame:
            return table.select("row", F.explode("ask").alias("key"))

        numbered = that_may_match(bigrams.where("key >= 0"), common(scored.where("held_out")), shared)
        found = common(scored).join(numbered.hint("shuffle_hash"), "key").select("row", "key", "n")
        parts = stage(found.mapInArrow(added, "row long, part double").groupBy("row").agg(F.sum("part").alias("part")), "parts")

        def others(table: DataFrame) -> DataFrame:
            return table.select("row", "token", "before", "level").mapInArrow(pairs_of, "row long, key long")

        hashed = that_may_match(bigrams.where("key < 0"), others(scored.where("held_out")), shared)
        found = others(scored).join(hashed.hint("shuffle_hash"), "key")
        answers = answers.union(found.select("row", "key", "n", F.lit(None).cast("double")))
    answers = answers.groupBy("row").agg(F.collect_list(F.struct("key", "n", "left")).alias("answers"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            found = columns["answers"].flatten()
            token, before, level, wait = (columns[c].flatten().to_numpy(zero_copy_only=False) for c in OPEN)
            key, n, left = found.flatten()
            pair = left.is_null().to_numpy(zero_copy_only=False)
            key, n = key.to_numpy(), n.to_numpy()
            rare, known, base, part = finish(
                shared.value, token, before, level, (key[~pair], n[~pair], left.fill_null(0.0).to_numpy()[~pair]), (key[pair], n[pair]),
            )
            borders = np.concatenate(([0], np.cumsum(pc.list_value_length(columns["token"]).to_numpy())))

            def total(values: np.ndarray) -> np.ndarray:
                sums = np.bincount(np.repeat(np.arange(len(borders) - 1), np.diff(borders)), values, len(borders) - 1)
                return sums if values.dtype == float else sums.astype(np.int64)

            yield pa.RecordBatch.from_arrays([
                *(columns[c] for c in ("doc_id", "held_out", "n_tokens")),
                pa.array(columns["head_known"].to_numpy() + total(rare & known)), pa.array(np.full(batch.num_rows, shared.value.total, np.int64)),
                pa.array(columns["head_base"].to_numpy() + total(base)), pa.array(columns["score"].to_numpy() + total(np.where(wait, part, 0.0)) + columns["part"].to_numpy()),
            ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    answered = scored.drop("ask").join(answers, "row", "left")
    if model.least[1] > 1:
        answered = answered.join(parts, "row", "left").withColumn("part", F.coalesce("part", F.lit(0.0)))
    else:
        answered = answered.withColumn("part", F.lit(0.0))
    return answered.mapInArrow(close, result)


def language_model_scores(docs: DataFrame, folds: int = 10) -> DataFrame:
    model, (words, bigrams) = fit(docs, folds)
    return score(docs, model, words, bigrams, folds)
