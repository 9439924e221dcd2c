"""Quality rules on repetition: suffix array over words, longest common prefixes, covered spans.

For a group of documents at once, suffixes of word numbers are sorted by prefix doubling;
ranks of every doubling are kept, so the longest common prefix of neighbours in the suffix array
is found by halving.  A position's longest repeat is the larger of the two prefixes it
shares with its neighbours; the union of these spans is the union of all occurrences of
maximal repeated substrings.  Repeats never cross documents.

Null and empty texts have no words: all counts are 0 and the base rules refuse them.
Texts of any length are handled whole; a text above the group size forms its own group.
Rows are judged one by one, so ties and repeated rows have equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.common import text_groups, whole_text
from chartloom.llm.words import U64, Documents, mix

#: Characters that count as symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

NAMES = [
    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "base_failed", "kept", "covered_words", "longest_repeat", "n_spans",
]
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, covered_words long, longest_repeat long, n_spans long"
)


@dataclass(frozen=True)
class Limits:
    #: Repeated substrings below so many words do not count.
    least_repeat: int = 8
    #: Largest share of words inside repeated substrings.  Each of these words is also in a 3-word window found twice,
    #: so a limit of the base's 50 % or more would never decide; 99.9 % of labelled clean texts are below 31 %.
    covered_share: float = 0.35
    #: Words from which one repeated substring refuses a text of any length; labelled clean texts repeat up to 13.
    longest_words: int = 60


def suffix_ranks(symbols: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols; all ranks of the final ones differ.

    ``symbols`` must differ between documents.  ``last[i]`` is the end of the document of i.
    A rank is the place of its class in sorted order, so classes split without moving others.
    """
    n = len(symbols)
    _, inverse, counts = np.unique(symbols, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts)[inverse]
    levels, width = [rank], 1
    active = np.flatnonzero(counts[inverse] > 1)
    while len(active):
        following = active + width
        second = np.where(following < last[active], rank[np.minimum(following, n - 1)], -1)
        order = np.lexsort((second, rank[active]))
        sorted_, one, two = active[order], rank[active][order], second[order]
        fresh_class = np.concatenate(([True], one[1:] != one[:-1]))
        fresh = fresh_class | np.concatenate(([True], two[1:] != two[:-1]))
        at = np.arange(len(order))
        class_begin = np.maximum.accumulate(np.where(fresh_class, at, 0))
        begin = np.maximum.accumulate(np.where(fresh, at, 0))
        rank = rank.copy()
        rank[sorted_] = one + (begin - class_begin)
        levels.append(rank)
        group = np.cumsum(fresh) - 1
        active = np.sort(sorted_[np.bincount(group)[group] > 1])
        width *= 2
    return levels


def longest_repeats(symbols: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each position the length of the longest substring from there that occurs elsewhere too."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    levels = suffix_ranks(symbols, last)
    suffixes = np.empty(n, np.int64)
    suffixes[levels[-1]] = np.arange(n)
    left, right = suffixes[:-1].copy(), suffixes[1:].copy()
    common = np.zeros(n + 1, np.int64)  # common[r]: of the suffixes at places r - 1 and r
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero((left < n) & (right < n))
        same = inside[levels[k][left[inside]] == levels[k][right[inside]]]
        common[same + 1] += 1 << k
        left[same] += 1 << k
        right[same] += 1 << k
    out = np.empty(n, np.int64)
    out[suffixes] = np.maximum(common[:-1], common[1:])
    return out


def repeat_spans(docs: Documents, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and end of the merged spans of repeated substrings, and each word's longest repeat."""
    salt = mix(docs.doc.astype(U64) + U64(1))
    longest = longest_repeats(mix(docs.hash ^ salt), docs.first[docs.doc + 1] if len(docs.doc) else docs.first[:0])
    from_here = np.flatnonzero(longest >= least)
    change = np.zeros(len(longest) + 1, np.int64)
    np.add.at(change, from_here, 1)
    np.add.at(change, from_here + longest[from_here], -1)
    covered = np.concatenate(([False], np.cumsum(change)[:-1] > 0, [False]))
    edge = np.flatnonzero(covered[1:] != covered[:-1])
    start, end = edge[::2], edge[1::2]
    # Spans of two documents that touch are cut at the border.
    border = docs.first[1:-1]
    border = np.unique(border[(np.searchsorted(start, border, "left") > np.searchsorted(end, border, "right"))]) if len(start) else border[:0]
    return np.sort(np.concatenate((start, border))), np.sort(np.concatenate((end, border))), longest


def judge(texts: list[bytes], limits: Limits = Limits()) -> list[np.ndarray]:
    """Columns after ``doc_id`` for a group of documents."""
    docs = Documents(texts)
    n, count = docs.counts, len(texts)
    per_doc = lambda doc: np.bincount(doc, minlength=count).astype(np.int64)
    inside = np.zeros(len(docs.data) + 1, np.int8)
    inside[docs.start] = 1
    inside[docs.end] -= 1
    starts_char = (docs.data & 0xC0) != 0x80
    word_chars = docs.per_document((np.cumsum(inside[:-1], dtype=np.int8) > 0) & starts_char)
    n_symbols = docs.per_document(SYMBOLS[docs.data])

    line_end = np.flatnonzero(docs.data == 10)
    line_start = np.concatenate(([0], line_end[:-1] + 1))
    with_word = np.searchsorted(docs.start, line_end) > np.searchsorted(docs.start, line_start)
    line_start, line_end = line_start[with_word], line_end[with_word]
    line_doc = np.searchsorted(docs.begin, line_start, "right") - 1
    line_key = mix(docs.prefix.of(line_start, line_end) ^ mix(line_doc.astype(U64) + U64(7)))
    _, first_line = np.unique(line_key, return_index=True)
    n_dup_lines = per_doc(line_doc) - per_doc(line_doc[first_line])

    h, doc = docs.hash, docs.doc
    window = np.flatnonzero(doc[2:] == doc[:-2]) if len(h) > 2 else np.zeros(0, np.int64)
    key = mix(mix(mix(h[window] ^ mix(doc[window].astype(U64) + U64(3))) + h[window + 1]) + h[window + 2])
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    again = window[times[inverse] > 1]
    repeated = np.zeros(len(h), bool)
    for k in range(3):
        repeated[again + k] = True
    n_repeat_words = per_doc(doc[repeated])

    start, end, longest = repeat_spans(docs, limits.least_repeat)
    covered = np.bincount(doc[start], end - start, count).astype(np.int64) if len(start) else np.zeros(count, np.int64)
    most = np.zeros(count, np.int64)
    np.maximum.at(most, doc, longest)
    base_failed = (n < 50) | (100 * n_repeat_words > 50 * n)
    kept = ~base_failed & ~(covered > limits.covered_share * n) & ~(most >= limits.longest_words)
    return [n.astype(np.int64), word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, covered, most, per_doc(doc[start])]


def repetition_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_groups(batch):
                columns = [pa.array(c) for c in judge(texts, limits)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *columns], names=NAMES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, SCHEMA)
