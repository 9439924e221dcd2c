"""Weighted MinHash signatures of bags by hierarchical Poisson processes.

The weight axis of every element is cut into [0, 1), [1, 2), [2, 4), [4, 8), ...  Each
interval has its own Poisson process in time, seeded by element and interval, whose rate is
the interval's width; a point carries a register and a whole weight inside the interval.
A bag with weight w sees the points below w: all intervals below w and, thinned by the
points' weights, the one that w cuts.  A register keeps its earliest point, so two bags agree
in a register with exactly the probability of their weighted Jaccard similarity.  Points
are drawn in order of time until they come later than all registers, so a large bag needs about
one draw per element and not one per register.
"""

from __future__ import annotations

import numpy as np

from chartloom.llm.words import U64, Documents, mix

SHINGLE_WORDS = 5


def bags(docs: Documents) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and count of each distinct run of five words, sorted by document and hash.

    A document of one to four words has one run of all its words; one without words has none.
    """
    n, h = len(docs.hash), docs.hash
    size = np.minimum(SHINGLE_WORDS, docs.counts)[docs.doc]
    start = np.flatnonzero(np.arange(n) + size <= docs.first[docs.doc + 1]) if n else np.zeros(0, np.int64)
    key = mix(size[start].astype(U64))
    for k in range(SHINGLE_WORDS):
        at = start[size[start] > k]
        key[size[start] > k] = mix(key[size[start] > k] * U64(3) + h[at + k])
    doc = docs.doc[start]
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    fresh = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))) if len(key) else start
    return doc[fresh], key[fresh], np.diff(np.concatenate((fresh, [len(key)])))


def _uniform(x: np.ndarray) -> np.ndarray:
    """Above 0, at most 1."""
    return ((x >> U64(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, count: int, registers: int) -> np.ndarray:
    """(count, registers) hashes of the winning points; a bag without elements has zeros."""
    level = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)  # intervals above the first
    who = np.repeat(np.arange(len(doc)), level + 1)
    level = np.arange(len(who)) - np.repeat(np.cumsum(level + 1) - level - 1, level + 1)
    low = np.where(level, 1 << np.maximum(level - 1, 0), 0)
    width = np.maximum(low, 1)
    owner, cover = doc[who], weight[who] - low
    seed = mix(element[who] + mix(level.astype(U64) + U64(0x51ED)))
    time = np.zeros(len(who))
    first = np.full(count * registers, np.inf)
    last = np.full(count, np.inf)
    active, drawn = np.arange(len(who)), 0
    while len(active):
        block = int(np.clip(16384 // len(active), 1, 64))
        step = mix(seed[active][:, None] + np.arange(drawn + 1, drawn + block + 1).astype(U64) * U64(0x9E3779B97F4A7C15))
        gap = -np.log(_uniform(step)) / width[active][:, None]
        gap[:, 0] += time[active]
        when = np.cumsum(gap, axis=1)
        time[active] = when[:, -1]
        drawn += block
        other = mix(step ^ U64(0xD6E8FEB86659FD93))
        register = (other >> U64(40)).astype(np.int64) % registers
        inside = (other & U64(0xFFFFFFFF)).astype(np.int64) % width[active][:, None] < cover[active][:, None]
        inside &= when <= last[owner[active]][:, None]
        np.minimum.at(first, (owner[active][:, None] * registers + register)[inside], when[inside])
        last = first.reshape(count, registers).max(axis=1)
        active = active[time[active] <= last[owner[active]]]
    first = first.reshape(count, registers)
    return np.where(np.isfinite(first), mix(first.view(U64)), U64(0))


def similarity(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact weighted Jaccard similarity of two bags (sorted hashes and counts); of two empty ones 1."""
    both = one[1].sum() + two[1].sum()
    _, i, j = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
    shared = np.minimum(one[1][i], two[1][j]).sum()
    return float(shared / (both - shared)) if both else 1.0
