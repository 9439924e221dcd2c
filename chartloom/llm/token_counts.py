"""Token counts by merging byte pairs in ragged arrays, all sequences of a batch in step.

A text is cut into pre-tokens as the byte-level pattern does it: an apostrophe with s, t, re, ve, m,
ll or d; letters, numbers or other signs, each with one space before; and white space.  Every
pre-token becomes a run of byte symbols in one flat array.  In each round every run applies
its pair of lowest rank wherever it stands, and runs without a pair are done; the symbols that are left are the tokens.
Runs longer than ``LONG`` take the same merges rank by rank from an agenda of positions instead, as each of their many rounds would
read the run again.

All places of a pair are merged at once only if every pair that uses a merged symbol has a higher rank than the
merge that made it (checked when the file is loaded; true for tables in the order of learning); otherwise each round merges one place.

A worker remembers the counts of pre-tokens by 64-bit hash.  Special strings inside a text are one token each, as the library takes
them.  A null text is an empty one: 0 bytes, 0 tokens.  Rows without an id and repeated rows are counted
like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.common import text_groups, whole_text
from chartloom.llm.tokens import Memory
from chartloom.llm.words import U64, Prefix

LIMIT = 1024
LONG = 4096
NONE = np.iinfo(np.int32).max
OUTSIDE, LETTER, NUMBER, SIGN, SPACE = range(5)


@cache
def character_classes() -> np.ndarray:
    """Class of every code point."""
    import regex

    classes = np.full(0x110000, SIGN, np.uint8)
    plain = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text, place = "".join(map(chr, plain)), np.array(plain)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for found in regex.finditer(pattern, text):
            classes[place[found.start() : found.end()]] = kind
    return classes


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of the character that each byte of valid UTF-8 belongs to."""
    classes = character_classes()
    out = classes[:128][data & 127]
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return out
    padded = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int32)
    first = padded[lead]
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    code = np.where(size == 2, first & 0x1F, np.where(size == 3, first & 0x0F, first & 0x07))
    for k in range(1, 4):
        code = np.where(size > k, code << 6 | padded[lead + k] & 0x3F, code)
    kind = classes[np.minimum(code, 0x10FFFF)]
    for k in range(4):
        inside = size > k
        out[lead[inside] + k] = kind[inside]
    return out


def pre_tokens(data: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the pre-tokens of a buffer; bytes marked ``outside`` belong to no text and part what stands around them."""
    kind = byte_classes(data)
    kind[outside] = OUTSIDE
    n = len(data)
    cut = np.ones(n + 1, bool)
    cut[1:n] = kind[1:] != kind[:-1]
    # The last character of white space before a visible one stands alone, or goes with it if it is a plain space.
    ends = np.flatnonzero(cut[1:n] & (kind[:-1] == SPACE) & (kind[1:] != OUTSIDE)) + 1
    last = ends - 1
    while len(deep := np.flatnonzero((data[last] & 0xC0) == 0x80)):
        last[deep] -= 1
    cut[last] = True
    cut[ends[data[ends - 1] == 32]] = False
    quote = np.flatnonzero((data == 39) & cut[:n] & ~outside)
    if len(quote):
        padded = np.concatenate((np.where(outside, 0, data), np.zeros(2, np.uint8)))
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long_ = ((one == 108) & (two == 108)) | (((one == 114) | (one == 118)) & (two == 101))
        for which, size in ((quote[short], 2), (quote[long_], 3)):
            cut[which + 1] = False
            cut[which + size] = True
    edge = np.flatnonzero(cut)
    start, end = edge[:-1], edge[1:]
    inside = kind[start] != OUTSIDE
    return start[inside], end[inside]


def byte_alphabet() -> list[str]:
    """Character that stands for each byte in byte-level vocabularies: itself if it is printable, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in printable else next(hidden)) for b in range(256)]


class MergeTable:
    """Ranks of symbol pairs and the symbols they become."""

    def __init__(self, first: np.ndarray, second: np.ndarray, product: np.ndarray, byte_symbol: np.ndarray):
        key = first.astype(np.int64) << 32 | second
        self.order = np.argsort(key)
        self.keys, self.product, self.byte_symbol = key[self.order], product, byte_symbol
        made = {}
        for rank, symbol in enumerate(product.tolist()):
            made[symbol] = max(made.get(symbol, 0), rank)
        self.in_step = all(made.get(a, -1) < r and made.get(b, -1) < r for r, (a, b) in enumerate(zip(first.tolist(), second.tolist(), strict=True)))

    def ranks(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(first), NONE, np.int32)
        key = first.astype(np.int64) << 32 | second
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NONE).astype(np.int32)

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Symbols left of each byte range."""
        length = end - start
        out = length.copy()
        long_ = np.flatnonzero(length > LONG) if self.in_step else np.zeros(0, np.int64)
        for i in long_.tolist():
            out[i] = self._from_agenda(self.byte_symbol[data[start[i] : end[i]]])
        rest = np.flatnonzero((length > 1) & ((length <= LONG) | (not self.in_step)))
        size = length[rest]
        begin = np.cumsum(size) - size
        at = np.repeat(start[rest] - begin, size) + np.arange(size.sum())
        self._in_rounds(self.byte_symbol[data[at]], np.repeat(rest, size), out)
        return out

    def _in_rounds(self, symbol: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
        """Merge runs of symbols with the same owner; ``out[owner]`` becomes the number of symbols left."""
        rank = np.full(len(symbol), NONE, np.int32)
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        rank[pair] = self.ranks(symbol[pair], symbol[pair + 1])
        while len(symbol):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            size = np.diff(np.concatenate((first, [len(symbol)])))
            low = np.minimum.reduceat(rank, first)
            done = low == NONE
            out[owner[first[done]]] = size[done]
            low = np.repeat(low, size)
            at = np.flatnonzero((rank == low) & (low < NONE))
            if not len(at):
                return
            fresh = np.concatenate(([True], at[1:] != at[:-1] + 1 if self.in_step else owner[at[1:]] != owner[at[:-1]]))
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            # Of overlapping places every other one; of places that must not go together the first.
            at = at[place % 2 == 0 if self.in_step else place == 0]
            symbol[at] = self.product[rank[at]]
            keep = low < NONE
            keep[at + 1] = False
            shift = np.cumsum(keep) - 1
            symbol, owner, rank, at = symbol[keep], owner[keep], rank[keep], shift[at]
            near = np.concatenate((at, at[at > 0] - 1))
            follows = near + 1 < len(symbol)
            follows[follows] = owner[near[follows]] == owner[near[follows] + 1]
            rank[near[~follows]] = NONE
            near = near[follows]
            rank[near] = self.ranks(symbol[near], symbol[near + 1])

    def _from_agenda(self, symbol: np.ndarray) -> int:
        """Symbols left of one run, with links between living symbols and the places of each rank that waits."""
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n, bool)
        rank = np.concatenate((self.ranks(symbol[:-1], symbol[1:]), [NONE])).astype(np.int32)
        agenda: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def plan(places: np.ndarray) -> None:
            places = places[rank[places] < NONE]
            places = places[np.argsort(rank[places], kind="stable")]
            border = np.flatnonzero(np.diff(rank[places])) + 1
            for group in np.split(places, border) if len(places) else ():
                r = int(rank[group[0]])
                if r not in agenda:
                    agenda[r] = []
                    heapq.heappush(waiting, r)
                agenda[r].append(group)

        plan(np.arange(n))
        while waiting:
            r = heapq.heappop(waiting)
            at = np.unique(np.concatenate(agenda.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            fresh = np.concatenate(([True], at[1:] != after[at[:-1]]))
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[place % 2 == 0]
            gone = after[at]
            alive[gone], rank[gone] = False, NONE
            symbol[at], after[at] = self.product[r], after[gone]
            inner = after[at] < n
            before[after[at[inner]]] = at[inner]
            near = np.unique(np.concatenate((at, before[at][before[at] >= 0])))
            follows = after[near] < n
            rank[near] = NONE
            rank[near[follows]] = self.ranks(symbol[near[follows]], symbol[after[near[follows]]])
            plan(near)
        return int(alive.sum())


class TokenCounter:
    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model, cutter = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or cutter["type"] != "ByteLevel" or cutter["add_prefix_space"] or not cutter["use_regex"]:
            raise ValueError("only byte-level pair merges with the usual pattern are counted")
        added = spec["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("special strings must not take in what stands around them")
        strings = sorted((t["content"].encode() for t in added), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, strings))) if strings else None
        vocabulary = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        first, second, product = (
            np.array([vocabulary[x] for x in column], np.int32)
            for column in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs])
        )
        self.table = MergeTable(first, second, product, np.array([vocabulary[c] for c in byte_alphabet()], np.int32))
        self.memory = Memory()

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text."""
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.concatenate(([0], np.cumsum(length + 1)))
        outside = np.zeros(len(data), bool)
        outside[begin[1:] - 1] = True
        special = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            for found in self.special.finditer(text) if self.special else ():
                outside[begin[i] + found.start() : begin[i] + found.end()] = True
                special[i] += 1
        start, end = pre_tokens(data, outside)
        sums = np.concatenate(([0], np.cumsum(self._known(data, start, end))))
        return np.diff(sums[np.searchsorted(start, begin)]) + special

    def _known(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token; those not yet in the memory are merged, each distinct one once."""
        hashes = Prefix(data).of(start, end)
        hashes[hashes == 0] = U64(1)
        distinct, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        memory = self.memory
        number = memory.find(distinct)
        new = np.flatnonzero(number < 0)
        if len(new):
            fresh = self.table.counts(data, start[one[new]], end[one[new]])
            if memory.count + len(new) > memory.most:
                known = np.zeros(len(distinct), np.int64)
                old = number >= 0
                known[old], known[new] = memory.ids[memory.begin[number[old]]], fresh
                memory.clear()
                return known[back]
            memory.add(distinct[new], fresh[:, None].tolist())
            number = memory.find(distinct)
        return memory.ids[memory.begin[number]].astype(np.int64)[back]


@cache
def counter(path: str) -> TokenCounter:
    """One per worker process and tokenizer file."""
    return TokenCounter(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row, without a shuffle."""
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_groups(batch):
                valid = [t if t.isascii() else t.decode("utf-8", "replace").encode() for t in texts]
                n = counter(tokenizer_path).counts(valid)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(texts)), pa.array(list(map(len, texts)), pa.int64()), pa.array(n), pa.array(n > limit),
                ], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, schema)
