"""Token ids of whole texts with a tokenizer file, each distinct piece encoded once per worker.

Texts are cut only where the tokenizer must cut too, so that the ids of a text are the
ids of its pieces in order: between a letter and a punctuation sign other than the
apostrophe, before a single space between two visible characters, and around a single
line feed between two.  What the byte classes below do not know stays in one piece,
and a text that holds a special token's string is encoded whole.

Pieces are known by their 64-bit hash; with a full memory of a million pieces two of
them share a hash with a probability below one in ten million.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np

from chartloom.llm.words import LOWER, U64, Prefix

#: Pieces a worker remembers; when full it starts anew, which costs time but changes no id.
MEMORY_BITS = 20

_SPACE, _LINE, _APOSTROPHE = 32, 10, 39
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[33:127] = True
_PUNCTUATION[48:58] = _PUNCTUATION[_APOSTROPHE] = False
_PUNCTUATION &= ~_LETTER
#: First bytes of characters that may be white space or marks without width.
_UNSURE_LEAD = np.zeros(256, bool)
_UNSURE_LEAD[[0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[33:127] = _VISIBLE[128:] = True


class Memory:
    """Open-addressing index from piece hash to a run of ids."""

    def __init__(self, bits: int = MEMORY_BITS):
        self.most = 1 << bits
        self.keys = np.zeros(self.most << 1, U64)
        self.place = np.zeros(self.most << 1, np.int32)
        self.clear()

    def clear(self) -> None:
        self.keys[:] = 0
        self.count, self.used = 0, 0
        self.begin, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, "<u4")

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash, or of the free place where it would go."""
        mask = U64(len(self.keys) - 1)
        slot = (hashes & mask).astype(np.int64)
        open_ = np.arange(len(hashes))
        while len(open_):
            held = self.keys[slot[open_]]
            open_ = open_[(held != hashes[open_]) & (held != 0)]
            slot[open_] = (slot[open_] + 1) & int(mask)
        return slot

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 for unknown ones."""
        slot = self._slots(hashes)
        return np.where(self.keys[slot] == hashes, self.place[slot], -1)

    def add(self, hashes: np.ndarray, runs: list[list[int]]) -> None:
        """Take in distinct, unknown pieces."""
        n, lengths = len(hashes), np.fromiter(map(len, runs), np.int64, len(runs))
        flat = np.fromiter((i for run in runs for i in run), "<u4", int(lengths.sum()))
        while self.count + n > len(self.begin):
            self.begin, self.length = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.length, 2 * len(self.length))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.length[self.count : self.count + n] = lengths
        self.begin[self.count : self.count + n] = self.used + np.cumsum(lengths) - lengths
        self.ids[self.used : self.used + len(flat)] = flat
        left = np.arange(n)
        while len(left):
            slot = self._slots(hashes[left])
            _, one = np.unique(slot, return_index=True)  # two pieces may want the same free slot
            self.keys[slot[one]], self.place[slot[one]] = hashes[left[one]], self.count + left[one]
            left = np.delete(left, one)
        self.count, self.used = self.count + n, self.used + len(flat)


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters = " ".join("abcdefghijklmnopqrstuvwxyz")
        self.folds_case = self.whole(letters.upper()) == self.whole(letters)
        # Some tokenizers keep no white space at all.
        self.drops_space = self.whole("a b") == self.whole("a") + self.whole("b") and not self.whole(" \n ")
        self.memory = Memory()

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _cuts(self, data: np.ndarray, begin: np.ndarray, finish: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the pieces of a buffer of documents with one foreign byte after each."""
        lead = data == 0xC3
        letter = _LETTER[data]
        letter[:-1] |= lead[:-1] & (data[1:] != 0x97) & (data[1:] != 0xB7)
        letter[1:] |= letter[:-1] & lead[:-1]
        unsure = _UNSURE_LEAD[data]
        hidden = unsure.copy()
        hidden[1:] |= unsure[:-1]
        hidden[2:] |= unsure[:-2]
        visible = _VISIBLE[data] & ~hidden
        sign = _PUNCTUATION[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
        if self.drops_space:
            kept = (data != _SPACE) & (data != _LINE)
            cut[:-1] |= kept & ~np.concatenate(([False], kept[:-1]))
            start = np.flatnonzero(cut)
            stop = np.flatnonzero(np.concatenate((kept[:-1] & ~kept[1:], [False]))) + 1
            following = np.concatenate((start[1:], [len(data)]))
            return start, np.minimum(following, stop[np.searchsorted(stop, start, "right")] if len(stop) else following)
        alone = np.zeros(len(data), bool)
        alone[1:-1] = visible[:-2] & visible[2:]
        line = alone & (data == _LINE)
        cut[:-1] |= line | (alone & (data == _SPACE))
        cut[1:] |= line
        cut[begin] = cut[finish] = True
        edge = np.flatnonzero(cut)
        foreign = np.zeros(len(data), bool)
        foreign[finish] = True
        start = edge[~foreign[edge]]
        following = np.searchsorted(edge, start, "right")
        return start, edge[following]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        plain = [not any(s in t for s in self.special) for t in texts]
        ids, counts = self._encode_cut([t if p else b"" for t, p in zip(texts, plain, strict=True)])
        if all(plain):
            return ids, counts
        runs = np.split(ids, np.cumsum(counts)[:-1])
        runs = [
            run if p else np.asarray(self.whole(t.decode("utf-8", "replace")), "<u4")
            for run, t, p in zip(runs, texts, plain, strict=True)
        ]
        return np.concatenate(runs), np.fromiter(map(len, runs), np.int64, len(runs))

    def _encode_cut(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if self.folds_case:
            data = LOWER[data]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.concatenate(([0], np.cumsum(lengths + 1)))
        finish = begin[:-1] + lengths
        start, end = self._cuts(data, begin[:-1], finish)
        hashes = Prefix(data).of(start, end)
        hashes[hashes == 0] = 1
        memory = self.memory
        number = memory.find(hashes)
        unknown = np.flatnonzero(number < 0)
        if len(unknown):
            new, one = np.unique(hashes[unknown], return_index=True)
            one = unknown[one]
            raw = data.tobytes()
            order = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)]
            runs: list[list[int]] = []
            for i in range(0, len(order), 10_000):
                runs += [e.ids for e in self.tokenizer.encode_batch_fast(order[i : i + 10_000], add_special_tokens=False)]
            if memory.count + len(new) > memory.most:
                if memory.count:
                    memory.clear()
                    return self._encode_cut(texts)
                memory = Memory(len(new).bit_length())  # for one very long text only
            memory.add(new, runs)
            number = memory.find(hashes)
        length = memory.length[number]
        total = np.cumsum(length)
        at = np.repeat(memory.begin[number] - (total - length), length) + np.arange(total[-1] if len(total) else 0)
        sums = np.concatenate(([0], total))
        first = np.searchsorted(start, begin)
        return memory.ids[at], np.diff(sums[first])


@cache
def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and tokenizer file."""
    return PieceEncoder(path)
