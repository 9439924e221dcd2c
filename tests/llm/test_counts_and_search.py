"""Filter audit, ranked search and token counts against brute force."""

import math
import random
import re
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chartloom.llm import filter_audit, token_counts, treap
from tests.llm.conftest import EDGE, SCHEMA

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
BYTES = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(BYTES)


def clashing(df):
    """The same rows with extra columns that carry the operators' own names."""
    for name in ("failed", "part", "digest", "first", "good", "toxic", "terms", "score", "rank", "item_id", "n_tokens", "n_bytes", "_spread"):
        df = df.selectExpr("*", f"'x' AS `{name}`") if name not in df.columns else df
    return df


# filter audit


def plain_audit(rows, labels):
    """Apply the filters document by document for each order."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = WORD.findall(text)
        tests = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, t, _ in rows),
        }
        fails.append((lang or "", doc_id, {k for k, v in tests.items() if v}))
    out = {}
    for part in {p for p, _, _ in fails}:
        docs = [(i, f) for p, i, f in fails if p == part]
        share = Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                stay = [(i, f) for i, f in left if letter not in f]
                failing = sum(letter in f for _, f in docs)
                out[part, "".join(order), step] = [
                    len(stay), len(gone), failing - len(gone), sum(f == {letter} for _, f in docs),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), letter,
                ]
                share[letter] += len(gone)
                left = stay
        for key, row in out.items():
            if key[0] == part:
                row[6] = share[row[6]]
    return out


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], SCHEMA).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.filter_audit(clashing(docs), marks).collect()
    return {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in found}


def test_audit_matches_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["ab", "Cd", "e#", "fg", "hi", "jk"]) + str(rng.randrange(rng.choice([20, 900]))) for _ in range(rng.choice([5, 150, 250, 400]))) for _ in range(25)]
    texts += [None, "", " \n ", "A", "word " * 250]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None])) for i in range(150)]
    rows += [(7, rows[7][1], "fr"), (None, rows[3][1], "en"), (None, rows[3][1], "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    got, want = audited(spark, rows, labels), plain_audit(rows, labels)
    assert got == want
    assert len(got) == 4 * 600


def test_audit_of_empty_tables(spark):
    assert audited(spark, [], []) == {}
    assert len(audited(spark, [(1, None, None)], [])) == 600


@given(st.lists(st.integers(0, 50), min_size=16, max_size=16))
@settings(max_examples=50, deadline=None)
def test_shares_are_mean_marginals(counts):
    removed = [sum(n for failed, n in enumerate(counts) if failed & c) for c in range(16)]
    want = [Fraction(0)] * 4
    for order in permutations(range(4)):
        before = 0
        for i in order:
            want[i] += Fraction(removed[before | 1 << i] - removed[before], math.factorial(4))
            before |= 1 << i
    assert filter_audit.shapley_shares(removed, 4) == want


# ranked search


def plain_search(rows, items, most=50):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in rows]
    bags = [(i, b) for i, b in bags if b]
    big_n, big_l = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, terms in wanted.items():
        scored = []
        for doc_id, bag in bags:
            m = 50 + 50 * sum(bag.values()) * big_n // big_l
            score = sum(
                math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in terms if t in bag
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:most], 1)]
    return sorted(out, key=str)


def searched(spark, rows, items, most=50, parts=3):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(parts)
    queries = spark.createDataFrame(items, "item_id long, text string")
    found = treap.ranked_search(clashing(docs), queries.selectExpr("*", "1 AS terms", "2 AS doc_id"), most)
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("block", [40, 1 << 20])
def test_search_matches_brute_force(spark, monkeypatch, block):
    """Blocks of about 40 terms too; many documents share score and text."""
    monkeypatch.setattr(treap, "BLOCK_TERMS", block)
    monkeypatch.setattr(treap, "BUNCH", 3)
    rng = random.Random(block)
    words = ["a", "B", "é", "x1", "Zz", "ñu", *(f"w{i}" for i in range(30))]
    texts = [" ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randrange(1, 40))) for _ in range(120)]
    rows = [(i * 3, rng.choice(texts)) for i in range(300)] + EDGE + [(None, texts[0]), (None, texts[0])]
    rng.shuffle(rows)
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for i in range(12)] + [(50, None), (51, "!!"), (52, "none-such"), (3, "again w2"), (None, "w1 W1"), (60, "word")]
    for most in (5, 50):
        assert searched(spark, rows, items, most) == plain_search(rows, items, most)


def test_search_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(treap, "PASS_TERMS", 4)
    rows = [(i, f"w{i % 7} w{i % 3} common") for i in range(50)]
    items = [(i, f"w{i} w{i + 1}") for i in range(9)]
    assert searched(spark, rows, items, 3) == plain_search(rows, items, 3)


def test_search_of_empty_tables(spark):
    assert searched(spark, [], [(1, "a b")]) == []
    assert searched(spark, [(1, "a b")], []) == []
    assert searched(spark, [(1, None), (2, " ! ")], [(1, "a")]) == []


def test_weights_of_zero_give_no_result(spark):
    """A term that nearly all of very many documents hold weighs nothing."""
    best = treap.Best(5)
    height, cells = treap.Treap.build(np.array([0, 0]), np.array([0, 1]), np.array([7, 9]))
    treap.descend(treap.Treap.load(height, cells), np.array([0]), np.array([0]), np.array([1, 2]), np.array([True, True]), best)
    assert len(best.score) == 0


@given(st.sets(st.tuples(st.integers(0, 40), st.integers(0, 90)), min_size=1, max_size=60), st.integers(0, 2**32))
@settings(max_examples=60, deadline=None)
def test_treap_gives_back_its_cells(cells, seed):
    row, column = np.array(sorted(cells)).T
    impact = np.random.default_rng(seed).integers(1, 10**6, len(row))
    tree = treap.Treap.load(*treap.Treap.build(row, column, impact))
    assert tree.top[0] == impact.max()
    for r in range(min(41, 1 << tree.height)):
        best = treap.Best(1000)
        treap.descend(tree, np.array([r]), np.array([2]), np.arange(1 << tree.height), np.ones(1 << tree.height, bool), best)
        assert {(int(k), int(s)) for k, s in zip(best.key, best.score)} == {(int(c), 2 * int(v)) for x, c, v in zip(row, column, impact) if x == r}


# token counts


def test_counts_match_the_library(make):
    rows = {(r["doc_id"], r["n_bytes"]): (r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(clashing(make(EDGE)), BYTES).collect()}
    for doc_id, text in EDGE:
        n = len(TOKENIZER.encode(text or "", add_special_tokens=False).ids)
        assert rows[doc_id, len((text or "").encode())] == (n, n > 1024)
    assert token_counts.count_tokens(make(EDGE), BYTES).count() == len(EDGE)
    assert token_counts.count_tokens(make([]), BYTES).count() == 0


PARTS = st.sampled_from(["a", "b", "'s", "'ll", "'re", "'", "S", "1", "é", " ", "  ", "\n", "\t", " ", "　", "<|endoftext|>", "<|", "’", "-", "ñ", "👍🏽", "中文", "́", "²", "the", "ing", "\x00"])


@given(st.lists(st.lists(PARTS, max_size=40).map("".join) | st.text(max_size=40), min_size=1, max_size=8))
@settings(max_examples=300, deadline=None)
def test_any_text_has_the_librarys_count(texts):
    want = [len(e.ids) for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.counter(BYTES).counts([t.encode() for t in texts]).tolist() == want


def test_every_character_has_its_class():
    for low in range(0, 0x110000, 8192):
        texts = [f"a{chr(c)}1{chr(c)}!{chr(c)} b" for c in range(low, min(low + 8192, 0x110000)) if not 0xD800 <= c < 0xE000]
        want = [len(e.ids) for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]
        assert token_counts.counter(BYTES).counts([t.encode() for t in texts]).tolist() == want


def test_long_runs_and_a_full_memory():
    rng = random.Random(5)
    texts = ["a" * 9000, "ab" * 5000, "".join(rng.choices("abcdefgh", k=20000)), "=" * 7777, " " * 6000, "\n" * 5001 + "x", "".join(rng.choices("aé中", k=3000))]
    want = [len(e.ids) for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]
    fresh = token_counts.TokenCounter(BYTES)
    assert fresh.counts([t.encode() for t in texts]).tolist() == want
    fresh.memory = token_counts.Memory(2)
    assert [int(fresh.counts([t.encode()])[0]) for t in [*texts, "some words of a text"]] == [*want, 5]


def test_tables_out_of_order_merge_one_place_at_a_time():
    """The merged symbol of a late pair is part of an earlier one: the queue of pairs is the model."""

    def plain(symbols, ranks):
        while True:
            found = min(((ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks), default=None)
            if found is None:
                return len(symbols)
            i = found[1]
            symbols = [*symbols[:i], names[symbols[i], symbols[i + 1]], *symbols[i + 2 :]]

    names = {(0, 1): 3, (3, 0): 4, (1, 2): 5, (0, 0): 6}
    order = [(3, 0), (0, 1), (1, 2), (0, 0)]
    table = token_counts.MergeTable(*(np.array(x, np.int32) for x in ([a for a, _ in order], [b for _, b in order], [names[p] for p in order])), np.arange(256, dtype=np.int32))
    assert not table.in_step
    rng = random.Random(1)
    runs = [rng.choices(range(3), k=rng.randrange(1, 30)) for _ in range(300)]
    data = np.array([x for run in runs for x in run], np.uint8)
    end = np.cumsum([len(run) for run in runs])
    ranks = {p: r for r, p in enumerate(order)}
    assert table.counts(data, end - [len(r) for r in runs], end).tolist() == [plain(run, ranks) for run in runs]
