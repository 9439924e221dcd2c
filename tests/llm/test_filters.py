"""Quality, near-dedup, language model, mixing, line windows and repetition against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from chartloom.llm import bagminhash, bloom_lm, compression, line_windows, mixing, near_dedup, repetition
from chartloom.llm.queries import CHECK_SQL, QUERIES
from chartloom.llm.words import U64, Documents, mix
from tests.compare import connect, difference
from tests.llm.conftest import EDGE

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(CHECK_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert difference(spark, connect(sf_dir), QUERIES[name], CHECK_SQL[name], sf_dir) is None


# quality


def noise(rng, bad):
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 120))]
    return " ".join(w + rng.choice(["***", "###", "$$$"]) if bad else w for w in words)


def test_quality_separates_held_out_documents(spark, make):
    rng = random.Random(1)
    rows = [(i, noise(rng, i % 5 == 0)) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    scored = compression.score(make(rows), compression.fit(make(rows), labels)).collect()
    held = [r for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = sum((r["score"] >= 0.3) == (r["doc_id"] % 5 != 0) for r in held)
    assert len(held) > 80 and right / len(held) > 0.97


def test_quality_never_learns_from_the_held_out_fold(spark, make):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    ids = {r["doc_id"] for r in compression.sample_labels(labels, 5).collect()}
    assert ids == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5}


def test_quality_keeps_columns_with_its_own_names(spark, make):
    docs = make(EDGE).selectExpr("*", "7 AS sizes", "8 AS _sizes", "9 AS score")
    out = compression.score(docs, compression.Model(b"", b"", (0.0,)))
    assert out.columns == [*docs.drop("score").columns, "score"]
    assert {(r["sizes"], r["_sizes"], r["score"]) for r in out.collect()} == {(7, 8, 0.5)}


def test_quality_edge_cases(spark, make):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    scored = compression.score(make(EDGE), compression.fit(make(EDGE), labels)).collect()
    assert len(scored) == len(EDGE) and len({r["score"] for r in scored}) == 1  # one kind of label: the share
    assert all(0 <= r["score"] <= 1 for r in scored)
    nothing = compression.fit(make([]), labels.limit(0))
    assert compression.score(make([]), nothing).count() == 0


# near-dedup


def bag_of(text):
    words = WORD.findall(text)
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else Counter()


def jaccard(a, b):
    both = sum((a | b).values())
    return sum((a & b).values()) / both if both else 1.0


def brute_classes(rows):
    bags = [bag_of(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(bags[i], bags[j]) >= 0.8 and (WORD.findall(rows[i][1] or "") == WORD.findall(rows[j][1] or "") or bags[i]):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return {i: min(x for x in g if x is not None) for g in groups.values() for i in g if i is not None}


def test_signatures_are_unbiased():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(150):
        n = rng.integers(5, 60)
        a = rng.integers(0, 9, n)
        b = np.where(rng.random(n) < 0.7, a, rng.integers(0, 9, n))
        key = mix(rng.integers(0, 2**62, n).astype(U64))
        doc = np.concatenate((np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)))
        found = bagminhash.signatures(doc, np.concatenate((key[a > 0], key[b > 0])), np.concatenate((a[a > 0], b[b > 0])), 2, 256)
        errors.append((found[0] == found[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def edited(rng, words, share):
    return " ".join(rng.choice("pqrs") * 3 + str(rng.random())[2:6] if rng.random() < share else w for w in words)


def test_near_duplicate_classes_match_brute_force(make):
    rng = random.Random(3)
    rows = []
    for base in range(12):
        words = [f"w{rng.randint(0, 999)}" for _ in range(rng.randint(5, 200))]
        rows += [(len(rows) + k, edited(rng, words, share)) for k, share in enumerate([0, 0.01, 0.02, 0.03, 0.05, 0.1, 0.3])]
    shared = " ".join(f"passage{i}" for i in range(60))
    rows += [(len(rows) + k, shared + " " + " ".join(f"x{rng.random()}" for _ in range(20))) for k in range(40)]
    rows += [(len(rows), "three words only"), (len(rows) + 1, "three  words\nonly"), (len(rows) + 2, None), (len(rows) + 3, " ")]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(make(rows)).collect()}
    assert got == brute_classes(rows)


def test_near_duplicate_edge_cases(make):
    rows = near_dedup.near_duplicates(make(EDGE)).collect()
    assert len(rows) == len(EDGE)
    found = {r["doc_id"]: r["class_id"] for r in rows}
    assert found[1] == found[2] == found[3] == 1 and found[4] == 4 and found[6] == 6 and found[None] is None
    assert near_dedup.near_duplicates(make([])).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101)], "a long, b long")
    found = {r["node"]: r["component"] for r in near_dedup.components(edges).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_links_outside_the_star_are_found(make):
    """Neighbours of a bucket's smallest text that are linked only through each other."""
    words = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(6):  # a chain: each text differs from the next in ten words
        changed = [f"c{i}" if i < 10 * k else w for i, w in enumerate(words)]
        rows.append((k, " ".join(changed)))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(make(rows)).collect()}
    assert got == brute_classes(rows) == dict.fromkeys(range(6), 0)


# language model


def lm_tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")] + [None]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def test_base_scores_match_brute_force(make, monkeypatch):
    monkeypatch.setattr(bloom_lm, "HEAD_WORDS", 20)  # most words take the join
    rng = random.Random(4)
    rows = EDGE + [(100 + i, " ".join(f"W{int(rng.paretovariate(1)) % 300}" for _ in range(rng.randint(0, 80)))) for i in range(200)]
    counts = Counter(t for i, text in rows if not held_out(i) for t in lm_tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    want = sorted(
        (len(lm_tokens(t)), sum(counts[x] > 0 for x in lm_tokens(t)),
         round(sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in lm_tokens(t)), 6))
        for _, t in rows
    )
    got = bloom_lm.language_model_scores(make(rows)).collect()
    assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["held_out"] == held_out(r["doc_id"]) and r["train_tokens"] == total for r in got)
    assert all(r["score"] <= 0 for r in got)


def test_filter_returns_levels():
    key = mix(np.arange(1, 5001).astype(U64))
    level = 1 + np.arange(5000) % 7
    segments = 4
    where = ((key >> U64(33)) % U64(segments)).astype(int)
    table = np.stack([np.frombuffer(bloom_lm.segment_bytes(key[where == s], level[where == s]), np.uint8) for s in range(segments)])
    held = bloom_lm.LogFrequencyFilter(table)
    assert (held.levels(key) == level).mean() > 0.999
    assert (held.levels(mix(np.arange(10_000, 20_000).astype(U64))) == 0).mean() > 0.999


def test_probabilities_after_a_context_sum_to_one(make):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["the", "cat", "sat", "on", "mat", "dog"]) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    model, _ = bloom_lm.fit(make(list(enumerate(texts))), 10)
    words = ["the", "cat", "sat", "on", "mat", "dog", "unseen"]
    # A text of two words minus the text of the first gives p(word | the) p(end | word).
    first = bloom_lm.score_texts(model, [b"the"])["score"][0]
    joint = [10 ** bloom_lm.score_texts(model, [f"the {w}".encode()])["score"][0] for w in words]
    end = [10 ** (bloom_lm.score_texts(model, [w.encode()])["score"][0]) for w in words]
    assert first < 0 and all(0 < x < 1 for x in joint + end)
    assert sum(joint) < 1


def test_model_beats_the_base_on_repeated_phrases(make):
    texts = [(i, "in the beginning there was a word and the word was good") for i in range(60)]
    rows = bloom_lm.language_model_scores(make(texts)).collect()
    held = [r for r in rows if r["held_out"]]
    assert held and all(r["score"] > r["base_score"] for r in held)


def brute_scores(rows):
    """Scores with quantised counts of all tokens and bigrams."""
    def quantised(n):
        return float(bloom_lm.count_at(bloom_lm.level_of(np.array([n])))[0]) if n else 0.0

    texts = [[bloom_lm.BEGIN, *lm_tokens(t)] for i, t in rows if not held_out(i)]
    one = Counter(x for t in texts for x in t)
    two = Counter(x for t in texts for x in zip(t, t[1:]))
    left, total, distinct = Counter(), sum(quantised(n) for x, n in one.items() if x is not bloom_lm.BEGIN), len(one) - 1
    for (a, _), n in two.items():
        left[a] += max(quantised(n) - 0.75, 0)
    out = []
    for _, text in rows:
        t, score = [bloom_lm.BEGIN, *lm_tokens(text)], 0.0
        for a, b in zip(t, t[1:]):
            p = (quantised(one[b]) + 0.1) / (total + 0.1 * (distinct + 1))
            if one[a]:
                p = (1 - left[a] / one[a]) * p + max(quantised(two[a, b]) - 0.75, 0) / one[a]
            score += math.log10(min(p, 1))
        out.append(score)
    return sorted(out)


@pytest.mark.parametrize(("head", "bits"), [(1 << 18, 1 << 28), (20, 1 << 28), (20, 4000), (0, 100), (1 << 18, 100)])
def test_no_cutoff_changes_a_score(make, monkeypatch, head, bits):
    """Bigrams seen once, of rare tokens and out of the filter count like others."""
    monkeypatch.setattr(bloom_lm, "HEAD_WORDS", head)
    monkeypatch.setattr(bloom_lm, "MAX_BITS", bits)
    monkeypatch.setattr(bloom_lm, "BITS_PER_ENTRY", 64 if bits == 1 << 28 else 12)  # hardly a false positive
    rng = random.Random(13)
    rows = EDGE + [(100 + i, " ".join(f"W{int(rng.paretovariate(1)) % 300}" for _ in range(rng.randint(0, 60)))) for i in range(150)]
    got = sorted(r["score"] for r in bloom_lm.language_model_scores(make(rows)).collect())
    assert np.allclose(got, brute_scores(rows), rtol=1e-9, atol=1e-6)


def test_bigrams_seen_once_are_not_asked_for(make, monkeypatch):
    """Of texts learned from, only bigrams seen several times whose count is not in the filter wait for a join."""
    monkeypatch.setattr(bloom_lm, "MAX_BITS", 4000)
    rng = random.Random(17)
    texts = [" ".join(f"w{int(rng.paretovariate(1)) % 300}" for _ in range(rng.randint(0, 60))) for _ in range(150)]
    model, _ = bloom_lm.fit(make([(None, t) for t in texts]), 10)
    counts = Counter(x for t in texts for x in zip([bloom_lm.BEGIN, *lm_tokens(t)], lm_tokens(t)))
    found = bloom_lm.score_texts(model, [t.encode() for t in texts], np.ones(len(texts), bool))
    several = sum(1 < n < model.least[1] for n in counts.values())
    assert model.least[1] > 2 and 0 < len(np.unique(found["ask"].to_numpy())) <= several  # all bigrams seen once too before


def test_runs_and_own_counts():
    values = np.array([5, 3, 5, 5, 9, 3])
    one, n, order = bloom_lm.runs(values)
    assert values[one].tolist() == [3, 5, 9] and n.tolist() == [2, 3, 1] and values[order].tolist() == sorted(values)
    assert [len(x) for x in bloom_lm.runs(np.zeros(0, np.int64))] == [0, 0, 0]
    assert bloom_lm.own_counts(np.array([7, 7, 8, 7, 8, 8]), np.array([0, 3, 3, 6])).tolist() == [2, 2, 1, 1, 2, 2]


def test_language_model_of_empty_table(make):
    assert bloom_lm.language_model_scores(make([])).count() == 0


# mixing


def test_rates_match_a_plain_projected_gradient(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.3] * 3, 50)
    n = rng.integers(1, 1000, 50)
    cells = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p, strict=True)], "tokens long, p0 double, p1 double, p2 double")
    steps = mixing.fit_rates(cells, mixing.WEIGHTS)
    rate = np.ones(50)
    for e in steps:
        rate = np.maximum(0, rate - p @ np.array(e))
    weights = np.array([mixing.WEIGHTS[d] for d in mixing.DOMAINS])
    natural = n @ p
    target = weights * natural[0] / weights[0]
    before, after = (np.abs(x / target - 1).max() for x in (natural, (n * rate) @ p))
    assert after < 0.15 < before and (rate >= 0).all()
    column = [r[0] for r in cells.select(mixing._rate([cells.p0, cells.p1, cells.p2], steps)).collect()]
    assert np.allclose(sorted(column), sorted(rate))


def fitted(spark, n, p):
    """Relative errors that the fitted rates leave, and the rates."""
    cells = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p, strict=True)], "tokens long, p0 double, p1 double, p2 double")
    rate = np.ones(len(n))
    for e in mixing.fit_rates(cells, mixing.WEIGHTS):
        rate = np.maximum(0, rate - p @ np.array(e))
    weights = np.array([mixing.WEIGHTS[d] for d in mixing.DOMAINS])
    target = weights * (n @ p)[0] / weights[0]
    return (n * rate) @ p / target - 1, rate, target


@pytest.mark.parametrize("scarce", [0.1, 0.01, 0.001])
def test_rates_meet_the_targets_of_scarce_domains(spark, scarce):
    rng = np.random.default_rng(11)
    kind = rng.choice(3, 400, p=[0.97 - scarce, 0.03, scarce])
    kind[:2] = 1, 2
    p = rng.dirichlet([0.05] * 3, 400) * 0.3 + np.eye(3)[kind] * 0.7
    n = np.where(kind == 2, 1 + 400 * 500 * scarce / (kind == 2).sum(), rng.integers(1, 1000, 400)).astype(int)
    error, rate, _ = fitted(spark, n, p)
    assert np.abs(error).max() < mixing.TOLERANCE and (rate >= 0).all()


def test_rates_are_the_least_squares_where_targets_are_out_of_reach(spark):
    rng = np.random.default_rng(12)
    p = rng.dirichlet([60, 3, 0.4], 60)  # no text is mostly of the third domain
    p[:, 2] = np.minimum(p[:, 2], 0.01)
    p /= p.sum(axis=1, keepdims=True)
    n = rng.integers(1, 1000, 60)
    error, rate, target = fitted(spark, n, p)
    slope = (p / target) @ error * n.sum()  # at the least squares: none where the rate is above 0, upwards at 0
    assert np.abs(error).max() > 0.01 and np.abs(slope[rate > 1e-9]).max() < 0.01 and slope.min() > -0.01


def test_rates_without_copies_lose_nothing_for_copies(spark):
    p = np.array([[0.96, 0.02, 0.02], [0.04, 0.94, 0.02], [0.1, 0.1, 0.8]])
    n = np.array([90_000, 9_000, 500])
    cells = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p, strict=True)], "tokens long, p0 double, p1 double, p2 double")
    steps = mixing.fit_rates(cells, mixing.WEIGHTS, 1.0)
    rows = cells.select("tokens", mixing._rate([cells.p0, cells.p1, cells.p2], steps, 1.0)).collect()
    rate = np.array([r[1] for r in sorted(rows, reverse=True)])
    assert rate[0] > 0.999 and rate[1] < 0.7 and rate[2] > 0.999


def test_mixing_edge_cases(spark, make):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 1), (6, 0, 0), (None, 1, 0), (8, None, 1)], "doc_id long, quality int, toxic int")
    rows = mixing.document_rates(make(EDGE), labels).collect()
    assert len(rows) == len(EDGE) and all(r["rate"] >= 0 for r in rows)
    assert all(abs(r["p_clean"] + r["p_toxic"] + r["p_junk"] - 1) < 1e-9 for r in rows)
    tokens = Counter((r["doc_id"], r["tokens"]) for r in rows)
    assert tokens == Counter((i, len(WORD.findall(t or ""))) for i, t in EDGE)
    assert mixing.document_rates(make([]), labels).count() == 0
    assert all(r["rate"] == 1 for r in mixing.document_rates(make([(1, "")]), labels.limit(0)).collect())


def test_mixing_has_no_python_in_its_plan(spark, sf_dir):
    for name in ("op8_mixing", "op9_line_windows"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# line windows


def brute_lines(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        lines = (text or "").split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            window = tuple(lines[i : i + 3])
            if any(WORD.search(x) for x in window):
                gone |= {i, i + 1, i + 2} if window in seen else set()
                seen.add(window)
        out[doc_id] = "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)
    return out


def test_line_windows_match_brute_force(make):
    rng = random.Random(7)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", " ", "d e"]) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_windows.dedup_lines(make(rows)).collect()}
    assert got == brute_lines(rows)


def test_line_windows_keep_columns_with_their_own_names(make):
    docs = make(EDGE).selectExpr("*", "7 AS _key", "8 AS _hash", "9 AS starts", "1 AS _row", "2 AS n_lines", "3 AS _id", "4 AS _th")
    rows = line_windows.dedup_lines(docs).collect()
    assert len(rows) == len(EDGE)
    assert {(r["_key"], r["_hash"], r["starts"], r["_row"], r["_id"], r["_th"]) for r in rows} == {(7, 8, 9, 1, 3, 4)}


def test_line_windows_edge_cases(make):
    rows = line_windows.dedup_lines(make(EDGE)).collect()
    assert len(rows) == len(EDGE)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["text"] is None and by_id[1]["n_lines"] == 1
    assert by_id[9]["text"] == "a\nb\nc\n" and by_id[9]["n_removed"] == 3
    assert line_windows.dedup_lines(make([])).count() == 0


# repetition


def brute_repetition(text, limits):
    s = text or ""
    w = WORD.findall(s)
    n = len(w)
    lines = [x for x in s.split("\n") if WORD.search(x)]
    threes = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    marked = {i + k for i in range(n - 2) if threes[tuple(w[i : i + 3])] > 1 for k in range(3)}
    longest = [max((next((k for k in range(n) if i + k >= n or j + k >= n or w[i + k] != w[j + k]), n) for j in range(n) if j != i), default=0) for i in range(n)]
    covered = {i + k for i in range(n) if longest[i] >= limits.least_repeat for k in range(longest[i])}
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", s)), len(lines) - len(set(lines)), len(marked), len(covered), max(longest, default=0)


def test_repetition_matches_brute_force(make):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(["a ", "b ", "é ", "\n", "# ", "c\t", "x"]) for _ in range(rng.randint(0, 50)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "same line here\n" * 12)]
    limits = repetition.Limits(least_repeat=3)
    for r in repetition.repetition_rules(make(rows), limits).collect():
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"))
        want = brute_repetition(dict(rows)[r["doc_id"]], limits)
        assert got == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_repetition_rules_decide(make):
    rng = random.Random(9)
    clean = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(300))
    half = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(100))
    rows = {r["doc_id"]: r for r in repetition.repetition_rules(make([(1, clean), (2, half + " " + clean[:600] + " " + half), (3, "ab " * 40000)])).collect()}
    assert rows[1]["kept"] and rows[1]["n_spans"] == 0
    assert not rows[2]["kept"] and rows[2]["longest_repeat"] == 100 and rows[2]["n_spans"] == 2
    assert rows[3]["base_failed"] and rows[3]["longest_repeat"] == 39999
    assert repetition.repetition_rules(make([])).count() == 0


def test_each_repetition_limit_refuses_texts_that_the_base_keeps(make):
    rng = random.Random(10)
    fresh = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    long, passage, pieces = fresh(4000), fresh(900), [fresh(10) for _ in range(8)]
    many = [w for piece in pieces + pieces for w in fresh(24) + piece]  # 160 of 544 words, then 160 of 400
    dense = [w for piece in pieces + pieces for w in fresh(15) + piece]
    texts = [long[:2000] + passage + long[2000:] + passage, many, dense, passage[:59] + long[:300] + passage[:59], passage[:60] + long[:300] + passage[:60]]
    rows = [r for r in sorted(repetition.repetition_rules(make([(i, " ".join(t)) for i, t in enumerate(texts)])).collect())]
    assert not any(r["base_failed"] for r in rows)
    assert [(r["longest_repeat"], r["covered_words"]) for r in rows] == [(900, 1800), (10, 160), (10, 160), (59, 118), (60, 120)]
    assert [r["kept"] for r in rows] == [False, True, False, True, False]


def test_repeats_do_not_cross_documents():
    docs = Documents([b"a b c d e", b"a b c d e"])
    start, _, longest = repetition.repeat_spans(docs, 2)
    assert not len(start) and longest.max() == 0
