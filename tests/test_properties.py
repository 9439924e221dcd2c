"""Randomized comparison with short reference recursions."""

import json
import re

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chartloom.functions import text, variants as v

SETTINGS = settings(
    max_examples=6, deadline=None, database=None, phases=[Phase.generate],
    suppress_health_check=list(HealthCheck))
KEYS = st.sampled_from("abcd")
SCALARS = st.one_of(st.none(), st.booleans(), st.integers(-9, 9), st.sampled_from(["x", ""]), st.just([1, {"a": None}]))
TREES = st.dictionaries(KEYS, st.recursive(SCALARS, lambda s: st.dictionaries(KEYS, s, max_size=3), max_leaves=8), max_size=4)


def merged(target, repair):
    out = dict(target)
    for key, value in repair.items():
        if value is None:
            continue
        if isinstance(value, dict):
            out[key] = merged(out[key] if isinstance(out.get(key), dict) else {}, value)
        elif out.get(key) is None:
            out[key] = value
    return out


def flat(tree, prefix=""):
    for key, value in tree.items():
        if isinstance(value, dict) and value:
            yield from flat(value, f"{prefix}{key}.")
        else:
            yield prefix + key, value


@SETTINGS
@given(st.lists(st.tuples(TREES, TREES), min_size=40, max_size=60))
def test_merge_matches_recursion(spark, pairs):
    rows = [(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    got = df.select("i", F.to_json(v.fill_missing(F.parse_json("a"), F.parse_json("b"))).alias("m")).collect()
    for row in got:
        assert json.loads(row.m) == merged(*pairs[row.i])


@SETTINGS
@given(st.lists(TREES, min_size=40, max_size=60))
def test_leaves_match_recursion(spark, trees):
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], "i int, a string")
    out = df.select("i", F.inline(v.leaves(F.parse_json("a")))).select("i", "path", F.to_json("value").alias("j")).collect()
    got = {i: {} for i in range(len(trees))}
    for row in out:
        got[row.i][row.path] = json.loads(row.j)
    for i, tree in enumerate(trees):
        assert got[i] == (dict(flat(tree)) or {"": {}})


@SETTINGS
@given(st.lists(st.one_of(st.text(max_size=8), st.floats(allow_nan=False, allow_infinity=False, width=32).map(lambda x: f" {x} D"),
                          st.from_regex(r"\A[+-]?[0-9]{0,3}\.?[0-9]{0,3}(e[+-]?[0-9])?[a-z ]?\Z")), min_size=60, max_size=80))
def test_leading_number(spark, values):
    values = [x.replace("\x00", "") for x in values]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, s string")
    for row in df.select("i", text.leading_number(F.col("s")).alias("n")).collect():
        hit = re.match(r"[ \t\n\x0b\f\r]*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)", values[row.i])
        assert row.n == (float(hit.group(1)) if hit else None)


@SETTINGS
@given(st.lists(st.integers(-10**9, 10**9), min_size=60, max_size=80))
def test_pt_number(spark, thousandths):
    df = spark.createDataFrame([(x,) for x in thousandths], "x long")
    for row in df.select("x", text.pt_number(F.col("x") / F.lit(1000.0)).alias("s")).collect():
        sign = "-" if row.x < 0 else ""
        whole, rest = divmod(abs(row.x), 1000)
        fraction = f"{rest:03d}".rstrip("0")
        assert row.s == sign + f"{whole:,}".replace(",", ".") + ("," + fraction if fraction else "")


@SETTINGS
@given(st.lists(TREES | st.just({"t": ["a<b", "\\\"{x}:[1, 2],", {}, [], [[], [{"k": "é"}]]], "n": [1, 2.5, None, True]}), min_size=40, max_size=60))
def test_pretty_matches_the_usual_indentation(spark, trees):
    deep = {"z": 0}
    for level in range(300):
        deep = {"a": deep, "b": [level, [deep["z"] if "z" in deep else 1]]}
    trees = [*trees, {}, deep, {"w": list(range(3000))}]
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], "i int, a string")
    for row in df.select("i", text.pretty_json(F.to_json(F.parse_json("a"))).alias("p")).collect():
        plain = json.dumps(trees[row.i], indent=2, ensure_ascii=False, sort_keys=True)
        assert row.p == plain.replace("<", "\\u003c")


def test_depth_of_a_json_token_is_summed_over_few_tokens_across_all_borders(spark):
    # A token's depth took up to 255 steps from the start of its run before.
    assert text.JSON_RUN + text.JSON_BLOCK <= 32
    per_block = text.JSON_RUN * text.JSON_BLOCK
    # Members before the nested part move its brackets over the borders of runs and blocks.
    docs = [{**{f"k{i:04d}": i for i in range(n)}, "z": json.loads("[" * d + "1" + "]" * d)}
            for n, d in ((0, 1), (3, 17), (4, 40), (63, 5), (64, 20), (per_block // 4 + 1, 33), (per_block, 90))]
    df = spark.createDataFrame([(i, json.dumps(doc)) for i, doc in enumerate(docs)], "i int, a string")
    for row in df.select("i", text.pretty_json(F.to_json(F.parse_json("a"))).alias("p")).collect():
        assert row["p"] == json.dumps(docs[row["i"]], indent=2)
