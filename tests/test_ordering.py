"""The order over mixed types."""

from __future__ import annotations

import itertools
import json
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from doclith.operators import documents, ordering

RANKED = ["[]", "null", "-1", "0.05", "20", '"a"', '"b"', "{}", '{"a": 1}', '{"a": 2}', "[[]]", "[[1]]", '[["a"]]', "false", "true"]


def test_ranks():
    keys = [ordering.sort_key(json.loads(x), 1) for x in RANKED]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)


def test_arrays_stand_for_a_member():
    assert ordering.sort_key([5, "m"], 1) == ordering.sort_key(5, 1)
    assert ordering.sort_key([5, "m"], -1) == ordering.sort_key("m", -1)


def test_paths_through_arrays():
    assert ordering.lookup({"a": [{"b": 1}]}, ("a", "b"), 1) == 1
    assert ordering.lookup({"a": [{"c": 1}, {"b": 2}]}, ("a", "b"), 1) is None
    assert ordering.lookup({"a": [{"c": 1}, {"b": 2}]}, ("a", "b"), -1) == 2
    assert ordering.lookup({"a": 3}, ("a", "b"), 1) is None


@given(st.lists(st.one_of(st.integers(), st.floats(allow_nan=False, allow_infinity=False)), min_size=2, max_size=2))
def test_numbers(pair):
    a, b = pair
    assert (ordering.sort_key(a, 1) < ordering.sort_key(b, 1)) == (a < b) or (a == b) or abs(a) > 1e300 or abs(b) > 1e300


@given(st.text(), st.text())
def test_strings(a, b):
    points = lambda x: [ord(c) for c in x]
    assert (ordering.sort_key(a, 1) < ordering.sort_key(b, 1)) == (points(a) < points(b))


@given(st.lists(st.lists(st.integers(0, 3), max_size=3), min_size=2, max_size=2))
def test_nested_arrays_prefix_first(pair):
    a, b = pair
    if a and b:
        assert (ordering.nested_key(a) < ordering.nested_key(b)) == (a < b)


@pytest.mark.parametrize(("key", "way", "error"), [(["a"], 1, ValueError), (["a"], None, TypeError), ([("a",)], None, ValueError), ([(1, 1)], None, TypeError), ([("a", 2)], None, TypeError), ({"a": 1}, None, ValueError), (("a", 1), None, ValueError), ("a", 5, TypeError)])
def test_specifications(key, way, error):
    with pytest.raises(error):
        ordering.checked(key, way)


def test_documents(spark):
    order = list(range(len(RANKED)))
    random.Random(3).shuffle(order)
    rows = [(i, json.dumps({"x": json.loads(RANKED[k]), "k": k})) for i, k in enumerate(order)] + [(99, '{"k": -1}')]
    docs = spark.createDataFrame(rows, "_seq long, _doc string").withColumn("_v", F.parse_json("_doc"))
    got = [json.loads(r["_doc"])["k"] for r in documents.find(docs, sort=[("x", 1)]).collect()]
    assert got == [0, 1, -1, *range(2, len(RANKED))]
    down = [json.loads(r["_doc"])["k"] for r in documents.find(docs, sort=[("x", -1)]).collect()]
    assert down[:2] == [14, 13] and down[-1] == 0


def test_typed_arrays(spark):
    df = spark.createDataFrame([(1, [3, 1]), (2, []), (3, None), (4, [None, 9]), (5, [2])], "n long, a array<long>")
    assert [r["n"] for r in documents.find(df, sort=[("a", 1)], sequence="n").collect()] == [2, 3, 4, 1, 5]
    assert [r["n"] for r in documents.find(df, sort=[("a", -1)], sequence="n").collect()] == [4, 1, 5, 3, 2]


def test_three_keys(spark):
    rows = [(a, b, c) for a, b, c in itertools.product((1, 2), (1, 2), (1, 2))]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "a long, b long, c long")
    got = [tuple(r) for r in documents.find(df, sort=[("a", 1), ("b", -1), ("c", 1)]).collect()]
    assert got == sorted(rows, key=lambda r: (r[0], -r[1], r[2]))


def _value(draw: random.Random, depth: int = 0):
    kind = draw.randrange(12 if depth < 2 else 8)
    if kind < 8:
        big = draw.choice([2**53, 2**53 + 1, 2**53 + 2, -(2**60) - 1, -(2**60), 10**45, 10**45 + 1])
        return (None, draw.randrange(-3, 4), draw.choice([0.5, -0.0, 1e30, 2.0]), draw.choice(["", "a", "ab", "a\x00", "ü", "\U0001f600", "\uffff"]), True, False, big, draw.randrange(-3, 4) / 2)[kind]
    if kind < 10:
        return [_value(draw, depth + 1) for _ in range(draw.randrange(4))]
    return {name: _value(draw, depth + 1) for name in draw.sample(["b", "c"], draw.randrange(3))}


@pytest.mark.parametrize("path", ["x", "x.b", "x.b.c"])
@pytest.mark.parametrize("way", [1, -1])
def test_keys_against_plain_python(spark, path, way):
    draw = random.Random(f"{path}{way}")
    docs = [{"x": _value(draw)} if draw.random() < 0.9 else {} for _ in range(700)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "_seq long, _doc string").repartition(3).withColumn("_v", F.parse_json("_doc"))
    got = [r["_seq"] for r in documents.find(df, sort=[(path, way)]).collect()]
    key = lambda i: ordering.sort_key(ordering.lookup(docs[i], tuple(path.split(".")), way), way)
    assert got == sorted(range(len(docs)), key=key, reverse=way == -1) if way == 1 else [key(i) for i in got] == sorted(map(key, range(len(docs))), reverse=True)


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_places(spark, tmp_path, n):
    """Of all rows, over several ranges, where nearly all have the same first key, and some none."""
    draw = random.Random(n)
    rows = [(i, draw.choice([None, 1.5, -0.5, *[7.0] * 40])) for i in range(n)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "n long, x double").repartition(3)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = ordering.placed(df, [F.col("x").desc_nulls_last(), F.col("n").asc()], ["n"], f"{tmp_path}/places")
        got = sorted((r["pos"], r["n"]) for r in placed.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0.0), r[0]))
    assert got == [(i + 1, r[0]) for i, r in enumerate(want)]
    assert dict(placed.dtypes) == {"n": "bigint", "pos": "int"}


def test_places_of_documents(spark, tmp_path):
    draw = random.Random(5)
    docs = [{"x": _value(draw), "y": draw.choice([1, "a", None])} for _ in range(500)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "_seq long, _doc string").repartition(3).withColumn("_v", F.parse_json("_doc"))
    placed = ordering.placed_documents(df, [("y", -1), ("x", 1)], f"{tmp_path}/places")
    want = [r["_seq"] for r in documents.find(df, sort=[("y", -1), ("x", 1)]).collect()]
    assert sorted((r["pos"], r["_seq"]) for r in placed.collect()) == list(enumerate(want, 1))
    assert not (tmp_path / "places" / "keys").exists()


@pytest.mark.parametrize("way", [1, -1])
def test_places_by_arrays_move_no_array(spark, tmp_path, way):
    draw = random.Random(way)
    rows = [(i, draw.choice([None, [], [None, 2], [None]]) if i % 5 == 0 else [draw.randrange(9) for _ in range(200)]) for i in range(400)]
    df = spark.createDataFrame(rows, "n long, a array<long>").repartition(3)
    store, group = spark.sparkContext._jsc.sc().statusStore(), f"arrays-{way}"
    df.write.parquet(f"{tmp_path}/in")
    spark.sparkContext.setJobGroup(group, group)
    try:
        placed = ordering.placed_rows(spark.read.parquet(f"{tmp_path}/in"), [("a", way), ("n", 1)], ["n"], f"{tmp_path}/places")
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    want = [r["n"] for r in documents.find(df, sort=[("a", way)], sequence="n").collect()]
    assert sorted((r["pos"], r["n"]) for r in placed.collect()) == list(enumerate(want, 1))
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)}
    assert 0 < sum(store.stageAttempt(s, 0, False, None, False, None)._1().shuffleWriteBytes() for s in stages) < 40 * len(rows)
