"""Components: both ways against a plain union, and how many tasks the similarity join gives the driver to keep."""

from __future__ import annotations

import random

import numpy as np
import pytest

from doclith.llm import components, jaccard


def union(links):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in links:
        if u != v:
            a, b = top(u), top(v)
            root[max(a, b)] = min(a, b)
    return {x: top(x) for x in root}


def links():
    chance = random.Random(4)
    name = [chance.randrange(-(1 << 63), 1 << 63) for _ in range(900)]
    out = [(name[i], name[i + 1]) for i in range(150)]  # a chain
    out += [(name[200], name[i]) for i in range(201, 400)]  # a star
    out += [(name[chance.randrange(400, 800)], name[chance.randrange(400, 800)]) for _ in range(230)]
    out += [(v, u) for u, v in out[::3]] + out[::7] + [(name[850], name[850])]
    chance.shuffle(out)
    return out


@pytest.mark.parametrize("few", [components.FEW, 0])
def test_components_both_ways(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    rows = links()
    got = components.components(spark.createDataFrame(rows, "u long, v long").repartition(3)).collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.component for r in got} == union(rows)
    assert components.components(spark.createDataFrame([(1, 1)], "u long, v long").where("u > 1")).collect() == []


def test_long_chains_are_settled_in_few_rounds():
    """Names in order, in reverse and at random: numbers of a line of 100,000 nodes fall to one."""
    for order in (np.arange(100_000), np.arange(100_000)[::-1], np.random.default_rng(2).permutation(100_000)):
        nodes, found = components._settled(order[:-1], order[1:])
        assert len(nodes) == 100_000 and not found.any()


def test_tasks_of_the_join(spark):
    """Spark's driver keeps a record of every task: over small tables of links the join has few for each partition."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:20], f"x{i}", *base[21:]])) for i in range(40)] + [(i, f"one two {i} four five six") for i in range(40, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    status, group = spark.sparkContext.statusTracker(), "tasks-of-the-join"
    for k, v in held.items():
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = {r.doc_id: r.component_id for r in jaccard.classes(df, k=3, percent=90).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sparkContext._jsc.clearJobGroup()
    assert got == {i: min(i, 0 if i < 40 else i) for i in range(60)}
    stages = {s for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds}
    tasks = sum(x.numCompletedTasks for x in map(status.getStageInfo, stages) if x)
    assert 0 < tasks < 50 * 40
