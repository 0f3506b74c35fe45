"""The driver's contract on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from doclith import queries as engine

DATA = entry.DATA


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", engine.ALL)
def test_against_duckdb(spark, duck, name):
    got = engine.ALL[name].run(spark, DATA)
    names = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(names)} FROM ({engine.ALL[name].sql})").fetchall()
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["sort_three", "sort_mixed", "sort_mixed_down", "sort_one", "sort_two", "sort_array_up", "sort_array_down"])
def test_no_task_sorts_the_table(spark, name):
    held = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    status, group = spark.sparkContext._jsc.sc().statusStore(), f"sorts-{name}"
    for k, v in held.items():
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup(group, group)
    try:
        rows = len(engine.ALL[name].run(spark, DATA).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sparkContext._jsc.clearJobGroup()
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)}
    tasks = [t for s in stages for t in map(status.taskList(s, 0, 1000).apply, range(status.taskList(s, 0, 1000).size()))]
    read = [t.taskMetrics().get().shuffleReadMetrics().recordsRead() for t in tasks if t.taskMetrics().isDefined()]
    assert rows and sum(read) >= rows and max(read) < rows / 2
