"""Filters over the uniform documents, as a table with a schema and as documents; both give the same."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from doclith import OperationFailure
from doclith.operators import documents
from doclith.plans.filters import parse
from doclith.streaming import find_stream

SCHEMA = """_id string, count bigint, countStr string, countFloat double, countBool boolean, countArray array<bigint>,
countDict struct<odd:boolean,even:boolean,three:boolean,five:boolean>, nestedArray array<array<bigint>>, dictArray array<struct<number:bigint>>,
mixedDict struct<count:bigint,countStr:string,countBool:boolean,countArray:array<bigint>,countDict:struct<odd:boolean,even:boolean,three:boolean,five:boolean>>"""


def uniform(n: int) -> dict:
    flags = {"odd": n % 2 == 1, "even": n % 2 == 0, "three": n % 3 == 0, "five": n % 5 == 0}
    row = {"count": n, "countStr": str(n), "countFloat": n + 0.1, "countBool": n % 2 == 1, "countArray": list(range(n, n + 5)), "countDict": flags}
    row |= {"nestedArray": [[i] for i in range(n, n + 5)], "dictArray": [{"number": i} for i in range(n, n + 5)]}
    return {"_id": f"id{n}"} | row | {"mixedDict": {k: row[k] for k in ("count", "countStr", "countBool", "countArray", "countDict")}}


@pytest.fixture(scope="module")
def typed(spark):
    return spark.createDataFrame([uniform(n) for n in range(100)], SCHEMA).cache()


@pytest.fixture(scope="module")
def dynamic(spark, typed):
    text = F.to_json(F.struct(*typed.columns))
    return typed.select(F.col("count").alias("_seq"), F.to_json(F.struct("_id")).alias("_id"), text.alias("_doc")).withColumn("_v", F.parse_json("_doc")).cache()


GOLDEN = [
    ({}, 100),
    ({"count": {"$gte": 50}}, 50),
    ({"mixedDict.count": 0}, 1),
    ({"mixedDict.count": {"$gte": 50}}, 50),
    ({"mixedDict.countDict.even": True}, 50),
    ({"count": {"$gte": 50, "$lt": 51}}, 1),
    ({"count": {"$gt": 50, "$lte": 51}}, 1),
    ({"count": {"$ne": 50}}, 99),
    ({"countStr": {"$regex": "[5]{1,2}"}}, 11),
    ({"countStr": {"$regex": "[^5][5]{1}"}}, 8),
    ({"countStr": {"$regex": "5"}}, 11),
    ({"count": {"$in": [22, 44, 66, 88]}}, 4),
    ({"countStr": {"$in": ["11", "33", "55", "77", "99"]}}, 5),
    ({"countArray": {"$in": [22, 50]}}, 10),
    ({"countArray": {"$all": [22, 23]}}, 4),
    ({"countArray": 22}, 5),
    ({"countArray": {"$not": {"$in": [22, 50]}}}, 90),
    ({"countArray": [3, 4, 5, 6, 7]}, 1),
    ({"nestedArray": [7]}, 5),
    ({"dictArray": {"number": 7}}, 5),
    ({"countDict": {"odd": True, "even": False, "three": True, "five": True}}, 3),
    ({"countDict": {"odd": True}}, 0),
    ({"$and": [{"count": {"$gt": 10}}, {"count": {"$lte": 50}}]}, 40),
    ({"$or": [{"count": {"$lt": 10}}, {"count": {"$gte": 90}}]}, 20),
    ({"$or": [{"count": {"$gte": 10, "$lt": 20}, "countBool": True}, {"count": 0}]}, 6),
    ({"count": {"$not": {"$gte": 90, "$lt": 10}}}, 80),
    ({"mixedDict.count": {"$not": {"$gte": 50}}}, 50),
    ({"mixedDict.countStr": {"$regex": "5"}}, 11),
    ({"countStr": {"$not": {"$regex": "5"}}}, 89),
    ({"$and": [{}]}, 100),
    ({"countStr": {"$gte": 50}}, 0),
    ({"count": {"$gte": "50"}}, 0),
    ({"count": True}, 0),
    ({"countBool": 1}, 0),
    ({"count": 5.0}, 1),
    ({"count": {"$in": [1, 2.0, "3", None]}}, 2),
    ({"count": None}, 0),
    ({"count": {"$ne": None}}, 100),
    ({"nothing": {"$ne": 1}}, 0),
    ({"nothing": {"$not": {"$in": [1]}}}, 0),
    ({"count": {"$ne": "x"}}, 100),
    ({"countArray": {"$ne": [3, 4, 5, 6, 7]}}, 99),
    ({"count": {"$in": []}}, 0),
    ({"countArray": {"$all": []}}, 100),
]


@pytest.mark.parametrize(("query", "n"), GOLDEN, ids=[str(q) for q, _ in GOLDEN])
def test_counts(typed, dynamic, query, n):
    assert documents.find(typed, query).count() == n
    assert documents.find(dynamic, query).count() == n


def test_null_and_missing(spark):
    docs = spark.createDataFrame([(1, '{"a": null}'), (2, "{}"), (3, '{"a": 1}'), (4, '{"a": [1, null]}'), (5, '{"a.b": 2}'), (6, '{"a": {"b": 2}}')], "_seq long, _doc string").withColumn("_v", F.parse_json("_doc"))
    ids = lambda q: [r["_seq"] for r in documents.find(docs, q).orderBy("_seq").collect()]
    assert ids({"a": None}) == [1, 4]
    assert ids({"a": {"$ne": None}}) == [3, 4, 6]
    assert ids({"a": {"$ne": 1}}) == [1, 4, 6]
    assert ids({"a": 1}) == [3, 4]
    assert ids({"a.b": 2}) == [6]


@pytest.mark.parametrize("query", [{"a": {"$exists": True}}, {"$not": {"a": 1}}, {"a": {}}, {"a": {"$in": (1,)}}, {"$and": []}, {"$or": {}}, {"a": {"$not": [1]}}, {"a": {"$regex": "("}}, {"a": {"$regex": 3}}, "a", {"$nor": []}])
def test_malformed(query):
    with pytest.raises(OperationFailure):
        parse(query)


def test_conditions_reach_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = documents.find(orders, {"o_orderstatus": "F", "o_totalprice": {"$gte": 10, "$lt": 20}}, projection=["o_orderkey"])._jdf.queryExecution().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "GreaterThanOrEqual(" in plan and "o_orderdate" not in plan.split("ReadSchema")[-1]
    plan = documents.find(orders, {"o_orderstatus": {"$regex": "F"}})._jdf.queryExecution().toString()
    assert "StringStartsWith(o_orderstatus,F)" in plan


def test_stream(spark, tmp_path):
    spark.range(20).write.parquet(str(tmp_path / "in"))
    out = find_stream(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), {"id": {"$gte": 15}})
    query = out.writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("found").count() == 5
