"""Clients, collections, cursors and snapshots."""

from __future__ import annotations

import datetime as dt
import json
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from doclith import Client, Codecs, ConfigurationError, DuplicateKeyError, InvalidOperation, OperationFailure, Storage
from doclith.sources.codecs import DateTimeCodec, read_lines, read_tables
from doclith.sources.store import Store


@pytest.fixture
def db(spark, tmp_path):
    return Client(spark, str(tmp_path / "db")).test


@pytest.fixture
def items(db):
    db.items.insert_many([{"_id": n, "count": n, "countStr": str(n), "tags": [n, n + 1]} for n in range(12)])
    return db.items


def test_names(spark, tmp_path):
    client = Client(spark, str(tmp_path / "db"))
    assert client.test.name == "test" and client["test"]["a"].name == "a"
    assert client.test.collection_names() == ["_default"]
    client.test.a.build_table()
    assert client.test.collection_names() == ["_default", "a"]
    assert client.close() is None
    with pytest.raises(AttributeError):
        client._private
    with pytest.raises(AttributeError):
        client.test.a.aggregate


def test_insert(db):
    doc = {"a": 1}
    one = db.c.insert_one(doc)
    assert one.acknowledged and doc["_id"] == one.inserted_id and len(one.inserted_id) == 32 and one.eid == 1
    many = db.c.insert_many([{"_id": "x"}, {"_id": 0, "b": "ü"}])
    assert many.eids == [2, 3] and many.inserted_ids[0] == "x" and many.inserted_ids[1] != 0
    assert db.c.count() == 3 and db.c.find_one({"b": "ü"})["_id"] == many.inserted_ids[1]
    assert db.c.insert([{"_id": "y"}]).inserted_ids == ["y"] and db.c.insert({"_id": "z"}).inserted_id == "z"


def test_insert_refuses(db):
    db.c.insert_one({"_id": "x"})
    for docs in ([{"_id": "x"}], [{"_id": "a"}, {"_id": "a"}], [{"_id": "b"}, {"_id": "x"}]):
        with pytest.raises(DuplicateKeyError):
            db.c.insert_many(docs)
    with pytest.raises(DuplicateKeyError):
        db.c.insert_one({"_id": "x"})
    with pytest.raises(ValueError):
        db.c.insert_one([1])
    with pytest.raises(ValueError):
        db.c.insert_many({"a": 1})
    with pytest.raises(OperationFailure):
        db.c.insert_one({"a": float("nan")})
    assert db.c.count() == 1
    db.c.insert_one({"_id": "x"}, bypass_document_validation=True)
    assert db.c.count() == 2


def test_insert_frame(spark, db):
    db.c.insert_one({"_id": "k5"})
    assert db.c.insert_frame(spark.range(50).repartition(4).select(F.concat(F.lit("n"), "id").alias("_id"), F.col("id").alias("count"))) == 50
    assert db.c.find_one({"count": 7})["_id"] == "n7" and db.c.count() == 51
    assert sorted(r["_seq"] for r in db.c.df.select("_seq").collect()) == list(range(1, 52))
    with pytest.raises(DuplicateKeyError):
        db.c.insert_frame(spark.createDataFrame([("n7",)], "_id string"))
    assert db.c.insert_frame(spark.range(3)) == 3


def test_find(items):
    assert items.find().count() == items.find({}).count() == items.find(filter={}).count() == 12
    assert [d["count"] for d in items.find({"count": {"$gte": 10}})] == [10, 11]
    assert items.find_one({"count": 3})["countStr"] == "3" and items.find_one({"count": 99}) is None and items.find_one()["count"] == 0
    assert [d["count"] for d in items.find({"tags": 5})] == [4, 5]
    assert [d["count"] for d in items.find(sort=[("count", -1)], skip=1, limit=3)] == [10, 9, 8]
    assert [d["count"] for d in items.find(skip=10)] == [10, 11] and list(items.find(skip=50)) == []
    assert items.find({"count": 3})["countStr"] == "3"


def test_cursor(items):
    cursor = items.find({"count": {"$gte": 10}}).sort("count", 1)
    assert cursor.hasNext() and cursor.next()["count"] == 10 and cursor.next()["count"] == 11 and not cursor.hasNext()
    with pytest.raises(IndexError):
        cursor.next()
    assert cursor[0]["count"] == 10 and [d["count"] for d in cursor] == [10, 11] and cursor.count() == cursor.count(True) == 2
    with pytest.raises(IndexError):
        cursor[2]
    assert [d["count"] for d in items.find(limit=3).sort("count", -1)] == [2, 1, 0]
    assert [d["count"] for d in items.find().paginate(4, 2)] == [4, 5]
    with pytest.raises(ValueError):
        items.find().sort(["count"], 1)


def test_update(items):
    done = items.update_one({"count": 3}, {"$set": {"countStr": "three", "new": {"a": [1]}}})
    assert done.raw_result == [4] and items.find_one({"count": 3}) == {"_id": 3, "count": 3, "countStr": "three", "tags": [3, 4], "new": {"a": [1]}}
    assert items.update_one({"count": {"$gte": 5}}, {"x": 1}).raw_result == [6]
    assert items.update_many({"count": {"$gte": 10}}, {"$set": {"x": 2}}).modified_count == 2
    assert [d["count"] for d in items.find({"x": {"$gte": 1}})] == [5, 10, 11]
    assert items.update_one({"count": 99}, {"x": 3}).raw_result == []
    assert [r.raw_result for r in items.update({"count": 0}, [{"y": 1}, {"y": 2}])] == [[1], [1]] and items.find_one({"count": 0})["y"] == 2
    with pytest.raises(OperationFailure):
        items.update_one({}, {"$inc": {"count": 1}})


def test_delete(items):
    assert items.delete_one({"count": 3}).deleted_count == 1 and items.count() == 11
    assert items.delete_one({"count": 3}).deleted_count == 0
    assert items.delete_many({"count": {"$gte": 6}}).deleted_count == 6 and items.count() == 5
    assert items.remove({"count": 0}, multi=False).deleted_count == 1
    assert items.delete_many({"missing": 1}).deleted_count == 0
    assert items.delete_many({}).deleted_count == 4 and items.count() == 0
    assert items.insert_one({"a": 1}).eid == 1
    assert items.drop() is True and items.drop() is False


def test_snapshots(spark, db):
    db.c.insert_one({"_id": 1})
    held = db.c.df
    db.c.insert_one({"_id": 2})
    assert held.count() == 1 and db.c.df.count() == 2
    store: Store = db.c._store
    old = store.manifest()
    db.c.insert_one({"_id": 3})
    with pytest.raises(OperationFailure):
        store.commit(old, [], 0, 0)
    for n in range(4, 8):
        db.c.update_many({}, {"n": n})
    assert len(store.files.names(f"{store.path}/manifests")) == 2 and db.c.find({"n": 7}).count() == 3


def test_table(spark, db):
    table = db.attach("nation", spark.read.parquet("/root/testdata/sf0.001/nation.parquet"), "n_nationkey")
    assert db.nation is table and table.count() == 25 and table.find_one({"n_nationkey": 4})["n_nationkey"] == 4
    assert "nation" in db.collection_names() and table.find({"n_regionkey": 1}, projection=["n_name"]).df.columns == ["n_name"]
    with pytest.raises(InvalidOperation):
        table.insert_one({})


def test_sources(spark, tmp_path):
    path = tmp_path / "old.json"
    path.write_text(json.dumps({"_default": {}, "users": {"1": {"a": 1}, "2": {"a": [None]}}}))
    rows = read_tables(spark, str(path)).orderBy("eid").collect()
    assert [(r["table"], r["eid"], json.loads(r["_doc"])) for r in rows] == [("users", 1, {"a": 1}), ("users", 2, {"a": [None]})]
    lines = tmp_path / "lines.json"
    lines.write_text('{"item": 1}\n\n{"item": "x"}\nnot json\n')
    df = read_lines(spark, str(lines))
    assert df.count() == 3 and df.where("_v IS NULL").count() == 1


def test_codec(spark):
    codec, at = DateTimeCodec(), dt.datetime(2024, 5, 6, 7, 8, 9, 123)
    assert codec.decode(codec.encode(at)) == at.replace(microsecond=0)
    df = spark.createDataFrame([(at,)], "t timestamp_ntz")
    assert df.select(codec.encode_column(F.col("t")).alias("s")).first()["s"] == "2024-05-06T07:08:09"


def test_one_of_two_writers_wins(spark, db):
    """Both have read one manifest; whoever publishes the next number second fails, and no write is lost."""
    from concurrent.futures import ThreadPoolExecutor

    db.c.build_table()
    files = db.c._store.files
    names = [f"{db.c._store.path}/manifests/{n:010d}.json" for n in range(50, 60)]
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: files.publish(names[k % 10], str(k)), range(80)))
    assert sum(won) == 10 and all(int(files.read(n)) % 10 == i for i, n in enumerate(names))
    assert not [n for n in files.names(f"{db.c._store.path}/manifests") if not n.endswith(".json")]


def test_compaction_and_late_results(db):
    for n in range(4):
        db.c.insert_one({"_id": n + 1})
    db.c.compact()
    assert len(db.c._store.manifest().parts) == 1 and [d["_id"] for d in db.c.find()] == [1, 2, 3, 4]
    done = db.c.update_many({}, {"x": 1})
    assert done.matched_count == 4 and done.raw_result == [1, 2, 3, 4]
    assert db.c.find()[-1]["_id"] == 4 and db.c.find()[3]["x"] == 1
    with pytest.raises(IndexError):
        db.c.find()[-5]


class Fractions:
    kind, sorts = Fraction, False
    encode = staticmethod(str)
    decode = staticmethod(Fraction)


def test_codecs_in_collections(spark, tmp_path):
    storage = Storage(codecs=Codecs({"TinyDate": DateTimeCodec(), "ratio": Fractions()}))
    c = Client(spark, str(tmp_path / "db"), storage).test.c
    day = lambda n: dt.datetime(2024, 5, n, 6, 7, 8)
    c.insert_many([{"_id": n, "at": day(n), "all": [day(n), {"x": day(1)}], "part": Fraction(n, 3)} for n in range(1, 9)] + [{"_id": "text", "at": "2024-05-05"}, {"_id": "z", "at": "~"}, {"_id": "k", "at": 7}])
    found = lambda query: [d["_id"] for d in c.find(query)]
    assert c.find_one({"_id": 3}) == {"_id": 3, "at": day(3), "all": [day(3), {"x": day(1)}], "part": Fraction(1)}
    assert found({"at": day(4)}) == [4] == found({"all": day(4)}) and found({"at": {"$in": [day(2), "~"]}}) == [2, "z"]
    assert found({"at": {"$gte": day(7)}}) == [7, 8] and found({"at": {"$lt": day(3)}}) == [1, 2] and found({"at": {"$gt": day(2), "$lte": day(4)}}) == [3, 4]
    assert found({"at": {"$not": {"$gte": day(2)}}}) == [1] and found({"$or": [{"at": {"$lte": day(1)}}, {"part": Fraction(8, 3)}]}) == [1, 8]
    assert found({"at": {"$ne": day(1)}}) == [2, 3, 4, 5, 6, 7, 8, "text", "z", "k"] and found({"all": {"$all": [day(5), {"x": day(1)}]}}) == [5]
    with pytest.raises(OperationFailure):
        found({"part": {"$gt": Fraction(1)}})
    with pytest.raises(OperationFailure):
        c.insert_one({"a": ["{ratio}:1"]})
    assert c.update_one({"at": day(2)}, {"$set": {"at": day(9)}}).modified_count == 1 and c.find_one({"_id": 2})["at"] == day(9)
    assert c.delete_many({"at": {"$gte": day(8)}}).deleted_count == 2 and c.count() == 9
    cursor = c.find({"at": {"$lte": day(9)}}, sort=[("at", -1)])
    assert cursor.next()["at"] == day(7) == cursor[0]["at"] and cursor["at"] == day(7) and [d["_id"] for d in cursor] == [7, 6, 5, 4, 3, 1]
    assert Client(spark, str(tmp_path / "db")).test.c.find_one({"_id": 3})["part"] == "{ratio}:1"


def test_formats_of_parts(spark, tmp_path):
    class Own(Client):
        @property
        def _storage(self):
            return Storage("orc", {"compression": "zlib"}, Codecs({"time": DateTimeCodec()}))

    Client(spark, str(tmp_path / "db")).test.c.insert_one({"_id": 1, "a": "x\n\"y\u2028"})
    held = Own(spark, str(tmp_path / "db")).test.c
    held.insert_one({"_id": 2, "a": [1, None]})
    held.insert_frame(spark.sql("SELECT 3 AS _id, TIMESTAMP_NTZ '2024-01-02 03:04:05.6' AS a UNION ALL SELECT 4, NULL"))
    assert list(held.find({})) == [{"_id": 1, "a": "x\n\"y\u2028"}, {"_id": 2, "a": [1, None]}, {"_id": 3, "a": dt.datetime(2024, 1, 2, 3, 4, 5)}, {"_id": 4}]
    assert len([p for p in held._store.manifest().parts if p.endswith(".orc")]) == 2
    Client(spark, str(tmp_path / "db"), Storage("json")).test.c.compact()
    assert held.count() == 4 and held.find_one({"a": 1})["_id"] == 2 and held.find_one({"a": {"$lt": dt.datetime(2025, 1, 1)}})["_id"] == 3


def test_storage_refuses():
    with pytest.raises(ConfigurationError):
        Storage("csv")
    with pytest.raises(ConfigurationError):
        Codecs({"a": DateTimeCodec(), "b": DateTimeCodec("%Y")})
    with pytest.raises(ConfigurationError):
        Codecs({"a b": DateTimeCodec()})
    assert DateTimeCodec("%Y-%m").sorts and DateTimeCodec().sorts and not DateTimeCodec("%d/%m/%Y").sorts
