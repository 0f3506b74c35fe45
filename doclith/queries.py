"""Queries that apply each operator of the engine to the star schema, and the same in DuckDB's SQL.

Results carry a column for order (pos) where order is what the query is about.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclith.client import Client
from doclith.collection import Collection, Table
from doclith.operators import documents, ordering
from doclith.sources.codecs import Codecs, DateTimeCodec, read_lines, read_tables
from doclith.sources.store import Storage
from doclith.streaming import find_stream


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ALL: dict[str, Query] = {}
LINE = "l_orderkey, l_linenumber, l_quantity"
ORDER = "o_orderkey, o_orderstatus, o_totalprice"
SPLIT = "string_split(p_name, ' ')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part with its name as an array."""
    return table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("names"), "p_size")


def props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as documents: what props holds, in no declared shape."""
    text = F.concat(F.lit('{"event": '), F.col("event_id"), F.lit(', "type": "'), F.col("event_type"), F.lit('", "props": '), F.col("props"), F.lit("}"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("_seq"), F.to_json(F.struct("event_id")).alias("_id"), text.alias("_doc")).withColumn("_v", F.parse_json("_doc"))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose field x is of another type in every few rows, or missing."""
    k = F.col("event_id") % 8
    value = F.when(k == 0, F.lit("null")).when(k == 1, F.col("event_id").cast("string")).when(k == 2, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).when(k == 3, F.lit("true")).when(
        k == 4, F.concat(F.lit("["), F.col("event_id"), F.lit(', "m"]'))
    ).when(k == 5, F.concat(F.lit('{"a": '), F.col("event_id"), F.lit("}"))).when(k == 6, F.lit("[]"))
    text = F.coalesce(F.concat(F.lit('{"x": '), value, F.lit("}")), F.lit("{}"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("_seq"), F.to_json(F.struct("event_id")).alias("_id"), text.alias("_doc")).withColumn("_v", F.parse_json("_doc"))


def _filter(name: str, source: str, columns: str, query: dict | None, sql: str) -> None:
    """A filter on a table, its columns, and the condition in SQL."""
    names = columns.split(", ")
    ALL[name] = Query(lambda s, d: documents.find(table(s, d, source), query, projection=names), f"SELECT {columns} FROM {source} WHERE {sql}")


def _on_words(name: str, query: dict, sql: str) -> None:
    ALL[name] = Query(lambda s, d: documents.find(words(s, d), query, projection=["p_partkey"]), f"SELECT p_partkey FROM (SELECT p_partkey, p_size, {SPLIT} AS names FROM part) WHERE {sql}")


def _on_props(name: str, query: dict, sql: str) -> None:
    ALL[name] = Query(
        lambda s, d: documents.find(props(s, d), query).select(F.col("_seq").alias("event_id")), f"SELECT event_id FROM (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) WHERE {sql}"
    )


def _on_mixed(name: str, query: dict, sql: str) -> None:
    ALL[name] = Query(lambda s, d: documents.find(mixed(s, d), query).select(F.col("_seq").alias("event_id")), f"SELECT event_id FROM (SELECT event_id, event_type, event_id % 8 AS t FROM events) WHERE {sql}")


def _mixed_places(s: SparkSession, d: str, way: int) -> DataFrame:
    return ordering.placed_documents(mixed(s, d), [("x", way)], _shared(s, "places")).withColumnRenamed("_seq", "event_id")


_filter("find_all", "nation", "n_nationkey, n_name, n_regionkey", {}, "true")
_filter("find_none_filter", "region", "r_regionkey, r_name", None, "true")
_filter("eq", "orders", ORDER, {"o_orderstatus": "F"}, "o_orderstatus = 'F'")
_filter("eq_two_fields", "lineitem", LINE, {"l_returnflag": "R", "l_quantity": {"$gte": 45}}, "l_returnflag = 'R' AND l_quantity >= 45")
_filter("gte", "lineitem", LINE, {"l_quantity": {"$gte": 49}}, "l_quantity >= 49")
_filter("gt", "lineitem", LINE, {"l_quantity": {"$gt": 49}}, "l_quantity > 49")
_filter("lte", "lineitem", LINE, {"l_quantity": {"$lte": 2}}, "l_quantity <= 2")
_filter("lt", "lineitem", LINE, {"l_quantity": {"$lt": 2}}, "l_quantity < 2")
_filter("range", "orders", ORDER, {"o_totalprice": {"$gte": 1000, "$lt": 50000.5}}, "o_totalprice >= 1000 AND o_totalprice < 50000.5")
_filter("range_dates", "orders", ORDER, {"o_orderdate": {"$gte": dt.datetime(1995, 1, 1), "$lt": dt.datetime(1996, 1, 1)}}, "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
_filter("ne", "events", "event_id, event_type", {"event_type": {"$ne": "click"}}, "event_type <> 'click'")
_filter("not_operators", "lineitem", LINE, {"l_quantity": {"$not": {"$gte": 40, "$lt": 10}}}, "l_quantity < 40 AND l_quantity >= 10")
_filter("not_value", "part", "p_partkey, p_size", {"p_size": {"$not": 7}}, "p_size <> 7")
_filter("not_in", "part", "p_partkey, p_size", {"p_size": {"$not": {"$in": [1, 2, 3]}}}, "p_size NOT IN (1, 2, 3)")
_filter("not_regex", "part", "p_partkey", {"p_brand": {"$not": {"$regex": "Brand#1"}}}, "NOT regexp_matches(p_brand, '^(?:Brand#1)')")
_filter("regex", "part", "p_partkey, p_brand", {"p_brand": {"$regex": "Brand#[12]"}}, "regexp_matches(p_brand, '^(?:Brand#[12])')")
_filter("regex_prefix", "customer", "c_custkey, c_mktsegment", {"c_mktsegment": {"$regex": "B"}}, "regexp_matches(c_mktsegment, '^(?:B)')")
_filter("in_values", "customer", "c_custkey, c_mktsegment", {"c_mktsegment": {"$in": ["BUILDING", "MACHINERY"]}}, "c_mktsegment IN ('BUILDING', 'MACHINERY')")
_filter("and", "orders", ORDER, {"$and": [{"o_orderstatus": "O"}, {"o_totalprice": {"$gt": 200000}}]}, "o_orderstatus = 'O' AND o_totalprice > 200000")
_filter("or", "orders", ORDER, {"$or": [{"o_totalprice": {"$lt": 2000}}, {"o_totalprice": {"$gte": 300000}}]}, "o_totalprice < 2000 OR o_totalprice >= 300000")
_filter("or_compound", "orders", ORDER, {"$or": [{"o_orderstatus": "F", "o_totalprice": {"$gte": 1000, "$lt": 60000}}, {"o_orderkey": 7}]}, "(o_orderstatus = 'F' AND o_totalprice >= 1000 AND o_totalprice < 60000) OR o_orderkey = 7")
_filter("nested_logic", "orders", ORDER, {"$and": [{"$or": [{"o_orderstatus": "F"}, {"o_orderstatus": "P"}]}, {"$or": [{"o_totalprice": {"$gt": 150000}}, {"o_orderkey": {"$lte": 100}}]}]}, "o_orderstatus IN ('F', 'P') AND (o_totalprice > 150000 OR o_orderkey <= 100)")
_filter("type_mismatch", "orders", ORDER, {"o_totalprice": {"$gte": "50"}}, "false")
_filter("missing_field", "orders", ORDER, {"no_such_field": {"$ne": 1}}, "false")
_on_words("eq_element", {"names": "ring"}, "list_contains(names, 'ring')")
_on_words("in_elements", {"names": {"$in": ["ring", "red"]}}, "list_has_any(names, ['ring', 'red'])")
_on_words("all_elements", {"names": {"$all": ["ring", "red"]}}, "list_has_all(names, ['ring', 'red'])")
_on_words("not_all_elements", {"names": {"$not": {"$all": ["ring", "red"]}}}, "NOT list_has_all(names, ['ring', 'red'])")
_on_words("array_literal", {"names": ["red", "ring"]}, "names = ['red', 'ring']")
_on_words("regex_element", {"names": {"$regex": "r"}}, "len(list_filter(names, lambda x: starts_with(x, 'r'))) > 0")
_on_props("path", {"props.k": {"$gte": 50}}, "k >= 50")
_on_props("path_eq", {"props.k": 7}, "k = 7")
_on_props("path_regex", {"type": {"$regex": "c"}}, "starts_with(event_type, 'c')")
_on_props("path_in", {"props.k": {"$in": [1, 2.0, "3"]}}, "k IN (1, 2)")
_on_props("path_not", {"props.k": {"$not": {"$gte": 20, "$lt": 10}}}, "k < 20 AND k >= 10")
_on_props("path_type_guard", {"props.k": "7"}, "false")
_on_props("sub_document", {"props": {"k": 7}}, "k = 7")
_on_props("path_or", {"$or": [{"props.k": {"$lt": 5}}, {"type": "click"}]}, "k < 5 OR event_type = 'click'")
_on_mixed("mixed_null", {"x": None}, "t = 0")
_on_mixed("mixed_ne_null", {"x": {"$ne": None}}, "t NOT IN (0, 7)")
_on_mixed("mixed_bool", {"x": True}, "t = 3")
_on_mixed("mixed_number", {"x": {"$gte": 100}}, "t = 1 AND event_id >= 100")
_on_mixed("mixed_string", {"x": {"$gte": "c"}}, "t = 2 AND event_type >= 'c'")
_on_mixed("mixed_element", {"x": "m"}, "t = 4")
_on_mixed("mixed_all", {"x": {"$all": ["m"]}}, "t = 4")
_on_mixed("mixed_empty_array", {"x": []}, "t = 6")
_on_mixed("mixed_path", {"x.a": {"$lt": 500}}, "t = 5 AND event_id < 500")
_on_mixed("mixed_ne", {"x": {"$ne": "m"}}, "t <> 7")

ALL["null_literal"] = Query(
    lambda s, d: documents.find(table(s, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("status")), {"status": None}, projection=["o_orderkey"]), "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'F') IS NULL"
)
ALL["struct_path"] = Query(
    lambda s, d: documents.find(table(s, d, "orders").select("o_orderkey", F.struct(F.struct("o_orderstatus", "o_totalprice").alias("b")).alias("a")), {"a.b.o_totalprice": {"$gt": 250000}, "a.b.o_orderstatus": "O"}, projection=["o_orderkey"]),
    "SELECT o_orderkey FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'O'",
)
ALL["struct_literal"] = Query(
    lambda s, d: documents.find(table(s, d, "nation").select("n_nationkey", F.struct("n_name", "n_regionkey").alias("a")), {"$or": [{"a": {"n_name": "FRANCE", "n_regionkey": 3}}, {"a": {"n_name": "NATION_3", "n_regionkey": 3}}]}, projection=["n_nationkey"]),
    "SELECT n_nationkey FROM nation WHERE n_regionkey = 3 AND n_name IN ('FRANCE', 'NATION_3')",
)


def _sorted(s: SparkSession, d: str, name: str, keys: list, columns: str, unique: str) -> DataFrame:
    return ordering.placed_rows(table(s, d, name), ordering.checked([*keys, (unique, 1)]), columns.split(", "), _shared(s, "places"))


for _name, _keys, _sql in (
    ("sort_one", [("o_totalprice", -1)], "o_totalprice DESC"),
    ("sort_two", [("o_orderstatus", 1), ("o_totalprice", -1)], "o_orderstatus, o_totalprice DESC"),
    ("sort_three", [("o_orderstatus", -1), ("o_orderpriority", 1), ("o_orderdate", -1)], "o_orderstatus DESC, o_orderpriority, o_orderdate DESC"),
):
    ALL[_name] = Query(lambda s, d, k=_keys: _sorted(s, d, "orders", k, ORDER, "o_orderkey"), f"SELECT {ORDER}, row_number() OVER (ORDER BY {_sql}, o_orderkey)::INTEGER AS pos FROM orders")
for _way, _least, _order in ((1, "list_min", "ASC"), (-1, "list_max", "DESC")):
    ALL["sort_array_up" if _way == 1 else "sort_array_down"] = Query(
        lambda s, d, w=_way: _sorted(s, d, "embeddings", [("embedding", w)], "vec_id", "vec_id"), f"SELECT vec_id, row_number() OVER (ORDER BY {_least}(embedding) {_order}, vec_id)::INTEGER AS pos FROM embeddings"
    )
ALL["sort_mixed"] = Query(
    lambda s, d: _mixed_places(s, d, 1),
    "SELECT event_id, row_number() OVER (ORDER BY CASE t WHEN 6 THEN 0 WHEN 0 THEN 1 WHEN 7 THEN 1 WHEN 1 THEN 2 WHEN 4 THEN 2 WHEN 2 THEN 3 WHEN 5 THEN 4 ELSE 5 END, CASE WHEN t IN (1, 4, 5) THEN event_id END, CASE WHEN t = 2 THEN event_type END, event_id)::INTEGER AS pos FROM (SELECT event_id, event_type, event_id % 8 AS t FROM events)",
)
ALL["sort_mixed_down"] = Query(
    lambda s, d: _mixed_places(s, d, -1),
    "SELECT event_id, row_number() OVER (ORDER BY CASE t WHEN 6 THEN 0 WHEN 0 THEN 1 WHEN 7 THEN 1 WHEN 1 THEN 2 WHEN 4 THEN 3 WHEN 2 THEN 3 WHEN 5 THEN 4 ELSE 5 END DESC, CASE WHEN t = 2 THEN event_type WHEN t = 4 THEN 'm' END DESC, CASE WHEN t IN (1, 5) THEN event_id END DESC, event_id)::INTEGER AS pos FROM (SELECT event_id, event_type, event_id % 8 AS t FROM events)",
)
ALL["page"] = Query(
    lambda s, d: documents.find(table(s, d, "customer"), {}, sort=[("c_custkey", 1)], skip=20, limit=20, projection=["c_custkey", "c_name"]), "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 20"
)
ALL["page_unaligned"] = Query(
    lambda s, d: Table("customer", table(s, d, "customer"), "c_custkey").find({"c_acctbal": {"$gt": 0}}, sort="c_custkey", skip=7, limit=20).df.select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 20 OFFSET 7"
)
ALL["top_k"] = Query(
    lambda s, d: documents.find(table(s, d, "lineitem"), {}, sort=[("l_extendedprice", -1), ("l_orderkey", 1), ("l_linenumber", 1)], limit=20).select("l_orderkey", "l_linenumber", "l_extendedprice"),
    "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20",
)
ALL["find_one"] = Query(
    lambda s, d: documents.first(table(s, d, "orders"), {"o_orderstatus": "F"}, "o_orderkey").select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 1"
)
ALL["count"] = Query(lambda s, d: table(s, d, "lineitem").agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM lineitem")
ALL["count_filtered"] = Query(lambda s, d: documents.find(table(s, d, "lineitem"), {"l_quantity": {"$gte": 10, "$lt": 20}}).agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20")
ALL["insert_duplicate_check"] = Query(
    lambda s, d: documents.duplicates(table(s, d, "orders").where("o_orderkey % 2 = 0"), table(s, d, "orders").where("o_orderkey % 3 = 0").union(table(s, d, "orders").where("o_orderkey % 15 = 0")), "o_orderkey"),
    "SELECT o_orderkey FROM orders WHERE o_orderkey % 6 = 0 OR o_orderkey % 15 = 0",
)
ALL["insert_numbering"] = Query(
    lambda s, d: documents.numbered(table(s, d, "customer").select("c_custkey"), 100).agg(F.count(F.lit(1)).alias("n"), F.min("_seq").alias("low"), F.max("_seq").alias("high"), F.count_distinct("_seq").alias("kinds")),
    "SELECT count(*) AS n, 101::BIGINT AS low, 100 + count(*) AS high, count(*) AS kinds FROM customer",
)
ALL["update_many"] = Query(
    lambda s, d: documents.updated(table(s, d, "customer"), {"c_mktsegment": "BUILDING"}, {"$set": {"c_mktsegment": "HOUSING", "c_acctbal": 0}}).select("c_custkey", "c_mktsegment", "c_acctbal"),
    "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSING' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0::DOUBLE ELSE c_acctbal END AS c_acctbal FROM customer",
)
ALL["update_first"] = Query(
    lambda s, d: documents.updated(table(s, d, "customer"), {"c_mktsegment": "BUILDING"}, {"c_name": "first"}, "c_custkey", once=True).select("c_custkey", "c_name"),
    "SELECT c_custkey, CASE WHEN c_custkey = (SELECT min(c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'first' ELSE c_name END AS c_name FROM customer",
)
ALL["update_documents"] = Query(
    lambda s, d: documents.updated(props(s, d), {"props.k": {"$gte": 50}}, {"$set": {"big": True}}).select(F.col("_seq").alias("event_id"), F.coalesce(F.try_variant_get("_v", "$.big", "boolean"), F.lit(False)).alias("big")),
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) >= 50 AS big FROM events",
)
ALL["delete_many"] = Query(
    lambda s, d: documents.remaining(table(s, d, "supplier").select("s_suppkey", F.nullif("s_nationkey", F.lit(3)).alias("nation")), {"nation": {"$gte": 10}}).select("s_suppkey"), "SELECT s_suppkey FROM supplier WHERE NOT coalesce(nullif(s_nationkey, 3) >= 10, false)"
)
ALL["delete_first"] = Query(
    lambda s, d: documents.remaining(table(s, d, "supplier"), {"s_nationkey": {"$gte": 10}}, "s_suppkey", once=True).select("s_suppkey"), "SELECT s_suppkey FROM supplier WHERE s_suppkey <> (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey >= 10)"
)
ALL["delete_documents"] = Query(lambda s, d: documents.remaining(mixed(s, d), {"x": {"$gte": 0}}).select(F.col("_seq").alias("event_id")), "SELECT event_id FROM events WHERE event_id % 8 <> 1")
ALL["datetime_codec"] = Query(
    lambda s, d: table(s, d, "events").select("event_id", DateTimeCodec().encode_column(F.col("ts")).alias("text"), DateTimeCodec().decode_column(DateTimeCodec().encode_column(F.col("ts"))).alias("ts")),
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS text, date_trunc('second', ts)::TIMESTAMP AS ts FROM events",
)


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter on a stream of the events file, run to its end into a table in the shared folder."""
    source, at = table(spark, sf_dir, "events"), _shared(spark, "find-stream")
    files = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir) if not sf_dir.endswith(".parquet") else spark.readStream.schema(source.schema).parquet(sf_dir)
    out = find_stream(files, {"event_type": "click", "value": {"$gte": 50}}, ["event_id", "value"])
    out.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/rows").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/rows")


ALL["find_stream"] = Query(_streamed, "SELECT event_id, value FROM events WHERE event_type = 'click' AND value >= 50")


def _shared(spark: SparkSession, name: str) -> str:
    """A new folder that the cluster shares."""
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _collection(change: Callable[[Collection], object], fields: str = "s_suppkey long, s_nationkey long, s_acctbal double, seen long") -> Callable[[SparkSession, str], DataFrame]:
    """supplier as a collection of documents in a store, after a change; its fields by type."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        held = Client(spark, _shared(spark, "collection")).main.suppliers
        held.insert_frame(table(spark, sf_dir, "supplier").withColumn("_id", F.col("s_suppkey").cast("string")))
        change(held)
        return held.df.select(*(F.try_variant_get("_v", f"$.{n}", k).alias(n) for n, k in (f.split(" ") for f in fields.split(", "))))

    return run


def _read_back(name: str, write: Callable[[DataFrame, str], object], read: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _shared(spark, name)
        write(table(spark, sf_dir, "nation").select(F.to_json(F.struct("n_nationkey", "n_name")).alias("value"), "n_nationkey"), path)
        return read(spark, path).select(F.get_json_object("_doc", "$.n_nationkey").cast("int").alias("n_nationkey"), F.get_json_object("_doc", "$.n_name").alias("n_name"))

    return run


def _one_file(df: DataFrame, path: str) -> None:
    entry = F.concat(F.lit('"'), F.col("n_nationkey").cast("string"), F.lit('":'), F.col("value"))
    df.agg(F.concat(F.lit('{"_default": {}, "nation": {'), F.array_join(F.collect_list(entry), ","), F.lit("}}")).alias("value")).coalesce(1).write.text(path)


def _said(spark: SparkSession, **values: object) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], list(values))


def _cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    cursor = Table("orders", table(spark, sf_dir, "orders"), "o_orderkey").find({"o_orderstatus": "F"}, sort="o_orderkey")
    first, second = cursor.next(), cursor.next()
    return _said(spark, n=cursor.count(), first=first["o_orderkey"], second=second["o_orderkey"], tenth=cursor[9]["o_orderkey"], more=cursor.hasNext(), last=cursor["o_orderkey"])


def _drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Client(spark, _shared(spark, "collection")).main
    before = db.a.insert_many([{"n": n} for n in range(5)])
    one = db.a.insert({"n": 5})
    names = ",".join(db.collection_names())
    return _said(spark, eids=sum(before.eids) + one.eid, names=names, n=db.a.count(), dropped=db.a.drop(), again=db.a.drop(), n_after=db.a.count())


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as documents in ORC with times by a codec, found by time."""
    storage = Storage("orc", {"compression": "zstd"}, Codecs({"time": DateTimeCodec()}))
    held = Client(spark, _shared(spark, "collection"), storage).main.events
    held.insert_frame(table(spark, sf_dir, "events").select("event_id", "ts"))
    found = held.find({"ts": {"$gte": dt.datetime(2024, 1, 8), "$not": {"$gte": dt.datetime(2024, 1, 20, 12)}}})
    return found.df.select(F.try_variant_get("_v", "$.event_id", "long").alias("event_id"), F.try_variant_get("_v", "$.ts", "string").alias("ts"))


SUPPLIER = "SELECT s_suppkey, {nation} AS s_nationkey, {balance} AS s_acctbal, {seen} AS seen FROM (SELECT s_suppkey, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier)"
PLAIN = {"nation": "s_nationkey", "balance": "s_acctbal", "seen": "NULL::BIGINT"}
for _name, _change, _sql in (
    ("collection_insert", lambda c: None, SUPPLIER.format(**PLAIN)),
    ("collection_update_many", lambda c: c.update_many({"s_nationkey": {"$gte": 10}}, {"$set": {"seen": 1, "s_nationkey": 99}}), SUPPLIER.format(**PLAIN | {"nation": "CASE WHEN s_nationkey >= 10 THEN 99 ELSE s_nationkey END", "seen": "CASE WHEN s_nationkey >= 10 THEN 1::BIGINT END"})),
    ("collection_update_one", lambda c: c.update({"s_suppkey": 7}, {"seen": 2}), SUPPLIER.format(**PLAIN | {"seen": "CASE WHEN s_suppkey = 7 THEN 2::BIGINT END"})),
    ("collection_delete_many", lambda c: c.delete_many({"s_nationkey": {"$gte": 10}}), SUPPLIER.format(**PLAIN) + " WHERE s_nationkey < 10"),
    ("collection_delete_one", lambda c: c.delete_one({"s_suppkey": {"$in": [3, 5000]}}), SUPPLIER.format(**PLAIN) + " WHERE s_suppkey <> 3"),
    ("collection_remove_all", lambda c: (c.remove({}), c.insert_one({"s_suppkey": 1, "s_nationkey": 2, "s_acctbal": 0.5})), "SELECT 1::BIGINT AS s_suppkey, 2::BIGINT AS s_nationkey, 0.5::DOUBLE AS s_acctbal, NULL::BIGINT AS seen"),
    ("collection_bypass_and_compact", lambda c: (c.insert_many([{"_id": "1", "s_suppkey": 1}], bypass_document_validation=True), c.compact()), SUPPLIER.format(**PLAIN) + " UNION ALL SELECT 1, NULL, NULL, NULL"),
):
    ALL[_name] = Query(_collection(_change), _sql)
ALL["collection_storage"] = Query(
    _times,
    "SELECT event_id, '{time}:' || strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts FROM events WHERE ts >= TIMESTAMP '2024-01-08 00:00:00' AND date_trunc('second', ts) < TIMESTAMP '2024-01-20 12:00:00'",
)
ALL["collection_drop"] = Query(_drop, "SELECT 21::BIGINT AS eids, '_default,a' AS names, 6::BIGINT AS n, true AS dropped, false AS again, 0::BIGINT AS n_after")
ALL["cursor"] = Query(
    _cursor,
    "SELECT count(*) AS n, min(o_orderkey) AS first, list_sort(list(o_orderkey))[2] AS second, list_sort(list(o_orderkey))[10] AS tenth, true AS more, max(o_orderkey) AS last FROM orders WHERE o_orderstatus = 'F'",
)
ALL["cursor_paginate"] = Query(
    lambda s, d: Table("orders", table(s, d, "orders"), "o_orderkey").find({"o_orderstatus": "F"}).paginate(13, 7).df.select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 7 OFFSET 13"
)
ALL["find_sorted_page"] = Query(
    lambda s, d: Table("orders", table(s, d, "orders"), "o_orderkey").find({}, sort=[("o_orderstatus", -1), ("o_orderpriority", 1), ("o_orderdate", -1)], skip=5, limit=30).df.select("o_orderkey"),
    "SELECT o_orderkey FROM orders ORDER BY o_orderstatus DESC, o_orderpriority, o_orderdate DESC, o_orderkey LIMIT 30 OFFSET 5",
)
ALL["find_sorted_documents"] = Query(
    lambda s, d: documents.find(mixed(s, d), {}, sort=[("x", 1)], skip=100, limit=700).select(F.col("_seq").alias("event_id")),
    f"SELECT event_id FROM ({ALL['sort_mixed'].sql}) WHERE pos > 100 AND pos <= 800",
)
NATION = "SELECT n_nationkey, n_name FROM nation"
ALL["json_lines"] = Query(_read_back("lines", lambda df, path: df.select("value").write.text(path), read_lines), NATION)
ALL["json_database"] = Query(_read_back("tables", _one_file, lambda s, path: read_tables(s, path).where("table = 'nation' AND eid >= 0")), NATION)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in ALL.items() if q.sql}
