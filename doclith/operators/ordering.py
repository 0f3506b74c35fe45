"""One order over values of all types.

Ascending: an empty array, null or a missing field, numbers, strings, objects, arrays inside arrays, booleans. An array
stands for its least member when ascending and its greatest when descending. Objects compare entry by entry in their own
key order, nested arrays element by element, a prefix first.

Columns with a type sort as they are. Documents sort by a binary key whose bytes are in that order, so that one range
partitioned sort serves any number of keys.
"""

from __future__ import annotations

import json
import struct
from itertools import accumulate
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclith.functions.resolve import Typed
from doclith.sources.store import Files

EMPTY, NULL, NUMBER, STRING, OBJECT, ARRAY, BOOL = (bytes([n]) for n in range(1, 8))
MORE, STOP = b"\x01", b"\x00"


def checked(key: Any, direction: Any = None) -> list[tuple[str, int]]:
    """The sort keys of ``sort(key, direction)``: a name, or a list of (name, 1 or -1)."""
    if isinstance(key, str):
        pairs: list = [(key, 1 if direction is None else direction)]
    elif not isinstance(key, list):
        raise ValueError("sort by a name or by a list of (name, direction)")
    elif direction is not None:
        raise ValueError("a list of sort keys has its own directions")
    else:
        pairs = key
    for pair in pairs:
        if not isinstance(pair, (list, tuple)):
            raise TypeError("a sort key is a pair of name and direction")
        if len(pair) != 2:
            raise ValueError("a sort key is a pair of name and direction")
        if not isinstance(pair[0], str) or isinstance(pair[1], bool) or pair[1] not in (1, -1):
            raise TypeError("a sort key is a name and 1 or -1")
    return [(name, way) for name, way in pairs]


def _text(value: str) -> bytes:
    return value.encode("utf-8", "surrogatepass").replace(b"\x00", b"\x00\xff") + b"\x00\x00"


def _number(value: float) -> bytes:
    """The double in an order of bytes, then how far an integer is from it."""
    try:
        double = float(value)
    except OverflowError:
        double = float("inf") if value > 0 else float("-inf")
    bits = struct.unpack(">Q", struct.pack(">d", double + 0.0))[0]
    bits = bits ^ ((1 << 64) - 1) if bits >> 63 else bits | 1 << 63
    rest = int(value) - int(double) if isinstance(value, int) and abs(double) < float("inf") else 0
    return struct.pack(">QQ", bits, min(max(rest + (1 << 63), 0), (1 << 64) - 1))


def nested_key(value: Any) -> bytes:
    """Of a member of an array or object."""
    if isinstance(value, bool):
        return BOOL + bytes([value])
    if isinstance(value, (int, float)):
        return NUMBER + _number(value)
    if isinstance(value, str):
        return STRING + _text(value)
    if isinstance(value, dict):
        parts = [(nested_key(v), k) for k, v in value.items()]
        return OBJECT + b"".join(MORE + v[:1] + _text(k) + v[1:] for v, k in parts) + STOP
    if isinstance(value, list):
        return ARRAY + b"".join(MORE + x for x in ([nested_key(x) for x in value] or [EMPTY])) + STOP
    return NULL


def sort_key(value: Any, way: int) -> bytes:
    """Of a document's value; ``way`` chooses an array's least or greatest member."""
    if isinstance(value, list):
        members = [nested_key(x) for x in value]
        return (min if way == 1 else max)(members) if members else EMPTY
    return nested_key(value)


def lookup(document: Any, path: tuple[str, ...], way: int) -> Any:
    """The value at a path, null if it isn't there. An array on the way counts ascending only if it holds one object with
    the name, descending by its first object with it."""
    for step in path:
        if isinstance(document, list):
            having = [x for x in document if isinstance(x, dict) and step in x]
            if not having or (way == 1 and len(document) != 1):
                return None
            document = having[0]
        if not isinstance(document, dict) or step not in document:
            return None
        document = document[step]
    return document


def document_key(text: Column, path: tuple[str, ...], way: int) -> Column:
    """The binary sort key of a JSON text's value at the path."""
    import pandas as pd  # here: workers of other operators do without

    make = F.pandas_udf(lambda texts: pd.Series([sort_key(lookup(json.loads(x), path, way), way) for x in texts]), T.BinaryType())
    return make(text)


def typed_keys(schema: T.StructType, keys: list[tuple[str, int]]) -> list[tuple[Column, int]]:
    """Columns over a schema, to sort by, and their ways; two for an array, none for a path that isn't there."""
    out = []
    for name, way in keys:
        found = Typed(schema).locate(tuple(name.split(".")))
        if not found:
            continue
        column, kind = found
        if not isinstance(kind, T.ArrayType):
            out.append((column, way))
            continue
        none = column.isNull() | F.exists(column, lambda x: x.isNull())
        rank = F.when(F.size(column) == 0, -1).when(none if way == 1 else column.isNull() | F.forall(column, lambda x: x.isNull()), 0).otherwise(1)
        value = F.when(rank == 1, F.array_min(column) if way == 1 else F.array_max(column))
        out += [(rank, way), (value, way)]
    return out


def _directed(column: Column, way: int) -> Column:
    return column.asc_nulls_first() if way == 1 else column.desc_nulls_last()


def typed_order(schema: T.StructType, keys: list[tuple[str, int]]) -> list[Column]:
    """Sort columns over a schema; a path that isn't there orders nothing."""
    return [_directed(column, way) for column, way in typed_keys(schema, keys)]


def document_order(keys: list[tuple[str, int]], text: str = "_doc") -> list[Column]:
    return [k.asc() if way == 1 else k.desc() for k, way in ((document_key(F.col(text), tuple(name.split(".")), way), way) for name, way in keys)]


def ordered(df: DataFrame, keys: list[tuple[str, int]], sequence: str | None = None, text: str | None = None) -> DataFrame:
    """Sorted by keys and then the sequence column, both ways ascending: ties keep their order."""
    columns = document_order(keys, text) if text else typed_order(df.schema, keys)
    return df.orderBy(*columns, *([F.col(sequence)] if sequence else [])) if columns or sequence else df


def _until_exit(spark: SparkSession, path: str) -> Files:
    """Makes a folder that is removed when the application ends."""
    files = Files(spark, path)
    files.make(path)
    files.fs.deleteOnExit(files.path(path))  # it forgets paths that aren't there yet
    return files


def placed(df: DataFrame, order: list[Column], columns: list[str], path: str) -> DataFrame:
    """The columns of all rows, and each row's place in the order (pos, from 1); the order should tell all rows apart.

    A window over the whole table would sort it in one task. Instead ranges are sorted side by side and written to ``path``,
    once, so that all that is read later is of the same ranges; the driver sees only how many rows each has. The table is
    removed when the application ends.
    """
    spark, rows = df.sparkSession, f"{path}/rows"
    _until_exit(spark, path)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    df.orderBy(*order).select(*columns, F.spark_partition_id().alias("_part"), place.alias("_place")).write.parquet(rows)
    kept = spark.read.schema(df.select(*columns, F.lit(0).alias("_part"), F.lit(0).cast("long").alias("_place")).schema).parquet(rows)
    sizes = dict(kept.groupBy("_part").count().collect())
    before = list(accumulate((sizes.get(part, 0) for part in range(max(sizes, default=0))), initial=0))
    return kept.select(*columns, (F.get(F.lit(before), F.col("_part")) + F.col("_place") + 1).cast("int").alias("pos"))


def placed_rows(df: DataFrame, keys: list[tuple[str, int]], columns: list[str], path: str) -> DataFrame:
    """Places by keys over a schema. What an array stands for is worked out first, so that no array is moved."""
    made, order = {}, []
    for key in keys:
        found = typed_keys(df.schema, [key])
        for column, way in found:
            if len(found) > 1:
                name = f"_key{len(made)}"
                made[name], column = column, F.col(name)
            order.append(_directed(column, way))
    return placed(df.withColumns(made) if made else df, order, columns, path)


def placed_documents(df: DataFrame, keys: list[tuple[str, int]], path: str, sequence: str = "_seq", text: str = "_doc") -> DataFrame:
    """The sequence numbers of all documents, and their places. Keys are made in Python, and ranges are found by a pass of
    its own: they are written first, so that each is made once, and removed when the places are there."""
    spark, files, at = df.sparkSession, _until_exit(df.sparkSession, path), f"{path}/keys"
    made = df.select(sequence, *(document_key(F.col(text), tuple(name.split(".")), way).alias(f"_key{i}") for i, (name, way) in enumerate(keys)))
    made.write.parquet(at)
    order = [F.col(f"_key{i}").asc() if way == 1 else F.col(f"_key{i}").desc() for i, (_, way) in enumerate(keys)]
    out = placed(spark.read.schema(made.schema).parquet(at), [*order, F.col(sequence).asc()], [sequence], path)
    files.remove(at)
    return out
