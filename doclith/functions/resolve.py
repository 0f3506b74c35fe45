"""Filter trees as columns, over a schema or over a variant.

A comparison holds only for values of the literal's class: numbers, strings, booleans, times, arrays, objects, null. Over
a schema the class is decided here, so that Spark never casts a value to compare it, and plain conditions reach the
scan. Over a variant the class is a condition of its own.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclith.errors import OperationFailure
from doclith.plans.filters import All, Leaf, Node, Some, literal_prefix

NOTHING = "nothing"
COMPARE = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


def class_of(value: Any) -> str:
    """Of a literal."""
    if value is None:
        return "null"
    for kinds, name in ((bool, "bool"), ((int, float, decimal.Decimal), "number"), (str, "string"), (dt.datetime, "time"), (dt.date, "date"), ((bytes, bytearray), "binary"), ((list, tuple), "array"), (dict, "object")):
        if isinstance(value, kinds):
            return name
    raise OperationFailure(f"a filter can't hold {type(value).__name__}")


def class_of_type(kind: T.DataType) -> str:
    for types, name in ((T.BooleanType, "bool"), (T.NumericType, "number"), ((T.StringType, T.CharType, T.VarcharType), "string"), ((T.TimestampType, T.TimestampNTZType), "time"), (T.DateType, "date"), (T.BinaryType, "binary"), (T.ArrayType, "array"), ((T.StructType, T.MapType), "object")):
        if isinstance(kind, types):
            return name
    return NOTHING


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def _every(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


class Resolver:
    """What both kinds share: the tree, and leaves that are made of others."""

    def condition(self, node: Node) -> Column:
        if isinstance(node, All):
            return _every([self.condition(x) for x in node.parts])
        if isinstance(node, Some):
            return _any([self.condition(x) for x in node.parts])
        return self.leaf(node)

    def leaf(self, leaf: Leaf) -> Column:
        raise NotImplementedError


class Typed(Resolver):
    """Over columns. NULL is a missing field as well as null."""

    def __init__(self, schema: T.StructType) -> None:
        self.schema = schema

    def locate(self, path: tuple[str, ...]) -> tuple[Column, T.DataType] | None:
        """The column of a path through structs and maps, and its type; None if there is no such path."""
        names = {f.name: f.dataType for f in self.schema}
        whole = ".".join(path)
        start = 1 if path[0] in names else len(path) if whole in names else 0
        if not start:
            return None
        name = path[0] if start == 1 else whole
        column, kind = F.col(f"`{name.replace('`', '``')}`"), names[name]
        for step in path[start:]:
            if isinstance(kind, T.StructType) and step in kind.names:
                column, kind = column.getField(step), kind[step].dataType
            elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
                column, kind = column.getItem(step), kind.valueType
            else:
                return None
        return column, kind

    def leaf(self, leaf: Leaf) -> Column:
        found = self.locate(leaf.path)
        if not found:
            return F.lit(False)
        column, kind = found
        if leaf.op in ("nin", "nall", "nregex"):
            return column.isNotNull() & ~F.coalesce(self.holds(column, kind, leaf.op[1:], leaf.value), F.lit(False))
        return self.holds(column, kind, leaf.op, leaf.value)

    def holds(self, c: Column, kind: T.DataType, op: str, value: Any) -> Column:
        own = class_of_type(kind)
        if op == "eq":
            return self.equal_or_element(c, kind, value)
        if op == "ne":
            if value is None or own != class_of(value):
                return c.isNotNull()
            return c != F.lit(value) if own not in ("array", "object") else c.isNotNull() & ~F.coalesce(self.equal(c, kind, value), F.lit(False))
        if op in COMPARE:
            if own != class_of(value) or own == "object":
                return F.lit(False)
            if own == "array":
                other = self.array(kind, value)
                return F.lit(False) if other is None else getattr(c, COMPARE[op])(other)
            return getattr(c, COMPARE[op])(F.lit(value))
        if op == "in":
            return self.member(c, kind, value)
        if op == "all":
            return c.isNotNull() & _every([self.element(c, kind, x) for x in value]) if own == "array" else F.lit(False)
        if own == "array" and class_of_type(kind.elementType) == "string":
            return F.exists(c, lambda x: x.rlike(f"^(?:{value})"))
        if own != "string":
            return F.lit(False)
        prefix = literal_prefix(value)
        return c.startswith(prefix) if prefix else c.rlike(f"^(?:{value})")

    def array(self, kind: T.ArrayType, values: list) -> Column | None:
        """The literal with the column's type; None if an element has another class."""
        inner = class_of_type(kind.elementType)
        if any(x is not None and class_of(x) != inner for x in values) or inner == "object":
            return None
        parts = [self.array(kind.elementType, x) if isinstance(x, (list, tuple)) else F.lit(x) for x in values]
        return None if any(p is None for p in parts) else F.array(*parts).cast(kind)

    def equal(self, c: Column, kind: T.DataType, value: Any) -> Column:
        """The whole value is the literal."""
        if value is None:
            return c.isNull()
        own = class_of_type(kind)
        if own != class_of(value):
            return F.lit(False)
        if own == "array":
            if class_of_type(kind.elementType) == "object":
                return (F.size(c) == len(value)) & _every([self.equal(F.get(c, F.lit(i)), kind.elementType, x) for i, x in enumerate(value)])
            other = self.array(kind, value)
            return F.lit(False) if other is None else c == other
        if isinstance(kind, T.StructType):
            if any(k not in kind.names for k in value):
                return F.lit(False)
            return c.isNotNull() & _every([self.equal(c.getField(f.name), f.dataType, value.get(f.name)) for f in kind])
        if isinstance(kind, T.MapType):
            return (F.size(c) == len(value)) & _every([self.equal(c.getItem(k), kind.valueType, x) for k, x in value.items()])
        return c == F.lit(value)

    def element(self, c: Column, kind: T.ArrayType, value: Any) -> Column:
        """The array has the literal as an element."""
        inner = kind.elementType
        if value is None:
            return F.exists(c, lambda x: x.isNull())
        if class_of_type(inner) != class_of(value):
            return F.lit(False)
        if class_of_type(inner) in ("object", "array"):
            return F.exists(c, lambda x: F.coalesce(self.equal(x, inner, value), F.lit(False)))
        return F.array_contains(c, F.lit(value).cast(inner)) if not isinstance(value, float) else F.exists(c, lambda x: x == F.lit(value))

    def equal_or_element(self, c: Column, kind: T.DataType, value: Any) -> Column:
        same = self.equal(c, kind, value)
        return same | self.element(c, kind, value) if class_of_type(kind) == "array" else same

    def member(self, c: Column, kind: T.DataType, values: list) -> Column:
        own = class_of_type(kind)
        inner = class_of_type(kind.elementType) if own == "array" else own
        plain = [x for x in values if x is not None and not isinstance(x, (list, tuple, dict)) and class_of(x) == inner]
        rest = [x for x in values if x is None or isinstance(x, (list, tuple, dict))]
        parts = [self.equal_or_element(c, kind, x) for x in rest]
        if plain:
            floats = inner == "number" and any(isinstance(x, float) for x in plain)
            parts.insert(0, c.isin(*plain) if own != "array" else F.exists(c, lambda x: x.isin(*plain)) if floats else F.arrays_overlap(c, F.array(*map(F.lit, plain)).cast(kind)))
        return _any(parts)


#: The names that Spark gives a variant's values, as patterns.
VARIANT_CLASS = {
    "number": "^(?:BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)", "string": "^STRING", "bool": "^BOOLEAN", "null": "^VOID", "array": "^ARRAY", "object": "^OBJECT",
    "time": "^TIMESTAMP", "date": "^DATE", "binary": "^BINARY",
}
VARIANT_TYPE = {"string": "string", "bool": "boolean", "time": "timestamp_ntz", "date": "date", "binary": "binary"}


def variant_path(path: tuple[str, ...]) -> str:
    return "$" + "".join('["' + step.replace("\\", "\\\\").replace('"', '\\"') + '"]' for step in path)


def canonical(value: Any) -> str:
    """JSON text of a literal."""
    try:
        return json.dumps(value, allow_nan=False)
    except (TypeError, ValueError) as e:
        raise OperationFailure(f"not JSON: {e}") from e


class Variant(Resolver):
    """Over a variant column, in which a missing field and null differ."""

    def __init__(self, column: str = "_v") -> None:
        self.column = column

    def leaf(self, leaf: Leaf) -> Column:
        at = lambda kind: F.try_variant_get(F.col(self.column), variant_path(leaf.path), kind)
        if leaf.op in ("ne", "nin", "nall", "nregex"):
            holds = self.same(at, leaf.value) if leaf.op == "ne" else self.holds(at, leaf.op[1:], leaf.value)
            return at("variant").isNotNull() & ~F.coalesce(holds, F.lit(False))
        return self.holds(at, leaf.op, leaf.value)

    def guard(self, at, name: str) -> Column:
        return F.schema_of_variant(at("variant")).rlike(VARIANT_CLASS[name])

    def typed(self, at, value: Any) -> tuple[Column, Column]:
        """The class's condition, and the value as the literal's type."""
        name = class_of(value)
        kind = VARIANT_TYPE.get(name) or ("decimal(38,0)" if isinstance(value, int) and abs(value) >= 1 << 53 else "double")
        return self.guard(at, name), at(kind)

    def same(self, at, value: Any) -> Column:
        """The whole value is the literal."""
        name = class_of(value)
        if name == "null":
            return F.is_variant_null(at("variant"))
        if name in ("array", "object"):
            return self.guard(at, name) & (F.to_json(at("variant")) == F.to_json(F.parse_json(F.lit(canonical(value)))))
        guard, own = self.typed(at, value)
        return guard & (own == F.lit(value))

    def elements(self, at, condition) -> Column:
        inside = lambda x: condition(lambda kind: x if kind == "variant" else F.try_variant_get(x, "$", kind))
        return self.guard(at, "array") & F.exists(at("array<variant>"), lambda x: F.coalesce(inside(x), F.lit(False)))

    def holds(self, at, op: str, value: Any) -> Column:
        if op == "eq":
            return self.same(at, value) | self.elements(at, lambda x: self.same(x, value))
        if op in COMPARE:
            if class_of(value) in ("null", "array", "object"):
                return F.lit(False)
            guard, own = self.typed(at, value)
            return guard & getattr(own, COMPARE[op])(F.lit(value))
        if op == "in":
            return _any([self.holds(at, "eq", x) for x in value])
        if op == "all":
            return self.guard(at, "array") & _every([self.elements(at, lambda x, v=v: self.same(x, v)) for v in value])
        match = lambda x: self.guard(x, "string") & x("string").rlike(f"^(?:{value})")
        return match(at) | self.elements(at, match)
