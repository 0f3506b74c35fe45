"""Filter dictionaries as trees: no Spark here, and every malformed filter fails here.

A filter is ANDed over its keys. ``$and`` and ``$or`` hold lists of filters; any other key is a path with dots, its value
a literal or a dictionary of operators. Negation exists at leaves only, so that rows without the field match no leaf
but an explicit one for null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from doclith.errors import OperationFailure

#: Each leaf operator and its opposite.
OPPOSITE = {"eq": "ne", "ne": "eq", "gt": "lte", "lte": "gt", "gte": "lt", "lt": "gte", "in": "nin", "nin": "in", "all": "nall", "nall": "all", "regex": "nregex", "nregex": "regex"}
OPERATORS = {"$gte": "gte", "$gt": "gt", "$lte": "lte", "$lt": "lt", "$ne": "ne", "$regex": "regex", "$in": "in", "$all": "all"}


@dataclass(frozen=True)
class Leaf:
    path: tuple[str, ...]
    op: str
    value: Any


@dataclass(frozen=True)
class All:
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Some:
    parts: tuple[Node, ...]


Node = Leaf | All | Some
EVERYTHING = All(())


def parse(query: dict | Node | None) -> Node:
    """The tree of a filter; None and {} match everything. A tree stays as it is."""
    if query is None:
        return EVERYTHING
    if isinstance(query, Node):
        return query
    if not isinstance(query, dict):
        raise OperationFailure(f"a filter is a dictionary, not {type(query).__name__}")
    parts = tuple(_entry(key, value) for key, value in query.items())
    return parts[0] if len(parts) == 1 else All(parts)


def _entry(key: str, value: Any) -> Node:
    if not isinstance(key, str) or not key:
        raise OperationFailure(f"a filter's keys are names, not {key!r}")
    if key in ("$and", "$or"):
        if not isinstance(value, list) or not value:
            raise OperationFailure(f"{key} needs a list of filters")
        return (All if key == "$and" else Some)(tuple(parse(x) for x in value))
    if key.startswith("$"):
        raise OperationFailure(f"unknown operator {key} at the top of a filter")
    path = tuple(key.split("."))
    if isinstance(value, dict) and (not value or any(str(k).startswith("$") for k in value)):
        return _operators(path, value)
    return Leaf(path, "eq", value)


def _operators(path: tuple[str, ...], ops: dict, negated: bool = False) -> Node:
    if not ops:
        raise OperationFailure(f"no condition on {'.'.join(path)}")
    parts: list[Node] = []
    for name, value in ops.items():
        if name == "$not":
            if isinstance(value, list):
                raise OperationFailure("$not takes a value or operators, not a list")
            if isinstance(value, dict) and any(str(k).startswith("$") for k in value):
                parts.append(_operators(path, value, not negated))
            else:
                parts.append(Leaf(path, "eq" if negated else "ne", value))
            continue
        if name not in OPERATORS:
            raise OperationFailure(f"unknown operator {name}")
        op = OPERATORS[name]
        if op in ("in", "all") and not isinstance(value, list):
            raise OperationFailure(f"{name} needs a list")
        parts.append(Leaf(path, OPPOSITE[op] if negated else op, java_pattern(value) if op == "regex" else value))
    return parts[0] if len(parts) == 1 else All(tuple(parts))


def java_pattern(pattern: Any) -> str:
    """The pattern as Java reads it; what Python can't compile, or Java can't read, fails."""
    if not isinstance(pattern, str):
        raise OperationFailure("$regex needs a string")
    try:
        re.compile(pattern)
    except re.error as e:
        raise OperationFailure(f"$regex: {e}") from e
    if re.search(r"\(\?P=|\(\?\(", pattern):
        raise OperationFailure("$regex: named back references and conditionals are not supported")
    pattern = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)
    return re.sub(r"(\\\\)|\\Z", lambda m: m[1] or r"\z", pattern)


def literal_prefix(pattern: str) -> str | None:
    """The pattern itself if it has no special character: then a prefix test, which a scan can use, does."""
    return pattern if pattern and not re.search(r"[\\^$.|?*+()\[\]{}]", pattern) else None


def paths(node: Node) -> set[tuple[str, ...]]:
    if isinstance(node, Leaf):
        return {node.path}
    return set().union(*(paths(x) for x in node.parts)) if node.parts else set()
