"""Files of documents, and values that JSON has no type for."""

from __future__ import annotations

import datetime as dt
import re
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclith.errors import ConfigurationError, OperationFailure
from doclith.plans.filters import All, Leaf, Node, parse

DATE_FORMAT = "%Y-%m-%dT%H:%M:%S"
_JAVA = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "T": "'T'"}


class Codec(Protocol):
    """Values of a type as strings. ``sorts`` says whether the strings are in the values' order."""

    kind: type
    sorts: bool

    def encode(self, value: Any) -> str: ...

    def decode(self, text: str) -> Any: ...


class DateTimeCodec:
    """Times from the year 1000 on as strings of whole seconds without a zone, in Python and in columns."""

    kind = dt.datetime

    def __init__(self, dateformat: str = DATE_FORMAT) -> None:
        self.dateformat = dateformat

    @property
    def sorts(self) -> bool:
        """Year first, and every part with a fixed number of digits, down to some unit."""
        parts = re.findall("%.", self.dateformat)
        return parts == ["%Y", "%m", "%d", "%H", "%M", "%S"][: len(parts)]

    def encode(self, value: dt.datetime) -> str:
        return value.strftime(self.dateformat)

    def decode(self, text: str) -> dt.datetime:
        return dt.datetime.strptime(text, self.dateformat)

    @property
    def pattern(self) -> str:
        out = self.dateformat
        for python, java in _JAVA.items():
            out = out.replace(python, java)
        return out

    def encode_column(self, column: Column) -> Column:
        return F.date_format(column, self.pattern)

    def decode_column(self, column: Column) -> Column:
        return F.to_timestamp_ntz(column, F.lit(self.pattern))


class Codecs:
    """Codecs by tag. In JSON a value is the string ``{tag}:text``; plain strings that start like that are refused, so
    that what is read is what was written.

    Filters compare such values with each other only, and sorts place them among the strings, by their text. Where a
    codec's texts don't sort as its values do, comparisons fail.
    """

    def __init__(self, by_tag: dict[str, Codec] | None = None) -> None:
        self.by_tag = dict(by_tag or {})
        kinds = [c.kind for c in self.by_tag.values()]
        if any(not re.fullmatch(r"\w+", tag) for tag in self.by_tag):
            raise ConfigurationError("a codec's tag is made of letters, digits and underscores")
        if len(set(kinds)) < len(kinds):
            raise ConfigurationError("two codecs are for one type")

    def of(self, value: Any) -> tuple[str, Codec] | None:
        return next(((tag, c) for tag, c in self.by_tag.items() if isinstance(value, c.kind)), None)

    def _tagged(self, text: str) -> str | None:
        return next((tag for tag in self.by_tag if text.startswith(f"{{{tag}}}:")), None)

    def plain(self, value: Any) -> Any:
        """The value as JSON can hold it."""
        if not self.by_tag:
            return value
        if isinstance(value, str) and self._tagged(value):
            raise OperationFailure(f"a string starts with a codec's tag: {value[:40]!r}")
        if isinstance(value, dict):
            return {k: self.plain(v) for k, v in value.items()}
        if isinstance(value, (list, tuple)):
            return [self.plain(v) for v in value]
        found = self.of(value)
        return f"{{{found[0]}}}:{found[1].encode(value)}" if found else value

    def value(self, plain: Any) -> Any:
        """What :meth:`plain` was made of."""
        if not self.by_tag:
            return plain
        if isinstance(plain, dict):
            return {k: self.value(v) for k, v in plain.items()}
        if isinstance(plain, list):
            return [self.value(v) for v in plain]
        tag = self._tagged(plain) if isinstance(plain, str) else None
        return self.by_tag[tag].decode(plain[len(tag) + 3 :]) if tag else plain

    def tree(self, query: dict | Node | None) -> Node:
        """A filter's tree with plain values. Strings from ``{tag}:`` up to ``{tag};`` are those of a codec."""
        return self._tree(parse(query))

    def _tree(self, node: Node) -> Node:
        if not isinstance(node, Leaf):
            return type(node)(tuple(self._tree(x) for x in node.parts))
        same, found = Leaf(node.path, node.op, self.plain(node.value)), self.of(node.value)
        if not found or node.op not in ("gt", "gte", "lt", "lte"):
            return same
        tag, codec = found
        if not codec.sorts:
            raise OperationFailure(f"values of {tag} are kept as texts of another order and can't be compared")
        bound = Leaf(node.path, "lt", f"{{{tag}}};") if node.op in ("gt", "gte") else Leaf(node.path, "gte", f"{{{tag}}}:")
        return All((same, bound))

    def columns(self, df: DataFrame) -> DataFrame:
        """Time columns as documents hold times; times inside structs and arrays become JSON as Spark writes it."""
        tag, codec = next(((t, c) for t, c in self.by_tag.items() if isinstance(c, DateTimeCodec)), (None, None))
        times = [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))] if tag else []
        return df.withColumns({c: F.concat(F.lit(f"{{{tag}}}:"), codec.encode_column(F.col(f"`{c}`"))) for c in times}) if times else df


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """table, eid, _doc of one-file databases, each {table: {eid: document}}; a file is read as one value."""
    files = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    files.createOrReplaceTempView("_doclith_file")
    return spark.sql(
        "SELECT t.key AS table, CAST(d.key AS BIGINT) AS eid, to_json(d.value) AS _doc FROM _doclith_file, LATERAL variant_explode(v) AS t, LATERAL variant_explode(t.value) AS d"
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """_doc and _v of JSON lines, whatever types their fields have; lines that are no JSON have a null _v."""
    return spark.read.text(path).where("trim(value) != ''").select(F.col("value").alias("_doc"), F.try_parse_json("value").alias("_v"))
