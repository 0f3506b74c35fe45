"""Filters on streams: the same conditions on unbounded tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from doclith.operators.documents import matching


def find_stream(df: DataFrame, query: dict | None = None, projection: list[str] | None = None) -> DataFrame:
    """The stream's matching rows; order, skip and limit need a bounded table and are not offered here."""
    out = matching(df, query)
    return out.select(*projection) if projection else out
