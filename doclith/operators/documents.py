"""Queries and changes as transforms of DataFrames: a table with a schema, or documents as JSON text and variant."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclith.errors import OperationFailure
from doclith.functions.resolve import Typed, Variant
from doclith.operators import ordering
from doclith.plans.filters import EVERYTHING, parse

#: The columns of documents.
SEQUENCE, ID, TEXT, VALUE = "_seq", "_id", "_doc", "_v"


def is_documents(df: DataFrame) -> bool:
    return TEXT in df.columns and VALUE in df.columns


def condition(df: DataFrame, query: dict | None) -> Column:
    """A filter as a column of the DataFrame, batch or stream."""
    return (Variant(VALUE) if is_documents(df) else Typed(df.schema)).condition(parse(query))


def matching(df: DataFrame, query: dict | None) -> DataFrame:
    return df if parse(query) == EVERYTHING else df.where(condition(df, query))


def find(df: DataFrame, query: dict | None = None, sort=None, skip: int | None = None, limit: int | None = None, sequence: str | None = None, projection: list[str] | None = None) -> DataFrame:
    """Rows that match, sorted, from ``skip`` on, ``limit`` at most (0 or None: all)."""
    sequence = sequence or (SEQUENCE if SEQUENCE in df.columns else None)
    out = matching(df, query)
    if sort is not None:
        out = ordering.ordered(out, ordering.checked(sort), sequence, TEXT if is_documents(df) else None)
    elif (skip or limit) and sequence:
        out = out.orderBy(sequence)
    if skip:
        out = out.offset(skip)
    if limit:
        out = out.limit(limit)
    return out.select(*projection) if projection else out


def first(df: DataFrame, query: dict | None = None, sequence: str | None = None) -> DataFrame:
    """The first match in sequence order."""
    return find(df, query, limit=1, sequence=sequence)


def changes(update: dict) -> dict:
    """The fields that an update sets: those of ``$set``, or the update itself; dots don't part names here."""
    if not isinstance(update, dict) or not update:
        raise OperationFailure("an update is a dictionary of fields, or has $set")
    extra = [k for k in update if k.startswith("$") and k != "$set"]
    if extra:
        raise OperationFailure(f"unknown update operator {extra[0]}")
    return update.get("$set", update)


def first_only(df: DataFrame, match: Column, sequence: str) -> Column:
    """The match narrowed to the smallest sequence number; one aggregate with a row decides it."""
    least = df.where(match).agg(F.min(sequence)).first()[0]
    return match & (F.col(sequence) == F.lit(least)) if least is not None else F.lit(False)


def updated(df: DataFrame, query: dict | None, update: dict, sequence: str | None = None, once: bool = False) -> DataFrame:
    """The table after the update; with ``once`` only the first match changes."""
    fields, match = changes(update), F.coalesce(condition(df, query), F.lit(False))
    if once:
        match = first_only(df, match, sequence or SEQUENCE)
    if is_documents(df):
        import pandas as pd  # here: workers of other operators do without

        merge = F.pandas_udf(lambda texts: pd.Series([json.dumps(json.loads(x) | fields, allow_nan=False) for x in texts]), "string")
        # The function sees matches alone; the others keep their text and their value.
        changed = df.where(match).withColumn(TEXT, merge(F.col(TEXT))).withColumn(VALUE, F.parse_json(TEXT))
        return df.where(~match).unionByName(changed)
    missing = [k for k in fields if k not in df.columns]
    if missing:
        raise OperationFailure(f"the table has no column {missing[0]}")
    return df.withColumns({k: F.when(match, F.lit(v).cast(df.schema[k].dataType)).otherwise(F.col(f"`{k}`")) for k, v in fields.items()})


def remaining(df: DataFrame, query: dict | None, sequence: str | None = None, once: bool = False) -> DataFrame:
    """The table after the deletion; what the filter can't decide stays."""
    match = F.coalesce(condition(df, query), F.lit(False))
    return df.where(~(first_only(df, match, sequence or SEQUENCE) if once else match))


def duplicates(df: DataFrame, new: DataFrame, key: str = ID) -> DataFrame:
    """Keys of the new rows that the table has, or that the new rows have twice."""
    there = new.select(key).join(df.select(key), key, "left_semi")
    return there.union(new.groupBy(key).count().where("count > 1").select(key)).distinct()


def numbered(df: DataFrame, after: int, column: str = SEQUENCE) -> DataFrame:
    """Adds dense numbers from ``after`` + 1, in the rows' order: partitions are counted, then numbered side by side."""
    cut = df.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    sizes = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
    place = F.col("_at").bitwiseAND((1 << 33) - 1)
    return cut.join(sizes, "_part").withColumn(column, F.lit(after + 1) + F.col("_before") + place).drop("_part", "_at", "_n", "_before")
