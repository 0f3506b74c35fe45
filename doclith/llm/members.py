"""Approximate sets of 64-bit numbers in a fixed number of bits, to skip work before an exact join decides.

A set is built by Spark as bits grouped into 64-bit words, so that what reaches the driver and the executors has a
fixed size. A full set lets everything pass: then the join alone does the work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 22  # 4 M bits, 512 KB


def collect(numbers: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """The set of a long column's values: 2**bits bits as 64-bit words."""
    low = F.col(column).bitwiseAND((1 << bits) - 1)
    rows = numbers.where(F.col(column).isNotNull()).groupBy(F.shiftright(low, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST({column} & 63 AS INT))")).alias("b"))
    out = np.zeros(1 << (bits - 6), np.int64)
    found = rows.toArrow()
    out[found["w"].to_numpy()] = found["b"].to_numpy()
    return out.view(np.uint64)


def may_hold(words: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """For each number whether it can be in the set. The values' low bits must be random: hashes."""
    numbers = numbers.view(np.uint64)
    low = numbers & np.uint64(len(words) * 64 - 1)
    return (words[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) == 1


def column(name: str, words: np.ndarray) -> Column:
    """Whether the column's number can be in the set. Only that column goes through Python."""
    return F.arrow_udf(lambda x: pa.array(may_hold(words, x.to_numpy())), "boolean")(F.col(name))


def filtered(df: DataFrame, name: str, words: np.ndarray) -> DataFrame:
    """The rows whose number can be in the set."""
    return df.where(column(name, words))


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose numbers a and b (hashes) are not in ``gone``; only rows that may be there are moved."""
    maybe = column("a", collect(gone, "a"))
    gone = gone.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    left = rows.where(maybe).join(gone, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti")
    return rows.where(~maybe).unionByName(left)
