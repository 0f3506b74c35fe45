"""Text columns built from Spark's own functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
NO_WORDS = "CAST(array() AS ARRAY<STRING>)"


def whole(text: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Runs of characters that are no blanks; an array, empty for null and blank texts."""
    core = F.btrim(whole(text), F.lit(BLANKS))
    return F.when(core == "", F.expr(NO_WORDS)).otherwise(F.split(core, BLANK_RUN))


def n_words(text: Column) -> Column:
    core = F.btrim(whole(text), F.lit(BLANKS))
    return F.when(core == "", F.lit(0)).otherwise(F.size(F.split(core, BLANK_RUN))).cast("long")


def n_matching(text: Column, char_class: str) -> Column:
    """How many characters of the text belong to the class, such as ``[#*]``."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"{char_class}+", ""))).cast("long")


def packed(df: DataFrame) -> Column:
    """All columns as one, ``own``: what an operator computes beside it can have any names; ``own.*`` gives them back."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("own")
