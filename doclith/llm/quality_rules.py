"""Quality rules: a table of thresholds compiled into one projection.

Every measure is an integer, and every rule compares integers crosswise (``100 * part <= percent * whole``), so that
any engine reaches the same verdicts. The rule on stop words holds for documents whose ``lang`` is one of LANGUAGES, null
or no column; it says nothing about others. There is no user function, no shuffle and no state: a document is judged alone.

Defined cases: null and blank texts have no words and fail; null doc_ids pass through; repeated rows are judged
each; further columns of the input are kept by :func:`judge` unless they have the name of a measure, in which case
the measure replaces them; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclith.llm.text import n_matching, packed, whole, words

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = """
a an and are as at be by for from he in is it not of on or she that the this to was were which with you
als auf aus das dem den der des die ein eine für im in ist mit nicht sich und von zu
au avec ce dans de des du elle en est et il la le les pas par pour que qui se sur un une
al como con de del el en es la las lo los más no para por que se su un una y
""".split()

#: Those of the stop words.
LANGUAGES = ("en", "de", "fr", "es")
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``low <= 100 * part / whole <= high`` in percent; ``whole`` None compares ``part`` itself."""

    name: str
    part: str
    whole: str | None = None
    low: int | None = None
    high: int | None = None
    spoken: bool = False  # for documents in LANGUAGES only

    def sides(self) -> list[tuple[str, str, str]]:
        left = f"100 * {self.part}" if self.whole else self.part
        of = lambda bound: f"{bound} * {self.whole}" if self.whole else str(bound)
        return [(left, ">=", of(self.low))] * (self.low is not None) + [(left, "<=", of(self.high))] * (self.high is not None)

    def sql(self) -> str:
        return " AND ".join(f"{a} {op} {b}" for a, op, b in self.sides())


#: Those that the measures' contract fixes.
BASE = (Rule("length", "n_words", low=10), Rule("repeated windows", "n_repeat_words", "n_words", high=20))
#: The method's own.
RULES = (
    Rule("word length", "word_chars", "n_words", low=200, high=1000),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("exclamations", "n_exclaims", "n_words", high=50),
    Rule("stop words", "(n_stop_words + 1)", "n_words", low=5, spoken=True),
    Rule("repeated lines", "n_dup_lines", "n_lines", high=50),
)
STEPS = ("_q_words", "_q_lines", "_q_h", "_q_g", "_q_s", "_q_at")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims", "n_stop_words")


def passes(rules: tuple[Rule, ...], lang: Column | None = None) -> Column:
    """Whether all rules hold; ``lang`` such as ``de`` or ``de-AT``."""
    every = lambda spoken: F.expr(" AND ".join(f"({r.sql()})" for r in rules if r.spoken == spoken) or "true")
    known = F.lit(True) if lang is None else F.coalesce(F.regexp_extract(F.lower(lang.cast("string")), "^[a-z]*", 0).isin(*LANGUAGES, ""), F.lit(True))
    return every(False) & (every(True) | ~known)


def _fingerprints() -> Column:
    hashes = F.transform("_words", lambda w: F.xxhash64(w))
    return F.when(F.size("_words") >= WINDOW, hashes).otherwise(F.expr("CAST(array() AS ARRAY<BIGINT>)"))


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """The input's columns and MEASURES. A window's words are compared by a 64-bit hash of their 64-bit hashes."""
    df = df.drop(*(c for c in df.columns if c in (*MEASURES, "base_failed", "kept", *STEPS)))
    none = F.expr("CAST(array() AS ARRAY<BIGINT>)")
    lines = F.filter(F.split(whole(F.col(text)), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # Windows that occur once are the rule: the sort below is for texts in which a hash occurs twice.
    step = df.withColumns({"_q_words": words(F.col(text)), "_q_lines": lines})
    step = step.withColumns({"_q_h": F.when(F.size("_q_words") >= WINDOW, F.transform("_q_words", lambda w: F.xxhash64(w))).otherwise(none)})
    window = lambda i: F.xxhash64(*(F.get(F.col("_q_h"), i + F.lit(k)) for k in range(WINDOW)))
    step = step.withColumns({"_q_g": F.when(F.size("_q_h") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_q_h") - WINDOW), window)).otherwise(none)})
    ranked = F.sort_array(F.transform("_q_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    unique = F.size(F.array_distinct("_q_g")) == F.size("_q_g")
    step = step.withColumns({"_q_s": F.when(unique, F.expr("CAST(array() AS ARRAY<STRUCT<g: BIGINT, i: INT>>)")).otherwise(ranked)})
    near = lambda k: F.get(F.col("_q_s"), k)["g"]
    twice = F.transform("_q_s", lambda x, k: F.when((x["g"] == F.when(k > 0, near(k - 1))) | (x["g"] == near(k + 1)), x["i"]))
    step = step.withColumns({"_q_at": F.sort_array(F.filter(twice, lambda i: i.isNotNull()))})
    covers = F.transform("_q_at", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_q_at"), k + 1) - i, F.lit(WINDOW))))
    plain = F.split(F.lower(whole(F.col(text))), r"[^\p{L}]+")
    return step.withColumns(
        {
            "n_words": F.size("_q_words").cast("long"),
            "word_chars": F.length(F.array_join("_q_words", "")).cast("long"),
            "n_symbols": n_matching(whole(F.col(text)), SYMBOLS),
            "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
            "n_repeat_words": F.aggregate(covers, F.lit(0), lambda a, x: a + x).cast("long"),
            "n_lines": F.size("_q_lines").cast("long"),
            "n_exclaims": n_matching(whole(F.col(text)), "[!]"),
            "n_stop_words": F.size(F.filter(plain, lambda w: w.isin(*sorted(set(STOP_WORDS))))).cast("long"),
        }
    ).drop(*STEPS)


def judge(df: DataFrame, text: str = "text", base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """:func:`measured` and the verdicts: base_failed, kept."""
    lang = F.col("lang") if "lang" in df.columns else None
    return measured(df, text).withColumns({"base_failed": ~passes(base, lang), "kept": passes((*base, *rules), lang)})


def passing(df: DataFrame, text: str = "text", base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that :func:`judge` keeps, with the input's columns.

    A filter on computed columns would be moved below their computation, with each name replaced by its expression, and
    arrays would be built again for each of their elements. The row number, which the filter names, holds it back.
    """
    judged = measured(df.select(packed(df), F.col(text).alias("text")))
    numbered = judged.withColumn("at", F.monotonically_increasing_id())
    lang = F.col("own")["lang"] if "lang" in df.columns else None
    return numbered.where(passes((*base, *rules), lang) & (F.col("at") >= 0)).select("own.*")


def oracle_sql(table: str = "documents") -> str:
    """The same in DuckDB's SQL."""
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    every = lambda rules: " AND ".join(f"({r.sql()})" for r in rules)
    count = lambda chars: f"length(t) - length(regexp_replace(t, '{chars}+', '', 'g'))"
    return rf"""
WITH d AS (
    SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
    FROM (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t FROM {table})),
g AS (SELECT rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT rid, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM d)),
h AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS j FROM (SELECT *, count(*) OVER (PARTITION BY rid, s) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, sum(least({WINDOW}, coalesce(j - i, {WINDOW})))::BIGINT AS n FROM h GROUP BY rid),
m AS (
    SELECT d.*, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, ({count(SYMBOLS)})::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
        ({count("[!]")})::BIGINT AS n_exclaims, len(list_filter(string_split_regex(lower(t), '[^\p{{L}}]+'), lambda x: x IN ({stops})))::BIGINT AS n_stop_words
    FROM d LEFT JOIN r USING (rid))
SELECT * EXCLUDE (rid, t, w, l), NOT ({every(BASE)}) AS base_failed, {every((*BASE, *RULES))} AS kept FROM m"""
