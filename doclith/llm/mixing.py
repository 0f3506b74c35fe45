"""Mixing sources to target weights by hash thresholds.

Each row gets a 60-bit hash. A histogram of words by source and the hash's leading bits shows in which bucket a
source's budget runs out; only that bucket is split by the next bits, until the hash itself is reached. The result is
one threshold a source: rows below it are taken once more than rows above it. Nothing is sorted, larger budgets take
supersets of smaller ones, and equal input gives an equal mix on any number of machines.

Defined cases: null and blank texts have size 0; a very long text is a row like others; a null source is a source, the
last; a source at its stop takes each row ``most`` times and none once more; rows equal in id and text share a hash and
are taken alike; sources that stop at one level are in order of their names; an empty table gives an empty table; columns of the input that have the name of a result
are replaced by it. A source misses its target by at most half of the words that share the boundary's hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclith.llm.shared import cut, keep
from doclith.llm.text import n_words, packed, whole

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
HASH_BITS = 60
#: Leading bits at each level: of 10**10 rows a source, the second level splits 10**7, the third 2,500.
LEVELS = (10, 22, 34, 60)


def row_hash(key: str = "doc_id", text: str = "text") -> Column:
    """The first 60 bits of an MD5 over id and text."""
    named = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), whole(F.col(text)))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The columns key, source, size in words and _h of each row."""
    return df.select(F.col(key), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), row_hash(key, text).alias("_h"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, target: all words are shared by weight; a source stops at ``most`` times its size, and what
    it can't take is shared again among the others.

    In order of most * size / weight the sources that stop come first. The level, words for a weight of 1, is what
    they leave, at the first source whose share stays below its stop. The windows run over one row a source.
    """
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = by_source.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("_stop", most * F.col("source_size").cast("double"))
    every = Window.partitionBy()
    after = Window.orderBy(F.col("_stop") / F.col("_w"), F.col("source").asc_nulls_last())
    before = after.rowsBetween(Window.unboundedPreceding, -1)
    less = lambda c: F.sum(c).over(every).cast("double") - F.coalesce(F.sum(c).over(before).cast("double"), F.lit(0.0))
    left = ranked.withColumn("_left", F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("_stop").over(before), F.lit(0.0)))
    left = left.withColumn("_level", F.col("_left") / less("_w")).withColumn("_at", F.row_number().over(after))
    free = F.col("_w") * F.col("_level") < F.col("_stop")
    level = left.withColumn("_level", F.min(F.when(free, F.struct("_at", "_level"))).over(every)["_level"])
    return level.select("source", "source_size", F.least("_stop", F.coalesce(F.col("_w") * F.col("_level"), "_stop")).alias("target"))


def _prefix(bits: int) -> Column:
    return F.shiftright("_h", HASH_BITS - bits)


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """source, source_size, target, _full, _below: each row is taken _full times, and once more if its hash is below.

    A level reads, by a join on source and bucket, only the rows of the buckets in which budgets run out. The tables
    joined have a row a source and a row a source and bucket; Spark broadcasts them if they are small and else sorts.
    """
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    wanted = cut(wanted.withColumn("_full", full).withColumn("_rest", F.col("target") - F.col("_full") * F.col("source_size")))
    state, used = wanted.select(F.col("source").alias("_s"), "_rest", F.lit(0).cast("long").alias("_bucket"), F.lit(0).cast("long").alias("_n")), 0
    for bits in LEVELS:
        at = F.col("source").eqNullSafe(F.col("_s"))
        inside = rows.join(state.select("_s", "_bucket"), at & (_prefix(used) == F.col("_bucket"))) if used else rows
        sums = inside.groupBy("source", _prefix(bits).alias("_next")).agg(F.sum("size").alias("_m"))
        run = sums.withColumn("_upto", F.sum("_m").over(Window.partitionBy("source").orderBy("_next")))
        here = run.join(state, at).where(F.col("_upto") > F.col("_rest"))
        first = here.groupBy("source").agg(F.min(F.struct("_next", "_m", (F.col("_rest") - (F.col("_upto") - F.col("_m"))).alias("_rest"))).alias("_b"))
        state, used = cut(first.select(F.col("source").alias("_s"), "_b._rest", F.col("_b._next").alias("_bucket"), F.col("_b._m").alias("_n"))), bits
    edge = F.when(2 * F.col("_rest") >= F.col("_n"), F.col("_bucket") + 1).otherwise(F.col("_bucket"))
    found = wanted.withColumnRenamed("_rest", "_more").join(state, F.col("source").eqNullSafe(F.col("_s")), "left")
    # A source that gets whole copies only takes no row once more, not even rows without words.
    return found.select("source", "source_size", "target", "_full", F.when(F.col("_more") > 0, F.coalesce(edge, F.lit(0))).otherwise(0).alias("_below"))


def times_taken() -> Column:
    return F.col("_full") + F.when(F.col("_h") < F.col("_below"), 1).otherwise(0)


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """key, size, source_size, target, taken of each row, and copies: how often the mix takes it, 0 to ``most``."""
    rows = cut(sized(df, key, source, text))
    plan = keep(thresholds(rows, targets(rows, weights, most)), "mixing-plan")
    joined = rows.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    return joined.select(F.col(key), "size", "source_size", "target", (F.col("size") * times_taken()).alias("taken"), times_taken().cast("int").alias("copies"))


def mixed_rows(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The rows that the mix takes, all columns of the input, and copies; a row is there once, not ``copies`` times."""
    df = df.drop("copies")
    rows = cut(sized(df, key, source, text))
    # A written table has a known size: if it is small, Spark broadcasts it and no text is moved.
    plan = keep(thresholds(rows, targets(rows, weights, most)).select(F.col("source").alias("_s"), "_full", "_below"), "mixing-plan")
    joined = df.select(packed(df), row_hash(key, text).alias("_h"), F.col(source).cast("string").alias("_of")).join(plan, F.col("_of").eqNullSafe(F.col("_s")))
    return joined.withColumn("_copies", times_taken().cast("int")).where("_copies > 0").select("own.*", F.col("_copies").alias("copies"))


def oracle_sql(table: str = "documents", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> str:
    """The same in DuckDB's SQL, by sorting."""
    return rf"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, {HASH_BITS // 4}))::BIGINT AS h
    FROM {table}),
s AS (
    SELECT *, {most} * source_size::DOUBLE AS stop, list_extract({list(weights)}, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1)::INT % {len(weights)})::DOUBLE AS w
    FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
l AS (
    SELECT *, row_number() OVER o AS pos,
        (sum(source_size::DOUBLE) OVER () - coalesce(sum(stop) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
    FROM s WINDOW o AS (ORDER BY stop / w, source NULLS LAST), b AS (ORDER BY stop / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
    SELECT source, source_size, least(stop, coalesce(w * (SELECT level FROM l WHERE w * level < stop ORDER BY pos LIMIT 1), stop)) AS target FROM l),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS n_full FROM t),
h AS (SELECT source, h, sum(size) AS m FROM d GROUP BY source, h),
c AS (SELECT *, sum(m) OVER (PARTITION BY source ORDER BY h) AS upto FROM h),
e AS (
    SELECT f.source, min(CASE WHEN upto > target - n_full * source_size THEN h END) AS edge
    FROM f JOIN c ON f.source IS NOT DISTINCT FROM c.source GROUP BY f.source),
g AS (
    SELECT f.*, CASE WHEN edge IS NULL OR target <= n_full * source_size THEN 0 WHEN 2 * (target - n_full * source_size - (upto - m)) >= m THEN edge + 1 ELSE edge END AS below
    FROM f JOIN e ON f.source IS NOT DISTINCT FROM e.source LEFT JOIN c ON c.source IS NOT DISTINCT FROM e.source AND c.h = e.edge)
SELECT doc_id, size, source_size, target, (size * n_taken)::BIGINT AS taken, n_taken::INTEGER AS copies
FROM (SELECT d.doc_id, d.size, g.source_size, g.target, g.n_full + CASE WHEN d.h < g.below THEN 1 ELSE 0 END AS n_taken
    FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)"""
