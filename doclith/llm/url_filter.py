"""URL filters: rules by host and path first, then the ratio of two character language models.

Two variable-order Markov models, of accepted and of rejected URLs, give each character's probability after up to four
characters before it; shorter contexts back longer ones by Witten-Bell interpolation. An URL's score is the difference
of its two log-likelihoods by character, rejected minus accepted; the threshold is calibrated on labelled URLs that
the models have not seen. Counting, smoothing and scoring are joins and sums of distinct character sequences: their
number follows the alphabet, hardly the input, and no model is collected.

The models see the whole URL, its scheme, query and fragment too; rules see its host and path.

Labels are weak: an URL that holds one of REJECT_TERMS anywhere is rejected; one without, that no rule blocks, accepted.

Defined cases: an URL that is null or has no ``://`` has an empty host and path, fits no rule and is blocked; repeated
URLs are scored once and each row gets the score; further columns stay, unless they have the name of a result; an
empty table gives an empty table. Without labelled URLs the threshold is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclith.llm.shared import cut

#: Fixed values.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
REJECT_TERMS = ("adult", "casino", "cheap", "gambl", "malware", "phish", "pills", "porn", "spam", "warez", "xxx")
ORDER = 4  # characters of context at most
ALPHABET = 256  # an unseen character's probability is one in this many
HELD_OUT = 5  # every fifth labelled URL calibrates
FALSE_REJECTIONS = 0.01
START, END = "\x02", "\x03"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AUTHORITY = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Model:
    """grams: gram, llr (the last character's log-probability, rejected minus accepted); block above threshold."""

    grams: DataFrame
    threshold: float


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda k: F.coalesce(F.regexp_extract(url, AUTHORITY, k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def best_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none fits: one CASE in order of length."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _grams(text: Column) -> Column:
    """For each character and the end mark: it and the ORDER characters before it."""
    padded = F.concat(F.lit(START * ORDER), text, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))


def _log_ratio(counts: DataFrame) -> DataFrame:
    """gram, llr of each gram in counts (gram, n_acc, n_rej); grams without counts get what their shorter contexts say."""
    out, chances = counts.select("gram"), {"acc": F.lit(1.0 / ALPHABET), "rej": F.lit(1.0 / ALPHABET)}
    for k in range(1, ORDER + 2):
        tail = counts.groupBy(F.expr(f"right(gram, {k})").alias(f"_g{k}")).agg(*(F.sum(f"n_{c}").alias(f"_n{k}_{c}") for c in chances))
        context = tail.groupBy(F.expr(f"left(_g{k}, {k - 1})").alias(f"_c{k}")).agg(
            *(F.sum(f"_n{k}_{c}").alias(f"_all{k}_{c}") for c in chances), *(F.sum((F.col(f"_n{k}_{c}") > 0).cast("long")).alias(f"_kinds{k}_{c}") for c in chances)
        )
        stats = tail.withColumn(f"_c{k}", F.expr(f"left(_g{k}, {k - 1})")).join(context, f"_c{k}").drop(f"_c{k}")
        out = out.withColumn(f"_g{k}", F.expr(f"right(gram, {k})")).join(stats, f"_g{k}").drop(f"_g{k}")
        names = {c: f"_p{k}_{c}" for c in chances}
        seen = lambda c: F.col(f"_all{k}_{c}") + F.col(f"_kinds{k}_{c}")  # noqa: B023, E731
        out = out.withColumns({names[c]: F.when(seen(c) > 0, (F.col(f"_n{k}_{c}") + F.col(f"_kinds{k}_{c}") * below) / seen(c)).otherwise(below) for c, below in chances.items()})
        out = out.select("gram", *names.values())
        chances = {c: F.col(n) for c, n in names.items()}
    return out.select("gram", (F.log(chances["rej"]) - F.log(chances["acc"])).alias("llr"))


def _scored(texts: DataFrame, grams: DataFrame) -> DataFrame:
    """_text, score of the distinct texts: a sum over their grams, normalised by their number."""
    each = texts.select("_text", F.explode(_grams(F.col("_text"))).alias("gram"))
    return each.join(grams, "gram", "left").groupBy("_text").agg((F.sum(F.coalesce("llr", F.lit(0.0))) / F.count(F.lit(1))).alias("score"))


def fit(texts: DataFrame) -> tuple[Model, DataFrame]:
    """The model from distinct ``_text`` with ``_label`` (accepted, rejected or null), and the scores of all texts."""
    held = F.pmod(F.xxhash64("_text"), F.lit(HELD_OUT)) == 0
    n = lambda label: F.sum(((F.col("_label") == label) & ~held & F.col("_label").isNotNull()).cast("long"))
    every = texts.select("_text", "_label", F.explode(_grams(F.col("_text"))).alias("gram"))
    counts = cut(every.groupBy("gram").agg(F.coalesce(n("accepted"), F.lit(0)).alias("n_acc"), F.coalesce(n("rejected"), F.lit(0)).alias("n_rej")))
    grams = cut(_log_ratio(counts))
    scores = cut(_scored(texts, grams))
    cuts = scores.join(texts.where(held & F.col("_label").isNotNull()), "_text").agg(
        F.percentile_approx(F.when(F.col("_label") == "accepted", F.col("score")), 1 - FALSE_REJECTIONS, 10_000),
        F.percentile_approx(F.when(F.col("_label") == "rejected", F.col("score")), FALSE_REJECTIONS, 10_000),
    ).first()
    upper, lower = cuts
    threshold = 0.0 if upper is None else (upper + lower) / 2 if lower is not None and lower > upper else upper
    return Model(grams, threshold), scores


def judge(df: DataFrame, url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, reject_terms: tuple[str, ...] = REJECT_TERMS) -> DataFrame:
    """The input's columns and host, path, rule, score, verdict."""
    df = df.drop(*(c for c in df.columns if c != url and c in ("host", "path", "rule", "score", "verdict", "_text", "_ruled", "_label")))
    host, path = host_and_path(F.col(url))
    df = df.withColumns({"host": host, "path": path})
    rule, ruled = best_rule(F.col("host"), F.col("path"), rules)
    named = F.concat("host", "path") != ""
    df = df.withColumns({"rule": rule, "_ruled": ruled, "_text": F.when(named, F.col(url)).otherwise(F.lit(""))})
    suspect = F.translate("_text", UPPER, LOWER).rlike("|".join(reject_terms))
    label = F.when(suspect, F.lit("rejected")).when(F.coalesce(F.col("_ruled"), F.lit("")) != "block", F.lit("accepted"))
    texts = cut(df.where("_text != ''").groupBy("_text").agg(F.min(label).alias("_label")))
    model, scores = fit(texts)
    method = F.when(F.col("score") <= model.threshold, F.lit("allow")).otherwise(F.lit("block"))
    return df.join(scores, "_text", "left").withColumn("verdict", F.coalesce("_ruled", method)).drop("_text", "_ruled")
