"""The queries of this subpackage, by name, and DuckDB's SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from doclith.llm import jaccard, license_scan, mixing, pii, pseudo_likelihood, quality_rules, ranker, tiling, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pseudo_likelihood.score(docs, pseudo_likelihood.fit(docs))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op3_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranker.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality_rules.judge(docs).drop("lang", "text")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pseudo_likelihood": op1_pseudo_likelihood,
        "op2_url_filter": op2_url_filter,
        "op3_quality_ranking": op3_quality_ranking,
        "op4_license_scan": op4_license_scan,
        "op5_private_data": op5_private_data,
        "op6_warc": op6_warc,
        "op7_ngram_jaccard": op7_ngram_jaccard,
        "op8_decontaminate": op8_decontaminate,
        "op9_quality_rules": op9_quality_rules,
        "op10_mix_sources": op10_mix_sources,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_warc": warc.oracle_sql(),
        "op7_ngram_jaccard": jaccard.oracle_sql(),
        "op9_quality_rules": f"SELECT * EXCLUDE (lang, source, n_chars, text) FROM ({quality_rules.oracle_sql()})",
        "op10_mix_sources": mixing.oracle_sql(),
    }
