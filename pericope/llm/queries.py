"""The queries of this folder and their DuckDB SQL, which __spark_entry__.py adds to the library's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pericope.llm import decontaminate, gif, html, jaccard, langid, lm, packing, pii, quality, urlrules


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(_read(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lm.encoded(_read(spark, sf_dir, "documents"))
    return lm.score(ids, lm.train(ids))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"), html.train())


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return quality.score(docs, labels, quality.train(docs, labels))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(_read(spark, sf_dir, "documents"), pii.train())


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.verdicts(_read(spark, sf_dir, "pages"), urlrules.rules_table(spark))


def op10_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no media, so every row of embeddings is first made an animation, by gif.from_vectors()."""
    return gif.decode(gif.from_vectors(_read(spark, sf_dir, "embeddings")), id_col="vec_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_ngram_jaccard, op3_lm_scoring, op4_html_extraction, op5_quality, op6_packing, op7_pii, op8_language_id, op9_url_filters, op10_gif_media)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontaminate.sql(), "op2_ngram_jaccard": jaccard.sql(), "op6_packing": packing.sql(), "op9_url_filters": urlrules.sql()}
