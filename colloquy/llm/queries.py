"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontamination, html_text, importance, language_id, license_scan, oracles, periodic_runs, pieces, quality, secrets, simhash, substring_dedup, toxicity
from .common import fold_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


def base_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op1 that SQL can express."""
    return op1_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.filter(fold_of("doc_id", 4) != 2))
    return quality.classify(docs, model).withColumn("held_out", fold_of("doc_id", 4) == 2)


def quality_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op4 that SQL can express: rows, folds, and that the decision follows the score."""
    return op4_quality(spark, sf_dir).select("doc_id", "held_out", (F.col("score").between(0, 1) & ((F.col("score") >= 0.7) == (F.col("predicted") == 1))).alias("consistent"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.filter(fold_of("doc_id", 5) != 0))
    return language_id.predict(docs.select("doc_id", "text"), model).withColumn("held_out", fold_of("doc_id", 5) == 0)


def language_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op5 that SQL can express: rows, folds, and which texts have no letter."""
    return op5_language_id(spark, sf_dir).select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("unknown"), F.col("score").between(0, 1).alias("consistent"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_table(spark, sf_dir, "documents")).drop("removed")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs)
    of_rule = F.transform("spans", lambda s: s["rule"])
    counts = [F.size(F.filter(of_rule, F.lit(i).__eq__)).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(secrets.BASE_RULES)]
    base = F.filter("spans", lambda s: s["rule"] < len(secrets.BASE_RULES))
    return found.select("doc_id", *counts, F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", periodic_runs.made_periodic(F.col("doc_id"), F.col("text")).alias("text"))
    return periodic_runs.detect(docs).drop("n_words")


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"), html_text.train(html_text.labelled_blocks(spark)))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, base_licenses, op2_decontamination, op3_simhash, op4_quality, quality_held_out, op5_language_id, language_held_out, op6_ann, op7_substring_dedup, op8_sentencepiece, op9_secrets, op10_toxicity, op11_periodic_runs, op12_html_extraction, op13_importance_resampling)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
