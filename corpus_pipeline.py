"""From documents to token ids: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents, whatever they are called, and further ones as they
are. An empty table goes through all stages. Null ids are ids; repeated rows count
as near-duplicates of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import decontamination, language_id, pieces, secrets, simhash
from colloquy.llm.common import discard, fold_of, free_name, result_of

#: A kernel model and alignments are beyond SQL.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, null and empty ones too, and those in no language that can be told go. Repeated rows stay."""
    return language_id.without_unknown(docs, language_id.train(docs.filter(fold_of("doc_id", 5) != 0)))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by eight fingerprints of five-word shingles, the document of the smallest id stays, one row of it; null ids come last."""
    return simhash.one_of_each(docs)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go; null and empty texts hold none. Without items all stay."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; n_chars follows the text. Every row stays; null and empty texts are as they were."""
    spans = free_name(docs, "__spans")
    found = secrets.find_secrets(docs, spans_col=spans).withColumn("text", secrets.redacted(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        changed = F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", changed)
    return found.select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document: doc_id, n_pieces, ids, round_trip; null ids of a null text."""
    return pieces.encode(docs)


STAGES = [
    ("language_id", known_language),
    ("simhash_near_dedup", one_of_near_duplicates),
    ("benchmark_decontamination", not_in_benchmark),
    ("secret_scan", secrets_redacted),
    ("sentencepiece", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder for the next, and deleted behind that."""
    docs, had = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = result_of(spark, lambda: stage(spark, docs, sf_dir), name)
        if had is not None:
            discard(had)
        had = docs
    return STAGES[-1][1](spark, docs, sf_dir)
