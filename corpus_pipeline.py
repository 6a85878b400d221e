"""The corpus pipeline: stages over `documents`, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark.llm import decontaminate, line_dedup, mixing, ngram_join, quality
from labelspark.llm.common import prepare
from labelspark.session import materialize


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble doesn't reject; it learns from the labels that aren't held out."""
    prepare(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each near-duplicate line once; a document that loses all it had goes."""
    prepare(spark)
    cleaned = line_dedup.dedupe_lines(docs)
    emptied = (F.col("n_removed") > 0) & (F.btrim("text", F.lit(" \t\r\n\u000b\f")) == "")
    kept = cleaned.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(
            docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def dedupe_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at four fifths of shared runs of five words."""
    prepare(spark)
    return ngram_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    prepare(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, mixed by source: one row per document with the words the mix takes from it."""
    prepare(spark)
    return mixing.mix(docs)["documents"]


STAGES = [
    ("filter_quality", filter_quality),
    ("dedupe_lines", dedupe_lines),
    ("dedupe_documents", dedupe_documents),
    ("drop_benchmark", drop_benchmark),
    ("mix_sources", mix_sources),
]

#: The first stage scores with a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
