"""A corpus pipeline of five stages, each calling one operator of millrace.llm.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept; what it returns is written as
Parquet and read again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, language, mixing, near_dedup, pii
from millrace.llm.common import written


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: others (null, empty, without letters) go. A null lang gets the prediction.

    Where no row can be learned from, only texts without letters go, and lang stays as it is.
    """
    model = language.fit(docs, ~language.held_out())
    if model is None:
        return docs.filter(F.regexp_like("text", F.lit(r"\p{L}")))
    found = language.predict(docs, model).filter(F.col("lang_pred") != language.UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8 or more."""
    return near_dedup.deduplicated(docs, width=5, percent=80)


def clear_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by passages of the benchmark."""
    found = decontaminate.scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(~F.col("contaminated")).select(docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data replaced by its kind in brackets; n_chars follows the text."""
    found = pii.redact(pii.find(docs))
    return found.withColumn("n_chars", F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says, numbered by copy."""
    return mixing.mixed(docs)


STAGES = [("language", identify), ("near_dedup", deduplicate), ("decontaminate", clear_benchmarks), ("pii", redact), ("mixing", mix)]

#: Models and groups of similar documents are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that STAGES make of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
