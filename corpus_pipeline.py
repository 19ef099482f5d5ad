"""Documents to training windows: quality, boilerplate lines, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame; all but
the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.decontaminate import decontaminate
from evidentia.llm.line_dedup import remove_boilerplate
from evidentia.llm.near_dup import near_duplicates
from evidentia.llm.packing import pack
from evidentia.llm.quality import THRESHOLD, fit, score
from evidentia.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at or above the threshold."""
    network = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, network, keep=COLUMNS).where(F.col("score") >= THRESHOLD).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines."""
    out = remove_boilerplate(docs, carry=["lang"])
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id."""
    return near_duplicates(docs, carry=["lang", "source", "n_chars"], representatives_only=True).select(*COLUMNS)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows."""
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("ngram_jaccard", near_dup),
    ("decontaminate", leaks),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier, MinHash candidates and a tokenizer are beyond SQL; tests/llm hold a brute-force version.
ORACLE_SQL = None
