"""From raw documents to token ids: quality rules, near-duplicates, personal data, source mix, SentencePiece.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept. All but the last return the columns of
``documents``; the mix repeats a row as often as it is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, mixing, pii, quality_rules, sentencepiece_scan
from tidemark.llm.shared import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = sentencepiece_scan.encode(docs.select("doc_id", "lang", "source", "text"))
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [
    ("quality rules", quality),
    ("n-gram jaccard join", near_duplicates),
    ("pii", personal_data),
    ("mixing sources", mix),
    ("sentencepiece", tokens),
]
ORACLE_SQL = None  # near-duplicates, PII and token ids are beyond SQL; tests compare the rows with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
