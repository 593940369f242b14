"""A corpus pipeline: toxic documents go, exact copies go, one of each group of near duplicates stays, sources are
mixed to their weights, and texts become token ids."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.llm import bpe, exact_dedup, mixing, ngram_join
from vigilspark.llm import toxicity as toxic
from vigilspark.session import shared_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; null and empty texts have no toxic words and stay."""
    return toxic.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("score < 0.5").drop("score")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest original of equal texts; null equals empty."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 80 % similarity connect; texts without words stay."""
    return ngram_join.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows taken under the production weights; a row of two epochs appears twice."""
    return mixing.take(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row left, their number, and the decoded text's digest."""
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path)
    rows = coded.withColumns({"n_tokens": F.size("ids").cast("long"), "token_ids": F.col("ids")})
    return bpe.decode(rows, path, text="decoded").withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("ngram_jaccard", near),
    ("mixing", mixture),
    ("bpe", encoded),
]

#: No SQL: the scores come from a trained model. The tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are written as Parquet and read again."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
