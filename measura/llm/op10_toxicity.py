"""Query op10: a toxicity score of every document, learnt from labels outside the held-out fifth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from measura.llm import toxicity
from measura.sources.tables import spread, table

FOLDS, HELD_OUT = 5, 0


def fold(key: str = "doc_id") -> Column:
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % FOLDS


def learn(spark: SparkSession, sf_dir: str) -> toxicity.Machine:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold() != HELD_OUT)
    return toxicity.fit(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    scored = toxicity.score(docs, learn(spark, sf_dir)).drop("text")
    return scored.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
