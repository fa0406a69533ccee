"""Query op11: a quality score of every document, learnt from labels outside the held-out quarter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from measura.llm import ranking
from measura.sources.tables import spread, table

FOLDS, HELD_OUT, KEEP = 4, 2, 0.7


def fold(key: str = "doc_id") -> Column:
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % FOLDS


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(fold() != HELD_OUT)
    found = ranking.rank(docs, labels, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= KEEP, 1).otherwise(0).alias("predicted"))
