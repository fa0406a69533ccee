"""Query op1: the language of every whole document, learnt outside the held-out quarter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from measura.llm import language_id
from measura.sources.tables import spread, table

FOLDS, HELD_OUT = 4, 2


def fold(key: str = "doc_id") -> Column:
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % FOLDS


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    models = language_id.fit(docs.select("doc_id", "lang", "text").where(fold() != HELD_OUT))
    found = language_id.predict(docs.select("doc_id", "text"), models)
    return found.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), F.col("nearest").alias("lang_pred"), "score", "cross_entropy", "rejected")
