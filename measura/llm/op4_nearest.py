"""Query op4: the ten nearest rows of every hundredth vector, among all vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measura.llm import one_bit_ann
from measura.sources.tables import table

EVERY = 100


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_bit_ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % EVERY == 0)
