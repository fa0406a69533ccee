"""Query op9: all documents into 24 shards under the law ``rows``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measura.llm import sharding
from measura.sources.tables import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Only the key and the two figures of the text travel with a row.
    out = sharding.shard_ring(docs).select(
        "doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
    return out
