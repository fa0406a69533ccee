"""Query op8: the tokens of every whole document under the byte-level vocabulary."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from measura.llm import token_counts
from measura.sources.tables import spread, table

TOKENIZER = "byte_bpe_50k.json"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return token_counts.token_counts(docs, public_tokenizers.path(TOKENIZER)).drop("text")
