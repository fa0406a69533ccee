"""Query op7: token ids of every whole document, written to Simple-8b files and read back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from measura.llm import token_files
from measura.sources.tables import table

TOKENIZER, END_ID = "byte_bpe_50k.json", 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(TOKENIZER), END_ID)
    return token_files.read_tokens(spark, folder).withColumnRenamed("key", "doc_id")
