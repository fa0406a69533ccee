"""Query op13: audits and repairs of damaged conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measura.llm import conversations
from measura.session import materialize
from measura.sources.tables import table

DROPPED, EMPTIED, UNENDED, REPEATED, USER = range(5)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): what the contract's damage leaves, dropped rows with no copies."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    deed = F.crc32(F.encode(F.concat_ws(":", named("conv_id"), named("turn")), "UTF-8")) % 20
    return rows.select(
        "conv_id",
        "turn",
        F.when(deed == USER, "user").otherwise(named("role")).alias("role"),
        F.when(deed == EMPTIED, "").when(deed == UNENDED, F.translate(named("text"), ".!?", "")).otherwise(named("text")).alias("text"),
        F.when(deed == DROPPED, 0).when(deed == REPEATED, 2).otherwise(1).alias("copies"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    audited = materialize(conversations.audits(rows, copies="copies"), "conversation-audits")
    digests = conversations.digests(conversations.repaired(rows, audited, copies="copies"))
    none = F.sha2(F.lit(""), 256)
    joined = audited.alias("a").join(digests.alias("d"), F.col("a.conv").eqNullSafe(F.col("d.conv")), "left")
    return joined.select(F.col("a.conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", none).alias("repaired_sha256"))
