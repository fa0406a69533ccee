"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Edge cases: a row is told by its id and its text, so texts that share an id are documents of their own, as are texts without
one.  Null and empty texts aren't toxic by themselves, have no copies, hold no benchmark passage, cost no tokens and go to a
shard like any other.  Without labels of both kinds no text is toxic.  Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from measura.llm import mixing, ngram_join, op5_mixing, op10_toxicity, sharding, toxicity, wu_manber
from measura.session import drop_materialized, free_shuffles, materialize
from measura.sources.tables import spread, table

#: Ids of kept documents are broadcast up to this number; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
MAX_EPOCHS = 2
WEIGHTS = [{}, {"en": 5, "de": 2, "fr": 2, "es": 1}, {}]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(op10_toxicity.fold() != op10_toxicity.HELD_OUT)
    machine = toxicity.fit(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs, machine).where("score < 0.5").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that 5-word shingles link at a similarity of 0.8 or more, the one with the smallest id stays (ties: of
    the smallest text hash; an id before none).

    Rows with one id and one text are one document; texts without words are linked with nothing, so all stay.
    """
    digest = F.unhex(F.left(F.sha2(F.col("text"), 256), F.lit(32)))  # 128 bits
    told = [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.coalesce(digest, F.lit(bytearray())).alias("hash")]
    found = ngram_join.groups(docs.select("doc_id", "text", *told), words=5, num=80, den=100, keep=["no_id", "id", "hash"], mark="group")
    row = F.struct("no_id", "id", "hash")
    first = found.where("group IS NOT NULL").groupBy("group").agg(F.min(row).alias("row"))
    copies = found.groupBy("no_id", "id", "hash", "group").agg(F.count("*").alias("rows"))
    kept = materialize(copies.join(first, "group", "left").where(row.eqNullSafe(F.col("row")) | F.col("group").isNull()).select(row.alias("told"), (F.col("rows") > 1).alias("repeated"), F.col("group").isNull().alias("empty")), "pipeline-kept")
    drop_materialized(spark, found)
    free_shuffles(spark)
    bounded = F.broadcast if kept.count() <= BROADCAST_ROWS else lambda df: df
    keyed = docs.withColumn("told", F.struct(*told))
    several = F.col("repeated") & ~F.col("empty")
    stay = keyed.join(bounded(kept.where(~several).select("told")), "told", "left_semi").select(*docs.columns)
    repeated = kept.where(several).select("told")
    if repeated.isEmpty():
        return stay
    return stay.unionByName(keyed.join(bounded(repeated), "told", "left_semi").dropDuplicates(["told"]).select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a 10-word window of a benchmark item go."""
    found = wu_manber.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("items") == 0).select(*docs.columns)


def budget() -> Column:
    """Nine tenths of the tokens that are left."""
    return F.expr("total * 9 div 10")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, at most MAX_EPOCHS times."""
    used = mixing.mix(docs, op5_mixing.levels(), WEIGHTS, budget(), MAX_EPOCHS)
    return used.withColumn("use", F.explode(F.sequence(F.lit(1), F.col("uses").cast("int")))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places what is left into 24 shards on the bounded-load ring."""
    return sharding.shard_ring(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram join", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The toxicity model and the text operators have no SQL form; tests/llm hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spread(table(spark, sf_dir, "documents")), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{k}")
            if before is not None:
                drop_materialized(spark, before)
            before = docs
            free_shuffles(spark)
    return docs
