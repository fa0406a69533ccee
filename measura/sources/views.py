"""Readings of the tables as ordered sequences, sets and lattices: one Spark form and one SQL form each.

The Spark form is a DataFrame built from the table by column functions; the SQL form is what an independent engine runs
to check the queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from measura.operators import census, in_row
from measura.sources.tables import spread, table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, sym): code points of the documents, from position 0."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    docs = docs.select("doc_id", F.posexplode(F.split("text", "")).alias("pos", "sym"))
    return docs.where("sym <> ''").select("doc_id", F.col("pos").cast("long").alias("pos"), "sym")


def symbol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sym, n, first_pos): the symbols of each row, counted inside the row."""
    return census.row_census(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def neighbours(spark: SparkSession, sf_dir: str, width: int, of: str = "text") -> DataFrame:
    """(doc_id, pos, c0, c1, ...): each character with those after it, null past the end, put together inside the row, so that
    no character leaves its document's task."""
    chars = F.split(F.expr(of), "")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", chars.alias("chars"))
    shifted = F.arrays_zip(*(F.slice("chars", k + 1, F.greatest(F.size("chars") - k, F.lit(0))).alias(f"c{k}") for k in range(width)))
    rows = docs.select("doc_id", F.posexplode(shifted).alias("pos", "w"))
    return rows.where("w.c0 <> ''").select("doc_id", F.col("pos").cast("long").alias("pos"), "w.*")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, sym, nxt): code points with the one after them."""
    return neighbours(spark, sf_dir, 2).withColumnsRenamed({"c0": "sym", "c1": "nxt"})


def threes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, b1, b2, sym): runs of one, two and three code points, null past the end."""
    return neighbours(spark, sf_dir, 3).select("doc_id", "pos", F.col("c0").alias("b1"), F.concat("c0", "c1").alias("b2"), F.concat("c0", "c1", "c2").alias("sym"))


#: A text whose characters are the bytes of another one.
AS_BYTES = "decode(encode(text, 'UTF-8'), 'ISO-8859-1')"


def octets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, b): UTF-8 bytes of the documents."""
    return neighbours(spark, sf_dir, 1, AS_BYTES).select("doc_id", "pos", F.ascii("c0").cast("long").alias("b"))


def octet_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, pair): neighbouring bytes as first * 256 + second."""
    rows = neighbours(spark, sf_dir, 2, AS_BYTES).where("c1 IS NOT NULL")
    return rows.select("doc_id", "pos", (F.ascii("c0") * 256 + F.ascii("c1")).cast("long").alias("pair"))


def symbol_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sym, gap): steps between neighbouring places of a symbol in its document."""
    placed = F.sort_array(F.transform(F.split("text", ""), lambda c, i: F.struct(c.alias("sym"), i.alias("pos"))))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", placed.alias("p"))
    both = docs.select("doc_id", F.explode(F.arrays_zip(F.col("p").alias("a"), F.expr("slice(p, 2, greatest(size(p) - 1, 0))").alias("b"))).alias("x"))
    return both.where("x.a.sym = x.b.sym AND x.a.sym <> ''").select("doc_id", F.col("x.a.sym").alias("sym"), (F.col("x.b.pos") - F.col("x.a.pos")).cast("long").alias("gap"))


def in_rows(operator):
    """What an operator of measura.operators.in_row says of the documents."""
    return lambda spark, sf_dir: operator(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


#: A word: letters with their marks, and apostrophes.
WORD = r"[\p{L}\p{M}']+"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, pos, word): runs of letters, marks and apostrophes of the lower-cased documents, in any script."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).select("doc_id", "lang", F.posexplode(found).alias("pos", "word"))
    return rows.select("doc_id", "lang", F.col("pos").cast("long").alias("pos"), "word")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, pos, sym, v): each user's events in time order, with the value in whole hundredths."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("pos", F.row_number().over(order).cast("long") - 1)
    return rows.select("user_id", "pos", F.col("event_type").alias("sym"), F.round(F.col("value") * 100).cast("long").alias("v"))


def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, pos, v): the quantities of each part in the order of its line items."""
    order = W.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(order).cast("long") - 1)
    return rows.select(F.col("l_partkey").alias("part"), "pos", F.col("l_quantity").cast("long").alias("v"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, y, x, lane): a 16 x 16 lattice for each ship year, lanes summed from the quantities that fall into a cell."""
    cell = lambda c: (F.col(c) % 16).cast("long")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("t"), cell("l_partkey").alias("y"), cell("l_suppkey").alias("x"))
    return rows.agg(F.sum(F.col("l_quantity").cast("long")).alias("lane"))


def occupied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, z, y): cells a day's events occupy: user modulo 16 by event type in order of name."""
    kinds = {k: i for i, k in enumerate(("click", "error", "purchase", "scroll", "signup", "view"))}
    z = F.coalesce(F.create_map(*(x for k, i in kinds.items() for x in (F.lit(k), F.lit(i))))[F.col("event_type")], F.lit(6))
    rows = table(spark, sf_dir, "events").select(F.unix_date(F.to_date("ts")).cast("long").alias("day"), z.cast("long").alias("z"), (F.col("user_id") % 16).cast("long").alias("y"))
    return rows.distinct()


def numbers(low: int, high: int):
    """(k): the whole numbers from low up to, not including, high."""
    return lambda spark, sf_dir: spark.range(low, high).select(F.col("id").alias("k"))


SPARK = {
    "s": symbols,
    "sn": symbol_counts,
    "s2": pairs,
    "s3": threes,
    "s4": lambda spark, sf_dir: neighbours(spark, sf_dir, 4),
    "gaps": symbol_gaps,
    "on2": in_rows(in_row.octet_pair_counts),
    "block_kinds": in_rows(in_row.block_kinds),
    "pair_bits": in_rows(in_row.pair_entropy),
    "halves": in_rows(in_row.half_distance),
    "o": octets,
    "o2": octet_pairs,
    "w": words,
    "e": steps,
    "q": quantities,
    "g": grid,
    "c": occupied,
    "lags": numbers(1, 9),
    "periods": numbers(2, 13),
    "bits": numbers(0, 16),
    "rungs": numbers(0, 40),
}

SQL = {
    "s": "SELECT doc_id, generate_subscripts(string_split(text, ''), 1) - 1 AS pos, unnest(string_split(text, '')) AS sym FROM documents WHERE text <> ''",
    "o": "SELECT doc_id, pos, CAST(('0x' || x) AS BIGINT) AS b FROM (SELECT doc_id, generate_subscripts(regexp_extract_all(hex(encode(text)), '..'), 1) - 1 AS pos, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM documents)",
    "w": r"SELECT doc_id, lang, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{M}'']+'), 1) - 1 AS pos, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}'']+')) AS word FROM documents",
    "e": "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS sym, CAST(round(value * 100) AS BIGINT) AS v FROM events",
    "q": "SELECT l_partkey AS part, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_shipdate) - 1 AS pos, CAST(l_quantity AS BIGINT) AS v FROM lineitem",
    "g": "SELECT CAST(year(l_shipdate) AS BIGINT) AS t, l_partkey % 16 AS y, l_suppkey % 16 AS x, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS lane FROM lineitem GROUP BY 1, 2, 3",
    "c": "SELECT DISTINCT CAST(datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS day, CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'scroll' THEN 3 WHEN 'signup' THEN 4 WHEN 'view' THEN 5 ELSE 6 END AS BIGINT) AS z, user_id % 16 AS y FROM events",
    "lags": "SELECT range AS k FROM range(1, 9)",
    "periods": "SELECT range AS k FROM range(2, 13)",
    "bits": "SELECT range AS k FROM range(0, 16)",
    "rungs": "SELECT range AS k FROM range(0, 40)",
}
