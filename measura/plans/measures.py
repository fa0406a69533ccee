"""Measures with state along the sequence or over whole planes: Arrow groups (survey 2.2, 2.3, 2.5, 2.8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measura.functions import exact, text
from measura.operators import sequences
from measura.plans import trees
from measura.sources import views
from measura.sources.tables import table


def match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.match_rate(table(spark, sf_dir, "documents"), "doc_id", "text")


def stay_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.stays(views.steps(spark, sf_dir), "user_id", "pos", "v", 2000)


def power_exponent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.power_exponent(views.quantities(spark, sf_dir), "part", "pos", "v")


def hilbert_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = views.grid(spark, sf_dir)
    return cells.select("t", "y", "x", sequences.hilbert_index(F.col("x"), F.col("y"), 4).alias("place"))


def cluster_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = views.words(spark, sf_dir).groupBy("lang", "word").agg(F.count("*").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("t"))
    return sequences.cluster_tree(counts.join(F.broadcast(total), "lang").select("lang", "word", (F.col("n") / F.col("t")).alias("share")), "lang", "word", "share")


def component_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.by_frame(views.grid(spark, sf_dir), "t", sequences.component_tree, 16)


def mark_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combining marks, uppercase runs and letter shares of each document."""
    docs = table(spark, sf_dir, "documents")
    runs = text.uppercase_runs(F.col("text"))
    return docs.select("doc_id", text.marks("text").alias("marks"), F.size(runs).alias("runs"), F.array_max(runs).alias("longest"), text.share_of(F.col("text"), r"\p{L}")["of"].alias("letters"))


def curve_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by Morton place, with bands, zig-zag and Gray codes of their lanes."""
    g = views.grid(spark, sf_dir)
    return g.select("t", "y", "x", exact.morton(F.col("x"), F.col("y"), 4).alias("place"), exact.band(F.col("lane")).alias("band"), exact.zigzag(F.col("lane") - 800).alias("zig"), exact.gray(F.col("lane")).alias("gray"))


def streaming_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate counts and quantiles beside exact ones, for tables past exact sorting."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.percentile_approx("l_quantity", [0.25, 0.5, 0.75], 10_000).alias("quartiles"), F.count("*").alias("n"))


#: The curve built from the cell of level 0: each level puts four copies together, the first and last of them turned.
HILBERT = """
    WITH RECURSIVE h(level, side, x, y, place) AS (
           SELECT 0, CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
           UNION ALL
           SELECT level + 1, 2 * side, CASE q WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN x + side ELSE 2 * side - 1 - y END, CASE q WHEN 0 THEN x WHEN 1 THEN y + side WHEN 2 THEN y + side ELSE side - 1 - x END, place + q * side * side
           FROM h CROSS JOIN (SELECT unnest(range(4)) AS q) WHERE level < 4),
         g AS (%s)
    SELECT g.t, g.y, g.x, h.place FROM g JOIN h ON h.level = 4 AND h.x = g.x AND h.y = g.y""" % views.SQL["g"]

STAYS = """
    WITH RECURSIVE e AS (%s),
         r(user_id, pos, began, stays) AS (
           SELECT user_id, pos, v, CAST(1 AS BIGINT) FROM e WHERE pos = 0
           UNION ALL
           SELECT e.user_id, e.pos, CASE WHEN abs(e.v - r.began) > 2000 THEN e.v ELSE r.began END, r.stays + CASE WHEN abs(e.v - r.began) > 2000 THEN 1 ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.pos = r.pos + 1)
    SELECT user_id, MAX(stays) AS stays, COUNT(*) AS steps FROM r GROUP BY user_id""" % views.SQL["e"]

REGISTRY = {
    "match_rate": (match_rate, None),
    "stay_runs": (stay_runs, STAYS),
    "power_exponent": (power_exponent, None),
    "hilbert_order": (hilbert_order, HILBERT),
    "cluster_tree": (cluster_tree, None),
    "component_tree": (component_tree, trees.FRAMES),
    "mark_inventory": (mark_inventory, None),
    "curve_keys": (
        curve_keys,
        """
        WITH RECURSIVE f(a, b) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT b, a + b FROM f WHERE b < 1000000000),
             g AS (SELECT CAST(year(l_shipdate) AS BIGINT) AS t, l_partkey % 16 AS y, l_suppkey % 16 AS x, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS lane FROM lineitem GROUP BY 1, 2, 3)
        SELECT t, y, x, CAST((x & 1) + (x & 2) * 2 + (x & 4) * 4 + (x & 8) * 8 + 2 * ((y & 1) + (y & 2) * 2 + (y & 4) * 4 + (y & 8) * 8) AS BIGINT) AS place,
               (SELECT COUNT(*) FROM f WHERE f.a <= g.lane) AS band, CASE WHEN lane >= 800 THEN 2 * (lane - 800) ELSE -2 * (lane - 800) - 1 END AS zig, xor(lane, lane >> 1) AS gray FROM g
        """,
    ),
    "approximate_profiles": (streaming_statistics, None),
}
