"""Record programs: straight-line exact integer programs over joined records (survey 2.10, 2.13).

Members are line items with their orders and parts; fields are whole numbers (hundredths, days, sizes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from measura.functions import exact
from measura.operators.lanes import with_lanes
from measura.operators.program import Program
from measura.plans.shared import family, other_form
from measura.sources.tables import table

RECORDS = """records AS (SELECT l.l_orderkey AS k, CAST(l.l_linenumber AS BIGINT) AS line, l.l_partkey AS part, l.l_suppkey AS supp, CAST(l.l_quantity AS BIGINT) AS qty,
                    CAST(ROUND(l.l_extendedprice * 100) AS BIGINT) AS price, CAST(ROUND(o.o_totalprice * 100) AS BIGINT) AS total, CAST(p.p_size AS BIGINT) AS size
             FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey)"""
#: Rungs of the Fibonacci ladder from 1, 1.
LADDER = "ladder AS (SELECT CAST(ROUND(POWER((1 + SQRT(5.0E0)) / 2, k + 1) / SQRT(5.0E0)) AS BIGINT) AS rung FROM rungs)"


def prog_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of steps in one program, built as Columns from a step list."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("qty"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"))
    program = Program().field("q", "qty").field("p", "price").constant("c", 97).sum("s", "q", "c").difference("d", "p", "s").product("m", "q", "c").quotient("u", "d", "m").remainder("r", "d", "m")
    program = program.absolute("a", "d").compare("o", "p", "m").gcd("g", "p", "m").ladder("l", "p", "m").xor("x", "q", "c").band("n", "q", "c").wrap("w", "d", 16).table("t", "q", [3, 1, 4, 1, 5, 9, 2, 6])
    return program.apply(rows).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(program.names()))


def prog_group_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities summed over groups of eight lanes."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", F.col("l_quantity").cast("long").alias("qty"))
    lanes = with_lanes(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"])
    return lanes.groupBy(F.expr("lane div 8").alias("grp")).agg(F.sum("qty").alias("total"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, line, part, supp, qty, price, size): line items with their parts, those that have an order."""
    hundredths = F.round(F.col("l_extendedprice") * 100).cast("long").alias("price")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").cast("long").alias("qty"), hundredths)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_size").cast("long").alias("size"))
    return rows.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), "k").join(parts, "part")


RUNGS = 40


def reached(most: Column, by: Column | None = None) -> Column:
    """How many rungs of the ladder, taken ``by`` times each, are at most ``most``: counted inside the row."""
    line = F.array(*(F.lit(r).cast("long") for r in exact.ladder_rungs(RUNGS)))
    return F.size(F.filter(line, lambda r: (r if by is None else r * by) <= most)).cast("long")


def prog_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("k", "line", "part", "supp", *(reached(F.col(c)).alias(f"{c}_band") for c in ("qty", "price", "size")))


def prog_print_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of the prints of every two lines of an order."""
    prints = records(spark, sf_dir).select("k", "line", "part", *(reached(F.col(c)).alias(c) for c in ("qty", "price", "size")))
    pairs = prints.alias("a").join(prints.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.line") < F.col("b.line")))
    apart = sum((F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in ("qty", "price", "size")), F.lit(0))
    return pairs.select("a.k", "a.line", F.col("b.line").alias("other"), "a.part", F.col("b.part").alias("other_part"), (100 - apart).cast("long").alias("likeness"))


def prog_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("k", "line", "part", "supp", reached(F.col("size"), F.col("qty")).alias("rungs"))


REGISTRY = {
    "prog_fingerprint": (prog_fingerprint, other_form("WITH " + RECORDS + ", " + LADDER + """
        SELECT k, line, part, supp, CAST(SUM(CASE WHEN rung <= qty THEN 1 ELSE 0 END) AS BIGINT) AS qty_band, CAST(SUM(CASE WHEN rung <= price THEN 1 ELSE 0 END) AS BIGINT) AS price_band, CAST(SUM(CASE WHEN rung <= size THEN 1 ELSE 0 END) AS BIGINT) AS size_band
        FROM records CROSS JOIN ladder GROUP BY k, line, part, supp, qty, price, size""")),
    "prog_print_distance": (prog_print_distance, other_form("WITH " + RECORDS + ", " + LADDER + """,
             prints AS (SELECT k, line, part, supp, SUM(CASE WHEN rung <= qty THEN 1 ELSE 0 END) AS b1, SUM(CASE WHEN rung <= price THEN 1 ELSE 0 END) AS b2, SUM(CASE WHEN rung <= size THEN 1 ELSE 0 END) AS b3
                        FROM records CROSS JOIN ladder GROUP BY k, line, part, supp, qty, price, size)
        SELECT a.k, a.line, b.line AS other, a.part, b.part AS other_part, CAST(100 - ABS(a.b1 - b.b1) - ABS(a.b2 - b.b2) - ABS(a.b3 - b.b3) AS BIGINT) AS likeness FROM prints a JOIN prints b ON a.k = b.k AND a.line < b.line""")),
    "prog_ladder": (prog_ladder, other_form("WITH " + RECORDS + ", " + LADDER + """
        SELECT k, line, part, supp, CAST(SUM(CASE WHEN rung * qty <= size THEN 1 ELSE 0 END) AS BIGINT) AS rungs FROM records CROSS JOIN ladder GROUP BY k, line, part, supp, qty, size""")),
    "prog_group_sum": (
        prog_group_sum,
        """
        SELECT lane // 8 AS grp, CAST(SUM(qty) AS BIGINT) AS total
        FROM (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS lane, CAST(l_quantity AS BIGINT) AS qty FROM lineitem)
        GROUP BY 1
        """,
    ),
    "prog_mixed": (
        prog_mixed,
        """
        WITH RECURSIVE x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS p, CAST(97 AS BIGINT) AS c FROM lineitem),
             fib AS (SELECT CAST(1 AS BIGINT) AS a, CAST(1 AS BIGINT) AS b UNION ALL SELECT b, a + b FROM fib WHERE b < 1000000000000),
             y AS (SELECT *, q + c AS s, p - q - c AS d, q * c AS m FROM x)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, q, p, c, s, d, m, d // m AS u, d % m AS r, abs(d) AS a, CAST(sign(p - m) AS BIGINT) AS o, gcd(p, m) AS g,
               CAST(sign(p) * (SELECT COUNT(*) FROM fib WHERE fib.a * y.m <= abs(y.p)) AS BIGINT) AS l, xor(q, c) AS x, q & c AS n,
               (((d + 32768) % 65536) + 65536) % 65536 - 32768 AS w, CAST([3, 1, 4, 1, 5, 9, 2, 6][(q & 7) + 1] AS BIGINT) AS t FROM y
        """,
    ),
} | family(
    prog_velocity="WITH " + RECORDS + """
        SELECT a.k, a.line, a.part, a.supp, b.line AS next_line, b.qty * a.price - a.qty * b.price AS moment,
               CASE WHEN b.price > a.price THEN 1 WHEN b.price < a.price THEN -1 ELSE 0 END * CASE WHEN b.qty > a.qty THEN 1 WHEN b.qty < a.qty THEN -1 ELSE 0 END AS agree
        FROM records a JOIN records b ON a.k = b.k AND b.line = a.line + 1""",
    prog_division="WITH " + RECORDS + """
        SELECT p.k, p.line AS parent, c.line AS child, s.line AS sibling, ABS(p.qty - c.qty - s.qty) AS gap
        FROM records p JOIN records c ON p.k = c.k AND c.line > p.line JOIN records s ON p.k = s.k AND s.line > c.line
        WHERE 10 * ABS(p.qty - c.qty - s.qty) <= 3 * p.qty""",
    prog_contact_side="WITH " + RECORDS + """
        SELECT a.k, a.line, b.line AS other, a.part, b.part AS other_part, SIGN(CAST((b.qty - a.qty) * (b.size - a.size) + (b.line - a.line) * (b.line - a.line) AS DOUBLE)) > 0 AS kept
        FROM records a JOIN records b ON a.k = b.k AND a.line < b.line""",
    prog_wrap_xor="WITH " + RECORDS + """
        SELECT k, line, part, supp, XOR(part, supp) AS mixed, (price + 32768) % 65536 - 32768 AS wrapped FROM records""",
    prog_table_lookup="WITH " + RECORDS + """,
             t AS (SELECT k AS cell, (k * 37 + 11) % 16 AS value FROM bits)
        SELECT r.k, r.line, r.part, r.supp, t.value FROM records r JOIN t ON t.cell = r.qty % 16""",
    prog_latch="WITH " + RECORDS + " SELECT k, MIN(line) AS first_lane FROM records WHERE qty > 40 GROUP BY k",
    prog_exact_quotient="WITH " + RECORDS + " SELECT k, line, part, supp, DIV(price * qty, qty) AS back, price % qty AS rest FROM records WHERE qty > 0",
    prog_ratio_compare="WITH " + RECORDS + """
        SELECT a.k, a.line, b.line AS other, a.part, b.part AS other_part, CASE WHEN a.price * b.qty > b.price * a.qty THEN 1 WHEN a.price * b.qty < b.price * a.qty THEN -1 ELSE 0 END AS dearer
        FROM records a JOIN records b ON a.k = b.k AND a.line < b.line""",
    exact_mean_residual="WITH " + RECORDS + """,
             m AS (SELECT k, CAST(SUM(qty) AS BIGINT) AS s, COUNT(*) AS n FROM records GROUP BY k)
        SELECT r.k, r.line, r.part, r.supp, r.qty * m.n - m.s AS numerator, m.n AS denominator FROM records r JOIN m ON r.k = m.k""",
)
