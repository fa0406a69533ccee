"""Small exact games, codes and outcome tables (survey 2.2, 2.5, 2.7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from measura.operators import exact
from measura.plans.shared import family
from measura.sources import views
from measura.sources.tables import table

MOVES = (1, 3, 4)


def grundy_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a game whose heaps are its quantities, from which MOVES may be taken: its Grundy number, 0 for those that the
    player to move loses."""
    heaps = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("heap"))
    found = heaps.join(F.broadcast(exact.grundy(spark, MOVES, 64)), "heap")
    return found.groupBy("l_orderkey").agg(F.bit_xor("grundy").alias("grundy"))


def signs(row: Column, place: Column) -> Column:
    """1 or -1: the 16 x 16 Hadamard matrix."""
    return F.when(F.bit_count(row.bitwiseAND(place)) % 2 == 0, 1).otherwise(-1)


def walsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walsh coefficients of every line of the lattice: its lanes under each row of the Hadamard matrix, added up in one pass."""
    g = views.grid(spark, sf_dir)
    sums = g.groupBy("t", "y").agg(*(F.sum(F.col("lane") * signs(F.lit(r).cast("long"), F.col("x"))).alias(f"r{r}") for r in range(16)))
    rows = F.array(*(F.struct(F.lit(r).cast("long").alias("r"), F.col(f"r{r}").alias("coefficient")) for r in range(16)))
    return sums.select("t", "y", F.explode(rows).alias("c")).select("t", "y", "c.*")


REGISTRY = {
    "grundy_sequence": (
        grundy_sequence,
        """
        WITH RECURSIVE g(heap, seq) AS (
          SELECT CAST(0 AS BIGINT), CAST([0] AS BIGINT[]) UNION ALL
          SELECT heap + 1, list_append(seq, CAST((SELECT MIN(c) FROM range(0, 5) t(c) WHERE NOT list_contains(
            list_filter([CASE WHEN heap + 1 >= 1 THEN seq[heap + 1] END, CASE WHEN heap + 1 >= 3 THEN seq[heap - 1] END, CASE WHEN heap + 1 >= 4 THEN seq[heap - 2] END], lambda x: x IS NOT NULL), c)) AS BIGINT))
          FROM g WHERE heap < 63)
        SELECT l_orderkey, bit_xor(seq[heap + 1]) AS grundy FROM lineitem JOIN g ON g.heap = CAST(l_quantity AS BIGINT) GROUP BY l_orderkey
        """,
    ),
    "hadamard_cover": (
        walsh,
        f"""
        WITH g AS ({views.SQL["g"]})
        SELECT t, y, r.range AS r, CAST(SUM(CASE WHEN bit_count(r.range & x) % 2 = 0 THEN lane ELSE -lane END) AS BIGINT) AS coefficient FROM g CROSS JOIN range(16) r GROUP BY t, y, r.range
        """,
    ),
} | family(
    nim_losses="""
        SELECT l_orderkey AS k, COUNT(*) AS heaps, CAST(SUM(l_quantity) AS BIGINT) AS stones FROM lineitem GROUP BY l_orderkey HAVING BIT_XOR(CAST(l_quantity AS BIGINT)) = 0""",
    wythoff_losses="""
        WITH h AS (SELECT l_orderkey AS k, l_linenumber AS line, CAST(l_quantity AS BIGINT) AS v FROM lineitem)
        SELECT a.k, a.line, b.line AS other, a.v AS a, b.v AS b FROM h a JOIN h b ON b.k = a.k AND b.line <> a.line AND b.v >= a.v WHERE CAST(FLOOR((b.v - a.v) * (1 + SQRT(5.0E0)) / 2) AS BIGINT) = a.v""",
    hamming_decode="""
        WITH w AS (SELECT p_partkey AS part, CAST(p_size AS BIGINT) % 8 AS hit, p_partkey % 2 AS d1, DIV(p_partkey, 2) % 2 AS d2, DIV(p_partkey, 4) % 2 AS d3, DIV(p_partkey, 8) % 2 AS d4 FROM part),
             e AS (SELECT part, hit, (d1 + d2 + d4) % 2 AS c1, (d1 + d3 + d4) % 2 AS c2, d1 AS c3, (d2 + d3 + d4) % 2 AS c4, d2 AS c5, d3 AS c6, d4 AS c7 FROM w),
             f AS (SELECT part, hit, (c1 + CASE WHEN hit = 1 THEN 1 ELSE 0 END) % 2 AS c1, (c2 + CASE WHEN hit = 2 THEN 1 ELSE 0 END) % 2 AS c2, (c3 + CASE WHEN hit = 3 THEN 1 ELSE 0 END) % 2 AS c3,
                          (c4 + CASE WHEN hit = 4 THEN 1 ELSE 0 END) % 2 AS c4, (c5 + CASE WHEN hit = 5 THEN 1 ELSE 0 END) % 2 AS c5, (c6 + CASE WHEN hit = 6 THEN 1 ELSE 0 END) % 2 AS c6, (c7 + CASE WHEN hit = 7 THEN 1 ELSE 0 END) % 2 AS c7
                   FROM e)
        SELECT part, hit, (c1 + c3 + c5 + c7) % 2 + 2 * ((c2 + c3 + c6 + c7) % 2) + 4 * ((c4 + c5 + c6 + c7) % 2) AS syndrome FROM f""",
    nearest_codeword="""
        WITH w AS (SELECT k AS word, k + 16 * ((k % 2 + DIV(k, 2) % 2 + DIV(k, 4) % 2) % 2) + 32 * ((k % 2 + DIV(k, 2) % 2 + DIV(k, 8) % 2) % 2) + 64 * ((k % 2 + DIV(k, 4) % 2 + DIV(k, 8) % 2) % 2) AS code FROM bits),
             r AS (SELECT p_partkey AS part, w.word, XOR(p_partkey % 128, w.code) AS diff FROM part CROSS JOIN w)
        SELECT part, CAST(MIN(BIT_COUNT(diff) * 16 + word) % 16 AS BIGINT) AS word, CAST(DIV(MIN(BIT_COUNT(diff) * 16 + word), 16) AS BIGINT) AS distance FROM r GROUP BY part""",
    outcome_entropy="""
        WITH n AS (SELECT user_id, sym, COUNT(*) AS n FROM e GROUP BY user_id, sym), t AS (SELECT user_id, sym, n, SUM(n) OVER (PARTITION BY user_id) AS t FROM n)
        SELECT user_id, ROUND(-SUM(CAST(n AS DOUBLE) / t * LOG2(CAST(n AS DOUBLE) / t)), 6) AS bits, MAX(n) AS top FROM t GROUP BY user_id""",
    information_gain="""
        WITH n AS (SELECT l_returnflag AS a, l_linestatus AS b, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus),
             x AS (SELECT n, SUM(n) OVER (PARTITION BY a) AS na, SUM(n) OVER (PARTITION BY b) AS nb, SUM(n) OVER () AS t FROM n)
        SELECT ROUND(SUM(CAST(n AS DOUBLE) / t * LOG2(CAST(n AS DOUBLE) * t / (CAST(na AS DOUBLE) * nb))), 6) AS gain FROM x""",
    move_prior="""
        WITH m AS (SELECT sym, LEAD(sym) OVER (PARTITION BY user_id ORDER BY pos) AS nxt FROM e), n AS (SELECT sym, nxt, COUNT(*) AS n FROM m WHERE nxt IS NOT NULL GROUP BY sym, nxt)
        SELECT sym, nxt, n, CAST(SUM(n) OVER (PARTITION BY sym) AS BIGINT) AS total FROM n""",
    prime_gaps="""
        WITH n AS (SELECT a.k * 16 + b.k AS n FROM bits a CROSS JOIN bits b), c AS (SELECT DISTINCT x.n * y.k AS n FROM n x CROSS JOIN bits y WHERE x.n >= 2 AND y.k >= 2 AND x.n * y.k < 256),
             p AS (SELECT p_brand AS brand, p_partkey AS part FROM part WHERE p_size IN (SELECT n FROM n WHERE n >= 2 AND n NOT IN (SELECT n FROM c)))
        SELECT brand, part, part - LAG(part) OVER (PARTITION BY brand ORDER BY part) AS gap FROM p""",
    radial_shells="""
        WITH s AS (SELECT (l_partkey % 16 - 8) * (l_partkey % 16 - 8) + (l_suppkey % 16 - 8) * (l_suppkey % 16 - 8) AS r2, CAST(l_quantity AS BIGINT) AS v FROM lineitem)
        SELECT r2, COUNT(*) AS n, CAST(SUM(v) AS BIGINT) AS total FROM s GROUP BY r2""",
    electron_shells="""
        WITH s AS (SELECT n.k AS n, l.k AS l, 2 * (2 * l.k + 1) AS capacity FROM bits n CROSS JOIN bits l WHERE n.k BETWEEN 1 AND 7 AND l.k < n.k AND l.k <= 3 AND n.k + l.k <= 8),
             f AS (SELECT n, l, capacity, CAST(SUM(capacity) OVER (ORDER BY n + l, n) AS BIGINT) AS filled FROM s)
        SELECT p_partkey AS part, f.n, f.l, CAST(p_size - f.filled + f.capacity AS BIGINT) AS held FROM part JOIN f ON p_size <= f.filled AND p_size > f.filled - f.capacity""",
    bit_field_ops="""
        WITH a AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_quantity > 45), b AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_discount >= 0.09)
        SELECT p % 8 AS lane, COUNT(*) AS only_in_a FROM (SELECT p FROM a EXCEPT SELECT p FROM b) x GROUP BY p % 8""",
)
