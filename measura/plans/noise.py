"""Noise statistics of the lattice as exact whole numbers (survey 2.12), and exact decimals, seals and group tests (2.13-2.15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measura.plans.lattice import FULL
from measura.plans.shared import family, other_form, spark_form
from measura.session import materialize
from measura.sources import arrays, views


def sealed_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SHA-256 tree over each year's lattice."""
    return arrays.seal(views.grid(spark, sf_dir), ["t"], ["y", "x"], "lane")


#: Sums of powers of the lanes, by year and block of rows.
MOMENTS = "WITH " + FULL + """
        SELECT t, DIV(y, 4) AS block, COUNT(*) AS n, CAST(SUM(lane) AS BIGINT) AS s1, CAST(SUM(lane * lane) AS BIGINT) AS s2, CAST(SUM(lane * lane * lane) AS BIGINT) AS s3 FROM full_grid GROUP BY t, DIV(y, 4)"""
WIDE = MOMENTS
for stated in ("lane", "lane * lane", "lane * lane * lane"):
    WIDE = WIDE.replace(f"CAST(SUM({stated}) AS BIGINT)", f"SUM({stated.replace('lane', 'CAST(lane AS DECIMAL(12, 0))')})")
SUMS = ["s1", "s2", "s3"]


def noise_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sums as 64-bit numbers, as in SQL, where all of a column fit; a column with larger ones, which SQL can't return, is decimal."""
    wide = materialize(spark_form(WIDE)(spark, sf_dir), "noise-moments")  # four rows a year
    fits = wide.agg(*(F.coalesce(F.max(F.abs(c)), F.lit(0)).alias(c) for c in SUMS)).first()
    return wide.withColumns({c: F.col(c).cast("long") for c in SUMS if fits[c] < 1 << 63})


REGISTRY = {
    "noise_moments": (noise_moments, other_form(MOMENTS)),
    "sealed_grid": (
        sealed_grid,
        """
        WITH g AS (SELECT CAST(year(l_shipdate) AS BIGINT) AS t, l_partkey % 16 AS y, l_suppkey % 16 AS x, SUM(CAST(l_quantity AS BIGINT)) AS lane FROM lineitem GROUP BY 1, 2, 3),
             p AS (SELECT t, row_number() OVER (PARTITION BY t ORDER BY y, x) - 1 AS place, lane FROM g),
             b AS (SELECT t, place // 1024 AS block, sha256(string_agg(sha256(place || ':' || lane), '' ORDER BY place)) AS digest FROM p GROUP BY 1, 2)
        SELECT t, sha256(string_agg(digest, '' ORDER BY block)) AS root FROM b GROUP BY t
        """,
    ),
} | family(
    noise_structure="WITH " + FULL + """
        SELECT l.k AS lag, DIV(a.lane + b.lane, 64) AS bin, COUNT(*) AS n, CAST(SUM((b.lane - a.lane) * (b.lane - a.lane)) AS BIGINT) AS squares
        FROM full_grid a CROSS JOIN lags l JOIN full_grid b ON b.t = a.t + l.k AND b.y = a.y AND b.x = a.x GROUP BY l.k, DIV(a.lane + b.lane, 64)""",
    noise_lines="WITH " + FULL + """,
             r AS (SELECT t, y, SUM(lane) AS s FROM full_grid GROUP BY t, y), c AS (SELECT t, x, SUM(lane) AS s FROM full_grid GROUP BY t, x),
             w AS (SELECT t, SUM(lane) AS s, SUM(lane * lane) AS q FROM full_grid GROUP BY t)
        SELECT w.t, CAST(256 * w.q - w.s * w.s AS BIGINT) AS total_ss, CAST(16 * a.q - w.s * w.s AS BIGINT) AS row_ss, CAST(16 * b.q - w.s * w.s AS BIGINT) AS column_ss
        FROM w JOIN (SELECT t, SUM(s * s) AS q FROM r GROUP BY t) a ON a.t = w.t JOIN (SELECT t, SUM(s * s) AS q FROM c GROUP BY t) b ON b.t = w.t""",
    noise_halves="WITH " + FULL + """
        SELECT a.t, COUNT(*) AS n, CAST(SUM(a.lane * b.lane) AS BIGINT) AS product, CAST(SUM(a.lane) AS BIGINT) AS left_sum, CAST(SUM(b.lane) AS BIGINT) AS right_sum
        FROM full_grid a JOIN full_grid b ON b.t = a.t AND b.y = a.y AND b.x = a.x + 8 WHERE a.x < 8 GROUP BY a.t""",
    noise_spikes="WITH " + FULL + """,
             n AS (SELECT t, y, x, lane, LAG(lane) OVER (PARTITION BY y, x ORDER BY t) AS before_lane, LEAD(lane) OVER (PARTITION BY y, x ORDER BY t) AS after_lane FROM full_grid)
        SELECT t, CAST(SUM(CASE WHEN lane > before_lane AND lane > after_lane THEN 1 ELSE 0 END) AS BIGINT) AS spikes, CAST(SUM(CASE WHEN lane < before_lane AND lane < after_lane THEN 1 ELSE 0 END) AS BIGINT) AS dips
        FROM n WHERE before_lane IS NOT NULL AND after_lane IS NOT NULL GROUP BY t""",
    noise_crosstalk="WITH " + FULL + """
        SELECT a.t, l.k AS lag, CAST(SUM(a.lane * b.lane) AS BIGINT) AS product, COUNT(*) AS n FROM full_grid a CROSS JOIN lags l JOIN full_grid b ON b.t = a.t AND b.y = a.y AND b.x = a.x + l.k WHERE l.k <= 3 GROUP BY a.t, l.k""",
    noise_pixel_halves="WITH " + FULL + """
        SELECT y, x, CAST(SUM(CASE WHEN t < 1996 THEN lane ELSE 0 END) AS BIGINT) AS early, CAST(SUM(CASE WHEN t >= 1996 THEN lane ELSE 0 END) AS BIGINT) AS late FROM full_grid GROUP BY y, x""",
    noise_line_fit="WITH " + FULL + """
        SELECT y, CAST(SUM(x * lane) * COUNT(*) - SUM(x) * SUM(lane) AS BIGINT) AS slope_num, CAST(SUM(x * x) * COUNT(*) - SUM(x) * SUM(x) AS BIGINT) AS slope_den FROM full_grid GROUP BY y""",
    residual_survey="WITH " + FULL + """,
             r AS (SELECT t, 4 * lane - COALESCE(LAG(lane) OVER (PARTITION BY t, y ORDER BY x), 0) - 2 * lane - COALESCE(LEAD(lane) OVER (PARTITION BY t, y ORDER BY x), 0) AS r FROM full_grid)
        SELECT t, CAST(SUM(CASE WHEN r > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive, MIN(r) AS lo, MAX(r) AS hi, CAST(SUM(ABS(r)) AS BIGINT) AS total FROM r GROUP BY t""",
    local_maxima="WITH " + FULL + """
        SELECT a.t, a.y, a.x, MAX(a.lane) AS lane FROM full_grid a JOIN full_grid b ON b.t = a.t AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND (b.y <> a.y OR b.x <> a.x)
        GROUP BY a.t, a.y, a.x HAVING MAX(a.lane) > MAX(b.lane)""",
    level_counts="WITH " + FULL + """,
             levels AS (SELECT t, y, x, DIV(lane, 128) AS level FROM full_grid)
        SELECT l.t, b.k AS cut, COUNT(*) AS above FROM levels l JOIN bits b ON l.level >= b.k GROUP BY l.t, b.k""",
    exact_decimals="""
        SELECT p_partkey, CAST(ROUND(p_retailprice * 100) AS BIGINT) AS scaled, CAST(2 AS BIGINT) AS places, DIV(CAST(ROUND(p_retailprice * 100) AS BIGINT), 100) AS whole, CAST(ROUND(p_retailprice * 100) AS BIGINT) % 100 AS rest FROM part""",
    point_agreement="""
        WITH p AS (SELECT user_id, v AS place, sym FROM e)
        SELECT a.user_id, COUNT(*) AS same FROM p a JOIN p b ON b.user_id = a.user_id AND b.place = a.place + 100 AND a.sym = b.sym GROUP BY a.user_id""",
    contested_positions="""
        SELECT l_partkey, l_suppkey, COUNT(DISTINCT l_quantity) AS readings FROM lineitem GROUP BY l_partkey, l_suppkey HAVING COUNT(DISTINCT l_quantity) > 1""",
    group_tests="""
        WITH links AS (SELECT l_suppkey % 16 AS k, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS cost FROM lineitem GROUP BY l_suppkey % 16), asks AS (SELECT k AS r FROM bits),
             s AS (SELECT a.r, SUM(CASE WHEN BIT_COUNT((a.r + 1) & (l.k + 1)) % 2 = 1 THEN l.cost ELSE 0 END) AS inside, SUM(l.cost) AS total FROM asks a CROSS JOIN links l GROUP BY a.r)
        SELECT r, CAST(inside AS BIGINT) AS inside, CAST(4 * inside - 2 * total AS BIGINT) AS contrast FROM s""",
    bell_state="""
        WITH start_state AS (SELECT l_orderkey % 4 AS idx, COUNT(*) AS re FROM lineitem GROUP BY l_orderkey % 4),
             had AS (SELECT a.idx, CASE WHEN a.idx % 2 = 0 THEN a.re + b.re ELSE b.re - a.re END AS re FROM start_state a JOIN start_state b ON b.idx = XOR(a.idx, 1)),
             cnot AS (SELECT CASE WHEN idx % 2 = 1 THEN XOR(idx, 2) ELSE idx END AS idx, re FROM had)
        SELECT idx, CAST(re AS BIGINT) AS amplitude, CAST(1 AS BIGINT) AS half_powers FROM cnot""",
    key_words="""
        SELECT conv_id, COUNT(*) AS turns, CAST(SUM(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS asked, CAST(SUM(LENGTH(text)) AS BIGINT) AS characters FROM conversations GROUP BY conv_id""",
    family_of_note="""
        SELECT SPLIT_PART(p_type, ' ', 1) AS family, COUNT(*) AS n FROM part GROUP BY SPLIT_PART(p_type, ' ', 1)""",
)
