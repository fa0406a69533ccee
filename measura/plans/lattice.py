"""Lattices, stencils, lifting, coding costs, frames and their relations (survey 2.8, 2.9, 2.11, 2.12).

The lattice is a 16 x 16 grid for each ship year; the frames are the cells that a day's events occupy; the cloud is
the embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measura.operators import frames, graph
from measura.plans import bodies
from measura.plans.shared import family
from measura.sources import views
from measura.sources.tables import table

FULL = """axis AS (SELECT k FROM bits), years AS (SELECT DISTINCT t FROM g),
             full_grid AS (SELECT years.t, a.k AS y, b.k AS x, COALESCE(g.lane, 0) AS lane FROM years CROSS JOIN axis a CROSS JOIN axis b LEFT JOIN g ON g.t = years.t AND g.y = a.k AND g.x = b.k)"""
LOWS = FULL + """,
             near AS (SELECT t, y, x, lane, COALESCE(LAG(lane) OVER (PARTITION BY t, y ORDER BY x), LEAD(lane) OVER (PARTITION BY t, y ORDER BY x)) AS below, COALESCE(LEAD(lane) OVER (PARTITION BY t, y ORDER BY x), LAG(lane) OVER (PARTITION BY t, y ORDER BY x)) AS above FROM full_grid),
             highs AS (SELECT t, y, x, lane - CAST(FLOOR((below + above) / 2.0E0) AS BIGINT) AS high FROM near WHERE x % 2 = 1),
             lows AS (SELECT n.t, n.y, n.x, n.lane + CAST(FLOOR((COALESCE(h1.high, h2.high) + h2.high + 2) / 4.0E0) AS BIGINT) AS low
                      FROM near n LEFT JOIN highs h1 ON h1.t = n.t AND h1.y = n.y AND h1.x = n.x - 1 JOIN highs h2 ON h2.t = n.t AND h2.y = n.y AND h2.x = n.x + 1 WHERE n.x % 2 = 0)"""
ZIGZAG = FULL + """,
             steps AS (SELECT t, y, x, lane - COALESCE(LAG(lane) OVER (PARTITION BY t ORDER BY y, x), 0) AS d, DIV(y * 16 + x, 64) AS block FROM full_grid),
             zig AS (SELECT t, block, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS z FROM steps)"""

#: The kinds that the reading of cells tells apart (0 to 6), each a source.
SOURCES = 7
#: Source after source takes a free target or none; walks with the same targets taken are one row with their number and weight.
ARRANGED = f"""opts AS (SELECT a.day, a.z AS source, b.y AS target, COUNT(*) AS weight FROM c a JOIN c b ON b.day = a.day AND b.z = a.z GROUP BY a.day, a.z, b.y),
             days AS (SELECT DISTINCT day FROM opts),
             choices AS (SELECT day, source, CAST(POWER(2, target) AS BIGINT) AS bit, CAST(weight AS BIGINT) AS weight FROM opts
                         UNION ALL SELECT days.day, k.k, CAST(0 AS BIGINT), CAST(1 AS BIGINT) FROM days CROSS JOIN bits k WHERE k.k < {SOURCES}),
             walk0 AS (SELECT day, CAST(0 AS BIGINT) AS mask, CAST(1 AS BIGINT) AS n, CAST(1 AS BIGINT) AS weight FROM days)""" + "".join(
    f""",
             walk{k + 1} AS (SELECT w.day, w.mask + o.bit AS mask, CAST(SUM(w.n) AS BIGINT) AS n, CAST(SUM(w.weight * o.weight) AS BIGINT) AS weight
                       FROM walk{k} w JOIN choices o ON o.day = w.day AND o.source = {k} AND (w.mask & o.bit) = 0 GROUP BY w.day, w.mask + o.bit)"""
    for k in range(SOURCES)
)


def components_of_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected cells of each day's frame, by the smallest cell they reach."""
    cells = views.occupied(spark, sf_dir).withColumn("cell", F.expr("day * 1024 + z * 32 + y"))
    return frames.components_of_cells(cells, "cell", ["day"], ["z", "y"])


def customer_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items tie a part to a supplier: which parts hang together through suppliers."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b"))
    return graph.components(rows)


def core_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b"))
    return graph.k_core(rows, 4)


def heaviest_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's occupied cells matched with the next day's by total agreement."""
    overlap = views.occupied(spark, sf_dir)
    pairs = overlap.alias("a").join(overlap.alias("b"), (F.col("b.day") == F.col("a.day") + 1) & (F.abs(F.col("a.y") - F.col("b.y")) <= 1) & (F.col("a.z") == F.col("b.z")))
    weighted = pairs.select(F.col("a.day").alias("day"), F.expr("a.z * 16 + a.y").alias("a"), F.expr("b.z * 16 + b.y").alias("b"), (3 - F.abs(F.col("a.y") - F.col("b.y"))).alias("weight"))
    return frames.heaviest_matching(weighted, ["day"]).groupBy("day").agg(F.sum("weight").alias("total"), F.count("*").alias("pairs"))


TIED = "edges AS MATERIALIZED (SELECT DISTINCT l_partkey * 2 AS a, l_suppkey * 2 + 1 AS b FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL), ends AS MATERIALIZED (SELECT a AS u, b AS v FROM edges UNION ALL SELECT b, a FROM edges)"
#: Rounds in which the SQL forms spread labels or peel nodes; both have settled long before on these tables.
ROUNDS = 16
SPREAD = ", ".join(f"l{k} AS MATERIALIZED (SELECT e.u, least(MIN(l.label), any_value(o.label)) AS label FROM ends e JOIN l{k - 1} l ON l.u = e.v JOIN l{k - 1} o ON o.u = e.u GROUP BY e.u)" for k in range(1, ROUNDS + 1))
PEELED = ", ".join(f"k{k} AS MATERIALIZED (SELECT e.u FROM ends e JOIN k{k - 1} a ON a.u = e.u JOIN k{k - 1} b ON b.u = e.v GROUP BY e.u HAVING COUNT(*) >= 4)" for k in range(1, ROUNDS + 1))

REGISTRY = {
    "components": (components_of_frames, bodies.COMPONENTS),
    "k_core": (core_of_parts, f"WITH {TIED}, k0 AS (SELECT DISTINCT u FROM ends), {PEELED} SELECT e.u AS node, COUNT(*) AS degree FROM ends e JOIN k{ROUNDS} a ON a.u = e.u JOIN k{ROUNDS} b ON b.u = e.v GROUP BY e.u"),
    "part_components": (customer_components, f"WITH {TIED}, l0 AS (SELECT DISTINCT u, u AS label FROM ends), {SPREAD} SELECT u AS node, label AS root FROM l{ROUNDS}"),
    "heaviest_matching": (heaviest_matching, None),
} | family(
    grid_survey="SELECT t, COUNT(*) AS cells, CAST(SUM(lane) AS BIGINT) AS total, MIN(lane) AS lo, MAX(lane) AS hi FROM g GROUP BY t",
    binomial_residual="WITH " + FULL + """,
             h AS (SELECT t, y, x, lane, COALESCE(LAG(lane) OVER (PARTITION BY t, y ORDER BY x), 0) + 2 * lane + COALESCE(LEAD(lane) OVER (PARTITION BY t, y ORDER BY x), 0) AS row_sum FROM full_grid),
             v AS (SELECT t, y, x, lane, COALESCE(LAG(row_sum) OVER (PARTITION BY t, x ORDER BY y), 0) + 2 * row_sum + COALESCE(LEAD(row_sum) OVER (PARTITION BY t, x ORDER BY y), 0) AS smooth FROM h)
        SELECT t, y, x, 16 * lane - smooth AS residual FROM v""",
    unit_sweep_agrees="WITH " + FULL + """,
             one AS (SELECT t, y, x, lane + COALESCE(LAG(lane) OVER (PARTITION BY t, y ORDER BY x), 0) AS v FROM full_grid),
             two AS (SELECT t, y, x, v + COALESCE(LEAD(v) OVER (PARTITION BY t, y ORDER BY x), 0) AS v FROM one),
             direct AS (SELECT t, y, x, COALESCE(LAG(lane) OVER (PARTITION BY t, y ORDER BY x), 0) + 2 * lane + COALESCE(LEAD(lane) OVER (PARTITION BY t, y ORDER BY x), 0) AS v FROM full_grid)
        SELECT a.t, COUNT(*) AS cells, CAST(SUM(CASE WHEN a.v <> b.v AND a.x < 15 THEN 1 ELSE 0 END) AS BIGINT) AS differ FROM two a JOIN direct b ON a.t = b.t AND a.y = b.y AND a.x = b.x GROUP BY a.t""",
    lift_53="WITH " + LOWS + """
        SELECT t, y, x, low AS value FROM lows UNION ALL SELECT t, y, x, high AS value FROM highs""",
    lower_53_identity="WITH " + LOWS + """,
             evens AS (SELECT l.t, l.y, l.x, l.low - CAST(FLOOR((COALESCE(h1.high, h2.high) + h2.high + 2) / 4.0E0) AS BIGINT) AS lane
                       FROM lows l LEFT JOIN highs h1 ON h1.t = l.t AND h1.y = l.y AND h1.x = l.x - 1 JOIN highs h2 ON h2.t = l.t AND h2.y = l.y AND h2.x = l.x + 1),
             odds AS (SELECT h.t, h.y, h.x, h.high + CAST(FLOOR((a.lane + COALESCE(b.lane, a.lane)) / 2.0E0) AS BIGINT) AS lane
                      FROM highs h JOIN evens a ON a.t = h.t AND a.y = h.y AND a.x = h.x - 1 LEFT JOIN evens b ON b.t = h.t AND b.y = h.y AND b.x = h.x + 1),
             back AS (SELECT t, y, x, lane FROM evens UNION ALL SELECT t, y, x, lane FROM odds)
        SELECT f.t, COUNT(*) AS cells, CAST(SUM(CASE WHEN f.lane <> b.lane THEN 1 ELSE 0 END) AS BIGINT) AS differ FROM full_grid f JOIN back b ON b.t = f.t AND b.y = f.y AND b.x = f.x GROUP BY f.t""",
    rice_cost="WITH " + ZIGZAG + """,
             cost AS (SELECT t, block, b.k, CAST(SUM(CASE WHEN DIV(z, CAST(POWER(2, b.k) AS BIGINT)) < 24 THEN DIV(z, CAST(POWER(2, b.k) AS BIGINT)) + 1 + b.k ELSE 56 END) AS BIGINT) AS bits FROM zig CROSS JOIN bits b GROUP BY t, block, b.k)
        SELECT t, block, k, bits FROM (SELECT t, block, k, bits, ROW_NUMBER() OVER (PARTITION BY t, block ORDER BY bits, k) AS place FROM cost) x WHERE place = 1""",
    entropy_history="""
        WITH f AS (SELECT part, pos, v, LAG(v) OVER (PARTITION BY part ORDER BY pos) AS prev FROM q),
             m AS (SELECT part, DIV(pos, 11) AS win, XOR(v, prev) AS flips FROM f WHERE prev IS NOT NULL)
        SELECT m.part, m.win, b.k AS bit, CAST(SUM(DIV(m.flips, CAST(POWER(2, b.k) AS BIGINT)) % 2) AS BIGINT) AS flips FROM m CROSS JOIN bits b WHERE b.k < 6 GROUP BY m.part, m.win, b.k""",
    entropy_cloud="""
        WITH f AS (SELECT part, pos, v, LAG(v) OVER (PARTITION BY part ORDER BY pos) AS prev FROM q),
             m AS (SELECT part, DIV(pos, 11) AS win, XOR(v, prev) AS flips FROM f WHERE prev IS NOT NULL),
             h AS (SELECT m.part, m.win, b.k AS bit, SUM(DIV(m.flips, CAST(POWER(2, b.k) AS BIGINT)) % 2) AS n FROM m CROSS JOIN bits b WHERE b.k < 6 GROUP BY m.part, m.win, b.k)
        SELECT a.win AS w1, b.win AS w2, CAST(SUM(a.n * b.n) AS BIGINT) AS product FROM h a JOIN h b ON a.part = b.part AND a.bit = b.bit AND a.win <= b.win GROUP BY a.win, b.win""",
    parity_conserved="""
        WITH f AS (SELECT part, pos, v, LAG(v) OVER (PARTITION BY part ORDER BY pos) AS prev, FIRST_VALUE(v) OVER (PARTITION BY part ORDER BY pos) AS first_v,
                          LAST_VALUE(v) OVER (PARTITION BY part ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_v FROM q),
             m AS (SELECT part, XOR(v, prev) % 2 AS flip, XOR(first_v, last_v) % 2 AS ends FROM f WHERE prev IS NOT NULL)
        SELECT part, CAST(SUM(flip) % 2 AS BIGINT) AS parity, MAX(ends) AS ends FROM m GROUP BY part""",
    body_census="""
        SELECT day, COUNT(*) AS mass, CAST(SUM(z) AS BIGINT) AS sz, CAST(SUM(y) AS BIGINT) AS sy, CAST(SUM(z * z) AS BIGINT) AS mzz, CAST(SUM(z * y) AS BIGINT) AS mzy, CAST(SUM(y * y) AS BIGINT) AS myy FROM c GROUP BY day""",
    face_mask="""
        SELECT day, CAST(BIT_OR(CASE WHEN z = 0 THEN 1 ELSE 0 END + CASE WHEN z = 5 THEN 2 ELSE 0 END + CASE WHEN y = 0 THEN 4 ELSE 0 END + CASE WHEN y = 15 THEN 8 ELSE 0 END) AS BIGINT) AS faces FROM c GROUP BY day""",
    frame_overlap="""
        SELECT a.day, a.z, COUNT(*) AS voxels FROM c a JOIN c b ON b.day = a.day + 1 AND b.z = a.z AND b.y = a.y GROUP BY a.day, a.z""",
    best_shift="""
        WITH n AS (SELECT a.day, b.z - a.z AS dz, b.y - a.y AS dy, COUNT(*) AS agreement FROM c a JOIN c b ON b.day = a.day + 1 GROUP BY a.day, b.z - a.z, b.y - a.y)
        SELECT day, dz, dy, agreement FROM (SELECT day, dz, dy, agreement, ROW_NUMBER() OVER (PARTITION BY day ORDER BY agreement DESC, dz * dz + dy * dy, (dz + 16) % 16, (dy + 32) % 32) AS place FROM n) x WHERE place = 1""",
    landing_scores="""
        WITH l AS (SELECT a.k - 1 AS dz, b.k - 1 AS dy FROM bits a CROSS JOIN bits b WHERE a.k < 3 AND b.k < 3)
        SELECT a.day, l.dz, l.dy, COUNT(*) AS score FROM c a CROSS JOIN l JOIN c b ON b.day = a.day + 1 AND b.z = a.z + l.dz AND b.y = a.y + l.dy GROUP BY a.day, l.dz, l.dy""",
    box_sums="""
        WITH box AS (SELECT day, z, MIN(y) AS y0, MAX(y) AS y1 FROM c GROUP BY day, z)
        SELECT b.day, b.z, COUNT(*) AS cells, CAST(SUM(c.y) AS BIGINT) AS total FROM box b JOIN c ON c.day = b.day AND c.z BETWEEN b.z - 1 AND b.z + 1 AND c.y BETWEEN b.y0 AND b.y1 GROUP BY b.day, b.z""",
    extents="SELECT day, MIN(z) AS z0, MAX(z) AS z1, MIN(y) AS y0, MAX(y) AS y1 FROM c GROUP BY day",
    axis_agreement="WITH " + FULL + """
        SELECT a.t, l.k AS lag, COUNT(*) AS pairs, CAST(SUM(CASE WHEN DIV(a.lane, 64) = DIV(b.lane, 64) THEN 1 ELSE 0 END) AS BIGINT) AS same
        FROM full_grid a CROSS JOIN lags l JOIN full_grid b ON b.t = a.t AND b.y = a.y AND b.x = a.x + l.k GROUP BY a.t, l.k""",
    period_peaks="WITH " + FULL + """,
             m AS (SELECT a.t, l.k AS lag, SUM(CASE WHEN DIV(a.lane, 64) = DIV(b.lane, 64) THEN 1 ELSE 0 END) AS same
                   FROM full_grid a CROSS JOIN lags l JOIN full_grid b ON b.t = a.t AND b.y = a.y AND b.x = a.x + l.k WHERE a.x < 8 GROUP BY a.t, l.k),
             r AS (SELECT t, lag, same - GREATEST(LAG(same) OVER (PARTITION BY t ORDER BY lag), LEAD(same) OVER (PARTITION BY t ORDER BY lag)) AS rise FROM m)
        SELECT p.t, p.lag AS period, CAST(LEAST(p.rise, d.rise) AS BIGINT) AS height FROM r p JOIN r d ON d.t = p.t AND d.lag = 2 * p.lag WHERE p.lag >= 2 AND 2 * p.lag + 1 <= 8 AND p.rise > 0 AND d.rise > 0""",
    track_scores="""
        WITH truth AS (SELECT a.day, a.z, a.y, b.y AS to_y FROM c a JOIN c b ON b.day = a.day + 1 AND b.z = a.z AND b.y = a.y),
             near AS (SELECT a.day, a.z, a.y, b.y AS to_y, ROW_NUMBER() OVER (PARTITION BY a.day, a.z, a.y ORDER BY ABS(b.y - a.y - 1), b.y) AS place FROM c a JOIN c b ON b.day = a.day + 1 AND b.z = a.z AND ABS(b.y - a.y) <= 2),
             found AS (SELECT day, z, y, to_y FROM near WHERE place = 1),
             m AS (SELECT COALESCE(t.day, f.day) AS day, CASE WHEN t.day IS NOT NULL AND f.day IS NOT NULL THEN 1 ELSE 0 END AS tp, CASE WHEN t.day IS NULL THEN 1 ELSE 0 END AS fp, CASE WHEN f.day IS NULL THEN 1 ELSE 0 END AS fn
                   FROM truth t FULL JOIN found f ON t.day = f.day AND t.z = f.z AND t.y = f.y AND t.to_y = f.to_y)
        SELECT day, CAST(SUM(tp) AS BIGINT) AS tp, CAST(SUM(fp) AS BIGINT) AS fp, CAST(SUM(fn) AS BIGINT) AS fn FROM m GROUP BY day""",
    symmetry_sites="""
        WITH ops AS (SELECT 0 AS op, 1 AS a, 0 AS b, 0 AS c, 1 AS d UNION ALL SELECT 1, 0, -1, 1, 0 UNION ALL SELECT 2, -1, 0, 0, -1 UNION ALL SELECT 3, 0, 1, -1, 0), cells AS (SELECT DISTINCT y, x FROM g)
        SELECT o.op, s.y, s.x, (o.a * s.x + o.b * s.y + 16) % 16 AS sx, (o.c * s.x + o.d * s.y + 16) % 16 AS sy FROM cells s CROSS JOIN ops o""",
    frame_chains="""
        WITH runs AS (SELECT day, z, y, day - ROW_NUMBER() OVER (PARTITION BY z, y ORDER BY day) AS island FROM c),
             chains AS (SELECT z, y, COUNT(*) AS len FROM runs GROUP BY z, y, island)
        SELECT z, y, MAX(len) AS len FROM chains GROUP BY z, y""",
    noise_flicker="WITH " + FULL + """
        SELECT a.t, CAST(SUM((b.lane - a.lane) * (b.lane - a.lane)) AS BIGINT) AS squares, COUNT(*) AS n FROM full_grid a JOIN full_grid b ON b.t = a.t + 1 AND b.y = a.y AND b.x = a.x GROUP BY a.t""",
    noise_neighbors="WITH " + FULL + """
        SELECT a.t, CAST(SUM(ABS(a.lane - b.lane)) AS BIGINT) AS total, COUNT(*) AS n FROM full_grid a JOIN full_grid b ON b.t = a.t AND ((b.y = a.y AND b.x = a.x + 1) OR (b.x = a.x AND b.y = a.y + 1)) GROUP BY a.t""",
    noise_clips="""
        WITH m AS (SELECT t, MIN(lane) AS lo, MAX(lane) AS hi FROM g GROUP BY t)
        SELECT g.t, CAST(SUM(CASE WHEN g.lane = m.lo THEN 1 ELSE 0 END) AS BIGINT) AS at_floor, CAST(SUM(CASE WHEN g.lane = m.hi THEN 1 ELSE 0 END) AS BIGINT) AS at_ceiling FROM g JOIN m ON g.t = m.t GROUP BY g.t""",
    line_fit="""
        SELECT part, COUNT(*) AS n, CAST(COUNT(*) * SUM(pos * v) - SUM(pos) * SUM(v) AS BIGINT) AS slope_num, CAST(COUNT(*) * SUM(pos * pos) - SUM(pos) * SUM(pos) AS BIGINT) AS slope_den FROM q GROUP BY part""",
    plane_sums="WITH " + FULL + " SELECT t, y, CAST(SUM(lane) AS BIGINT) AS total FROM full_grid GROUP BY t, y UNION ALL SELECT t, 100 + x, CAST(SUM(lane) AS BIGINT) FROM full_grid GROUP BY t, x",
    fibonacci_bands="""
        WITH ladder AS (SELECT CAST(ROUND(POWER((1 + SQRT(5.0E0)) / 2, k + 1) / SQRT(5.0E0)) AS BIGINT) AS rung FROM rungs)
        SELECT g.t, g.y, g.x, COUNT(l.rung) AS band FROM g LEFT JOIN ladder l ON l.rung <= g.lane GROUP BY g.t, g.y, g.x""",
    marginal_sums="WITH " + ARRANGED + f"""
        SELECT day, CAST(SUM(n) AS BIGINT) AS arrangements, CAST(SUM(weight) AS BIGINT) AS total FROM walk{SOURCES} GROUP BY day""",
    edge_jaccard="""
        WITH a AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'R'),
             m AS (SELECT COALESCE(a.p, b.p) AS p, CASE WHEN a.p IS NOT NULL AND b.p IS NOT NULL THEN 1 ELSE 0 END AS tp, CASE WHEN b.p IS NULL THEN 1 ELSE 0 END AS fn, CASE WHEN a.p IS NULL THEN 1 ELSE 0 END AS fp FROM a FULL JOIN b ON a.p = b.p AND a.s = b.s)
        SELECT p % 16 AS bucket, CAST(SUM(tp) AS BIGINT) AS tp, CAST(SUM(fp) AS BIGINT) AS fp, CAST(SUM(fn) AS BIGINT) AS fn FROM m GROUP BY p % 16""",
    degree_realizable="""
        WITH d AS (SELECT l_suppkey % 32 AS grp, l_partkey AS node, COUNT(*) AS degree FROM lineitem GROUP BY l_suppkey % 32, l_partkey)
        SELECT grp, CASE WHEN SUM(degree) % 2 = 1 THEN 'odd' WHEN 2 * MAX(degree) > SUM(degree) THEN 'one too large' WHEN SUM(degree) < 2 * (COUNT(*) - 1) THEN 'too few' ELSE 'yes' END AS verdict FROM d GROUP BY grp""",
)
