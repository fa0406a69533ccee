"""Lattices lifted, coded, sealed, stored and proved; periods beside their null (survey 2.1, 2.6, 2.9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measura.functions import coding
from measura.operators import crystal, period, shared_pattern
from measura.plans import planned, trees
from measura.session import materialize
from measura.sources import views

EXTENTS, BLOCKS, LEVELS = (planned.MONTHS, planned.HEIGHT, planned.WIDTH), (16, 16, 16), 2
LAGS, DRAWS, CLASS = 8, 19, 64


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, t, y, x, lane): every place of every year, 0 where nothing was shipped."""
    found = planned.cells(spark, sf_dir).select(F.col("year").cast("long").alias("sample"), *(F.col(c).cast("long").alias(c) for c in ("t", "y", "x", "lane")))
    t, y, x = EXTENTS
    places = spark.range(t * y * x).select(F.expr(f"id div {y * x}").alias("t"), F.expr(f"id div {x} % {y}").alias("y"), (F.col("id") % x).alias("x"))
    whole = found.select("sample").distinct().crossJoin(F.broadcast(places))
    return whole.join(found, ["sample", "t", "y", "x"], "left").select("sample", "t", "y", "x", F.coalesce("lane", F.lit(0)).alias("lane"))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(crystal.encode(cells(spark, sf_dir), EXTENTS, BLOCKS, LEVELS), "crystal")


def crystal_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, lanes and coded bits of every year."""
    return stored(spark, sf_dir).groupBy("sample").agg(F.count("*").alias("blocks"), F.sum("lanes").alias("lanes"), F.sum("bits").alias("bits"))


def crystal_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crystal.decode(stored(spark, sf_dir), EXTENTS, BLOCKS, LEVELS).select("sample", "t", "y", "x", "lane")


def crystal_prove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every year proved from its stored codes: nothing else is read again."""
    kept = stored(spark, sf_dir)
    return crystal.prove(kept, crystal.roots(kept.select("sample", "bt", "by", "bx", "digest")), EXTENTS, BLOCKS, LEVELS)


def period_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest period of each year's lattice on each axis, beside the highest of 19 shuffles of its lines."""
    classed = trees.full(spark, sf_dir).withColumn("v", F.expr(f"lane div {CLASS}"))
    return period.periods(classed, "t", ["y", "x"], "v", LAGS, trees.SIDE, DRAWS).withColumnRenamed("frame", "t")


def root_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern that saves most bits in each box of every year's lattice."""
    return shared_pattern.roots(cells(spark, sf_dir), EXTENTS, BLOCKS, LEVELS).select("sample", "bt", "by", "bx", "root", "box_bits", "saved")


def root_boxes_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialize(shared_pattern.roots(cells(spark, sf_dir), EXTENTS, BLOCKS, LEVELS), "root-boxes")
    return shared_pattern.returned(found, EXTENTS, BLOCKS)


def noise_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_pattern.ladder(cells(spark, sf_dir), planned.MONTHS, LADDER)


LADDER = 4
WHOLE = f"whole AS (SELECT year AS sample, t, y, x, lane FROM ({planned.GRID}))"


def lifted(start: str = "SELECT sample, t, y, x, lane AS v FROM whole", keys: tuple[str, ...] = ("sample",)) -> str:
    """SQL of the lifting steps: windows over the places of each level along each axis, from the last to the first."""
    out = [f"v00 AS MATERIALIZED ({start})"]
    last, n, held = "v00", 0, ", ".join(keys)
    for level in range(LEVELS):
        s = 1 << level
        live = " AND ".join(f"{a} % {s} = 0" for a in "tyx")
        for axis in "xyt":
            others = ", ".join([*keys, *(b for b in "tyx" if b != axis)])
            n += 1
            beside = f"SELECT *, LAG(v) OVER w AS p, LEAD(v) OVER w AS q FROM {{}} WHERE {live} WINDOW w AS (PARTITION BY {others} ORDER BY {axis})"
            odd = f"{axis} // {s} % 2 = 1"
            out.append(f"h{n} AS (SELECT {held}, t, y, x, CASE WHEN {odd} THEN v - CAST(FLOOR((coalesce(p, q) + coalesce(q, p)) / 2.0) AS BIGINT) ELSE v END AS v FROM ({beside.format(last)}))")
            out.append(f"l{n} AS (SELECT {held}, t, y, x, CASE WHEN {odd} OR coalesce(p, q) IS NULL THEN v ELSE v + CAST(FLOOR((coalesce(p, q) + coalesce(q, p) + 2) / 4.0) AS BIGINT) END AS v FROM ({beside.format(f'h{n}')}))")
            out.append(f"v{n} AS MATERIALIZED (SELECT * FROM l{n} UNION ALL SELECT * FROM {last} WHERE NOT ({live}))")
            last = f"v{n}"
    return ", ".join(out) + f", coefficients AS (SELECT * FROM {last})"


(T, Y, X), (BT, BY, BX) = EXTENTS, BLOCKS
BITS = f"""
    WITH {WHOLE}, {lifted()},
         z AS (SELECT sample, t // {BT} AS bt, y // {BY} AS by_, x // {BX} AS bx, ((t % {BT}) * least({BY}, {Y} - y // {BY} * {BY}) + y % {BY}) * least({BX}, {X} - x // {BX} * {BX}) + x % {BX} AS i, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS z FROM coefficients),
         c AS (SELECT sample, bt, by_, bx, i // {coding.BLOCK} AS code, k.range AS k, SUM(CASE WHEN (z >> k.range) < {coding.ESCAPE} THEN (z >> k.range) + 1 + k.range ELSE {coding.ESCAPE + coding.RAW} END) AS bits FROM z CROSS JOIN range({coding.WIDEST + 1}) k GROUP BY ALL),
         b AS (SELECT sample, bt, by_, bx, code, MIN(bits) + {coding.HEAD} AS bits FROM c GROUP BY ALL)
    SELECT sample, CAST({-(-T // BT) * -(-Y // BY) * -(-X // BX)} AS BIGINT) AS blocks, CAST({T * Y * X} AS BIGINT) AS lanes, CAST(SUM(bits) AS BIGINT) AS bits FROM b GROUP BY sample"""

#: Each box, its residual under every term (kind 1) and every term's pattern (kind 2), with places counted inside the box.
BOXES = f"boxed AS MATERIALIZED (SELECT sample, t // {BT} AS bt, y // {BY} AS by_, x // {BX} AS bx, t % {BT} AS t, y % {BY} AS y, x % {BX} AS x, lane FROM whole)"
SHARED = " UNION ALL ".join(
    f"SELECT sample, bt, by_, bx, {term} AS term, {', '.join(a if i in kept else f'0 AS {a}' for i, a in enumerate('tyx'))}, SUM(lane) // COUNT(*) AS v FROM boxed GROUP BY sample, bt, by_, bx{''.join(', ' + a for i, a in enumerate('tyx') if i in kept)}" for term, kept in enumerate(shared_pattern.TERMS)
)
KEEPS = " OR ".join(f"(p.term = {term}{''.join(f' AND p.{a} = b.{a}' for i, a in enumerate('tyx') if i in kept)})" for term, kept in enumerate(shared_pattern.TERMS))
PRICED = f"""SELECT sample, bt, by_, bx, 0 AS kind, -1 AS term, t, y, x, CAST(lane AS BIGINT) AS v FROM boxed
         UNION ALL SELECT b.sample, b.bt, b.by_, b.bx, 1, p.term, b.t, b.y, b.x, CAST(b.lane - p.v AS BIGINT) FROM boxed b JOIN shared p ON p.sample = b.sample AND p.bt = b.bt AND p.by_ = b.by_ AND p.bx = b.bx AND ({KEEPS})
         UNION ALL SELECT sample, bt, by_, bx, 2, term, t, y, x, CAST(v AS BIGINT) FROM shared"""
BOX = ("sample", "bt", "by_", "bx", "kind", "term")
ROOT_SQL = f"""
    WITH {WHOLE}, {BOXES}, shared AS MATERIALIZED ({SHARED}), {lifted(PRICED, BOX)},
         z AS (SELECT {", ".join(BOX)}, row_number() OVER (PARTITION BY {", ".join(BOX)} ORDER BY t, y, x) - 1 AS i, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS z FROM coefficients),
         c AS (SELECT {", ".join(BOX)}, i // {coding.BLOCK} AS code, k.range AS k, SUM(CASE WHEN (z >> k.range) < {coding.ESCAPE} THEN (z >> k.range) + 1 + k.range ELSE {coding.ESCAPE + coding.RAW} END) AS bits FROM z CROSS JOIN range({coding.WIDEST + 1}) k GROUP BY ALL),
         d AS (SELECT {", ".join(BOX)}, code, MIN(bits) + {coding.HEAD} AS bits FROM c GROUP BY ALL),
         p AS MATERIALIZED (SELECT {", ".join(BOX)}, CAST(SUM(bits) AS BIGINT) AS bits FROM d GROUP BY {", ".join(BOX)}),
         e AS (SELECT w.sample, w.bt, w.by_, w.bx, w.bits AS box_bits, r.term, w.bits - r.bits - q.bits AS saved FROM p w JOIN p r ON r.sample = w.sample AND r.bt = w.bt AND r.by_ = w.by_ AND r.bx = w.bx AND r.kind = 1
               JOIN p q ON q.sample = w.sample AND q.bt = w.bt AND q.by_ = w.by_ AND q.bx = w.bx AND q.kind = 2 AND q.term = r.term WHERE w.kind = 0),
         f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY sample, bt, by_, bx ORDER BY saved DESC, term) = 1)
    SELECT sample, CAST(bt AS INTEGER) AS bt, CAST(by_ AS INTEGER) AS by, CAST(bx AS INTEGER) AS bx, CAST(CASE WHEN saved > 0 THEN term ELSE -1 END AS BIGINT) AS root, box_bits, greatest(saved, 0) AS saved FROM f"""

N, PARTS = LADDER, planned.MONTHS // LADDER
LADDER_SQL = f"""
    WITH {WHOLE}, p AS (SELECT sample, y, x, t // {N} AS part, SUM(lane::HUGEINT) AS s1, SUM(lane::HUGEINT * lane) AS s2, SUM(lane::HUGEINT * lane * lane) AS s3, SUM(lane::HUGEINT * lane * lane * lane) AS s4 FROM whole WHERE t < {N * PARTS} GROUP BY ALL),
         k AS (SELECT sample, SUM(s1) OVER (PARTITION BY sample, y, x) - s1 AS v, {N} * s2 - s1 * s1 AS k2, 2 * s1 * s1 * s1 - {3 * N} * s1 * s2 + {N * N} * s3 AS k3,
                      {N * N * (N + 1)} * s4 - {4 * N * (N + 1)} * s1 * s3 - {3 * N * (N - 1)} * s2 * s2 + {12 * N} * s1 * s1 * s2 - 6 * s1 * s1 * s1 * s1 AS k4 FROM p),
         l AS (SELECT sample, COUNT(*) AS blocks, COUNT(*) * SUM(v * v) - SUM(v) * SUM(v) AS d, {", ".join(f"COUNT(*) * SUM(v * k{j}) - SUM(v) * SUM(k{j}) AS m{j}, SUM(k{j}) * SUM(v * v) - SUM(v) * SUM(v * k{j}) AS c{j}" for j in (2, 3, 4))} FROM k GROUP BY sample),
         r AS (SELECT *, m2::DOUBLE / d / {N * (N - 1)} * {(PARTS - 1) * N} AS s2, m3::DOUBLE / d / {N * (N - 1) * (N - 2)} * {(PARTS - 1) * N} AS s3, m4::DOUBLE / d / {N * (N - 1) * (N - 2) * (N - 3)} * {(PARTS - 1) * N} AS s4 FROM l)
    SELECT sample, blocks, d > 0 AND s3 >= s2 * s2 AS rising, d > 0 AND s2 * s4 >= s3 * s3 AS convex, CAST(d AS VARCHAR) AS denominator, {", ".join(f"CAST(m{j} AS VARCHAR) AS slope{j}, CAST(c{j} AS VARCHAR) AS intercept{j}" for j in (2, 3, 4))} FROM r"""

AXES = (("y", "x"), ("x", "y"))
PERIODS = f"""
    WITH g AS ({views.SQL["g"]}), years AS (SELECT DISTINCT t FROM g),
         whole AS (SELECT years.t, a.range AS y, b.range AS x, coalesce(g.lane, 0) // {CLASS} AS v FROM years CROSS JOIN range({trees.SIDE}) a CROSS JOIN range({trees.SIDE}) b LEFT JOIN g ON g.t = years.t AND g.y = a.range AND g.x = b.range),
         placed AS ({" UNION ALL ".join(f"SELECT t, '{a}' AS axis, {b} AS line, {a} AS place, v FROM whole" for a, b in AXES)}),
         drawn AS MATERIALIZED (SELECT 0 AS draw, * FROM placed UNION ALL
                   SELECT d.range, t, axis, line, row_number() OVER (PARTITION BY d.range, t, axis, line ORDER BY md5(concat_ws(':', d.range, t, axis, line, place)), place) - 1, v FROM placed CROSS JOIN range(1, {DRAWS + 1}) d),
         m AS MATERIALIZED (SELECT a.draw, a.t, a.axis, k.range AS lag, COUNT(*) FILTER (a.v = b.v) AS same FROM drawn a CROSS JOIN range(1, {LAGS + 1}) k JOIN drawn b ON b.draw = a.draw AND b.t = a.t AND b.axis = a.axis AND b.line = a.line AND b.place = a.place + k.range
               WHERE a.place < {trees.SIDE - LAGS} GROUP BY ALL),
         r AS (SELECT draw, t, axis, lag, same - greatest(lag(same) OVER w, lead(same) OVER w) AS rise FROM m WINDOW w AS (PARTITION BY draw, t, axis ORDER BY lag)),
         p AS (SELECT p.draw, p.t, p.axis, p.lag AS period, least(p.rise, d.rise) AS height FROM r p JOIN r d ON d.draw = p.draw AND d.t = p.t AND d.axis = p.axis AND d.lag = 2 * p.lag WHERE p.lag >= 2 AND 2 * p.lag + 1 <= {LAGS} AND p.rise > 0 AND d.rise > 0),
         best AS (SELECT draw, t, axis, max(struct_pack(height := height, minus := -period)) AS b FROM p GROUP BY ALL),
         pairs AS (SELECT DISTINCT t, axis FROM placed)
    SELECT o.t, o.axis, CAST(-z.b.minus AS BIGINT) AS period, CAST(coalesce(z.b.height, 0) AS BIGINT) AS height, CAST(coalesce(n.band, 0) AS BIGINT) AS band, coalesce(z.b.height, 0) > coalesce(n.band, 0) AS beyond
    FROM pairs o LEFT JOIN best z ON z.draw = 0 AND z.t = o.t AND z.axis = o.axis LEFT JOIN (SELECT t, axis, MAX(b.height) AS band FROM best WHERE draw > 0 GROUP BY ALL) n ON n.t = o.t AND n.axis = o.axis"""

REGISTRY = {
    "crystal_bits": (crystal_bits, BITS),
    "crystal_round_trip": (crystal_round_trip, f"WITH {WHOLE} SELECT * FROM whole"),
    "crystal_prove": (crystal_prove, f"WITH {WHOLE} SELECT sample, COUNT(*) AS lanes, CAST(SUM(lane) AS BIGINT) AS total, true AS proved FROM whole GROUP BY sample"),
    "period_band": (period_band, PERIODS),
    "root_boxes": (root_boxes, ROOT_SQL),
    "root_boxes_return": (root_boxes_return, f"WITH {WHOLE} SELECT * FROM whole"),
    "noise_ladder": (noise_ladder, LADDER_SQL),
}
