"""Lag agreement, periods, phases, windows, gaps and their hash-order nulls over sequences (survey 2.3-2.6).

Sequences are each user's events (symbols and hundredths), each part's quantities, and the bytes of documents.  A null
reorders a sequence by md5('seed:place'), with the place as tie-break.
"""

from __future__ import annotations

from measura.plans.shared import family

#: Each user's events in the order of a hash of the place: same symbols, no structure.
SHUFFLED = """shuffled AS (
          SELECT a.user_id, a.pos, b.sym, b.v FROM e a JOIN (
            SELECT user_id, sym, v, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY MD5('7:' || CAST(pos AS STRING)), pos) - 1 AS pos FROM e) b
          ON a.user_id = b.user_id AND a.pos = b.pos)"""

ENERGY = """sums AS (SELECT part, k, pos % k AS phase, CAST(SUM(v) AS BIGINT) AS s, COUNT(*) AS c FROM q CROSS JOIN periods GROUP BY part, k, pos % k),
             lens AS (SELECT part, COUNT(*) AS n FROM q GROUP BY part),
             energy AS (SELECT x.part, x.k, ROUND(SUM(CAST(x.s AS DOUBLE) * x.s / x.c), 6) AS between_classes FROM sums x JOIN lens l ON x.part = l.part WHERE x.k * 2 <= l.n GROUP BY x.part, x.k)"""

REGISTRY = family(
    lag_agreement="""
        SELECT a.user_id, l.k AS lag, COUNT(*) AS pairs, CAST(SUM(CASE WHEN a.sym = b.sym THEN 1 ELSE 0 END) AS BIGINT) AS same
        FROM e a CROSS JOIN lags l JOIN e b ON b.user_id = a.user_id AND b.pos = a.pos + l.k GROUP BY a.user_id, l.k""",
    coincidence_floor="""
        WITH n AS (SELECT user_id, sym, COUNT(*) AS n FROM e GROUP BY user_id, sym)
        SELECT user_id, CAST(SUM(n * (n - 1)) AS BIGINT) AS numerator, CAST(SUM(n) * (SUM(n) - 1) AS BIGINT) AS denominator FROM n GROUP BY user_id""",
    top_lags="""
        WITH m AS (SELECT a.user_id, l.k AS lag, SUM(CASE WHEN a.sym = b.sym THEN 1 ELSE 0 END) AS same, COUNT(*) AS pairs
                   FROM e a CROSS JOIN lags l JOIN e b ON b.user_id = a.user_id AND b.pos = a.pos + l.k GROUP BY a.user_id, l.k)
        SELECT user_id, lag, place FROM (SELECT user_id, lag, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY CAST(same AS DOUBLE) / pairs DESC, lag DESC) AS BIGINT) AS place FROM m) x WHERE place <= 3""",
    null_lag_agreement="WITH " + SHUFFLED + """
        SELECT a.user_id, l.k AS lag, COUNT(*) AS pairs, CAST(SUM(CASE WHEN a.sym = b.sym THEN 1 ELSE 0 END) AS BIGINT) AS same
        FROM shuffled a CROSS JOIN lags l JOIN shuffled b ON b.user_id = a.user_id AND b.pos = a.pos + l.k GROUP BY a.user_id, l.k""",
    block_shuffled="""
        SELECT user_id, sym, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY MD5('7:' || CAST(DIV(pos, 4) AS STRING)), pos) - 1 AS BIGINT) AS pos FROM e""",
    scrambled_within="""
        SELECT user_id, sym, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY DIV(pos, 4), MD5('7:' || CAST(pos AS STRING)), pos) - 1 AS BIGINT) AS pos FROM e""",
    phase_totals="""
        SELECT part, pos % 5 AS phase, CAST(SUM(v) AS BIGINT) AS total, COUNT(*) AS n FROM q GROUP BY part, pos % 5""",
    phase_residual="""
        SELECT part, pos, v * COUNT(*) OVER (PARTITION BY part, pos % 5) - CAST(SUM(v) OVER (PARTITION BY part, pos % 5) AS BIGINT) AS numerator,
               COUNT(*) OVER (PARTITION BY part, pos % 5) AS denominator FROM q""",
    phase_majority="""
        WITH n AS (SELECT user_id, pos % 3 AS phase, sym, COUNT(*) AS n FROM e GROUP BY user_id, pos % 3, sym)
        SELECT user_id, phase, sym, n FROM (SELECT user_id, phase, sym, n, ROW_NUMBER() OVER (PARTITION BY user_id, phase ORDER BY n DESC, sym) AS place FROM n) x WHERE place = 1""",
    phase_median="""
        WITH r AS (SELECT part, pos % 5 AS phase, v, ROW_NUMBER() OVER (PARTITION BY part, pos % 5 ORDER BY v, pos) AS place, COUNT(*) OVER (PARTITION BY part, pos % 5) AS n FROM q)
        SELECT part, phase, v AS median FROM r WHERE place = DIV(n + 1, 2)""",
    phase_energy_ratio="WITH " + ENERGY + " SELECT part, k, between_classes FROM energy",
    best_period="WITH " + ENERGY + """
        SELECT part, k FROM (SELECT part, k, ROW_NUMBER() OVER (PARTITION BY part ORDER BY between_classes / k DESC, k) AS place FROM energy) x WHERE place = 1""",
    sequence_period="""
        WITH m AS (SELECT a.part, l.k, SUM(CASE WHEN a.v = b.v THEN 1 ELSE 0 END) AS same, COUNT(*) AS pairs FROM q a CROSS JOIN periods l JOIN q b ON b.part = a.part AND b.pos = a.pos + l.k GROUP BY a.part, l.k)
        SELECT part, k AS period, CAST(same AS BIGINT) AS same, pairs FROM (
          SELECT part, k, same, pairs, ROW_NUMBER() OVER (PARTITION BY part ORDER BY CAST(same AS DOUBLE) / pairs DESC, k DESC) AS place FROM m) x WHERE place = 1""",
    invariant_cells="""
        SELECT user_id, pos % 7 AS phase, MIN(sym) AS sym, COUNT(*) AS n FROM e GROUP BY user_id, pos % 7 HAVING MIN(sym) = MAX(sym)""",
    invariant_cells_29="""
        SELECT user_id, pos % 29 AS phase, MIN(sym) AS sym, COUNT(*) AS n FROM e GROUP BY user_id, pos % 29 HAVING MIN(sym) = MAX(sym)""",
    invariant_beyond_null_29="WITH " + SHUFFLED + """
        SELECT user_id, pos % 29 AS phase FROM e GROUP BY user_id, pos % 29 HAVING MIN(sym) = MAX(sym)
        EXCEPT SELECT user_id, pos % 29 AS phase FROM shuffled GROUP BY user_id, pos % 29 HAVING MIN(sym) = MAX(sym)""",
    invariant_beyond_null="WITH " + SHUFFLED + """
        SELECT user_id, pos % 7 AS phase FROM e GROUP BY user_id, pos % 7 HAVING MIN(sym) = MAX(sym)
        EXCEPT SELECT user_id, pos % 7 AS phase FROM shuffled GROUP BY user_id, pos % 7 HAVING MIN(sym) = MAX(sym)""",
    window_median=(
        """
        WITH x AS (SELECT user_id, pos, SORT_ARRAY(COLLECT_LIST(v) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS near FROM e)
        SELECT user_id, pos, near[DIV(SIZE(near) + 1, 2) - 1] AS median FROM x""",
        """
        WITH x AS (SELECT a.user_id, a.pos, b.v, ROW_NUMBER() OVER (PARTITION BY a.user_id, a.pos ORDER BY b.v, b.pos) AS place, COUNT(*) OVER (PARTITION BY a.user_id, a.pos) AS n
                   FROM e a JOIN e b ON a.user_id = b.user_id AND b.pos BETWEEN a.pos - 2 AND a.pos + 2)
        SELECT user_id, pos, v AS median FROM x WHERE place = DIV(n + 1, 2)""",
    ),
    local_outliers=(
        """
        WITH x AS (SELECT user_id, pos, v, COLLECT_LIST(STRUCT(v, pos)) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM e),
             y AS (SELECT user_id, pos, v, TRANSFORM(SORT_ARRAY(FILTER(near, z -> z.pos <> pos)), z -> z.v) AS near FROM x),
             m AS (SELECT user_id, pos, v, near, near[1] AS median FROM y WHERE SIZE(near) = 4),
             g AS (SELECT user_id, pos, ABS(v - median) AS own_gap, ARRAY_MAX(TRANSFORM(near, z -> ABS(z - median))) AS widest FROM m)
        SELECT user_id, pos, own_gap, widest FROM g WHERE own_gap > widest""",
        """
        WITH x AS (SELECT a.user_id, a.pos, a.v AS own, b.v, ROW_NUMBER() OVER (PARTITION BY a.user_id, a.pos ORDER BY b.v, b.pos) AS place, COUNT(*) OVER (PARTITION BY a.user_id, a.pos) AS n
                   FROM e a JOIN e b ON a.user_id = b.user_id AND b.pos BETWEEN a.pos - 2 AND a.pos + 2 AND b.pos <> a.pos),
             m AS (SELECT user_id, pos, v AS median FROM x WHERE place = DIV(n + 1, 2) AND n = 4)
        SELECT x.user_id, x.pos, MAX(ABS(x.own - m.median)) AS own_gap, MAX(ABS(x.v - m.median)) AS widest FROM x JOIN m ON x.user_id = m.user_id AND x.pos = m.pos
        GROUP BY x.user_id, x.pos HAVING MAX(ABS(x.own - m.median)) > MAX(ABS(x.v - m.median))""",
    ),
    context_mean="""
        WITH x AS (SELECT user_id, pos, v, LAG(sym) OVER (PARTITION BY user_id ORDER BY pos) AS before_sym, LEAD(sym) OVER (PARTITION BY user_id ORDER BY pos) AS after_sym FROM e)
        SELECT before_sym, after_sym, COUNT(*) AS n, CAST(SUM(v) AS BIGINT) AS total FROM x WHERE before_sym IS NOT NULL AND after_sym IS NOT NULL GROUP BY before_sym, after_sym""",
    gap_dispersion=(
        """
        SELECT doc_id, sym, COUNT(*) AS gaps, SUM(gap) AS total, SUM(gap * gap) AS squares FROM gaps GROUP BY doc_id, sym HAVING COUNT(*) >= 31""",
        """
        WITH x AS (SELECT doc_id, sym, pos - LAG(pos) OVER (PARTITION BY doc_id, sym ORDER BY pos) AS gap FROM s)
        SELECT doc_id, sym, COUNT(*) AS gaps, CAST(SUM(gap) AS BIGINT) AS total, CAST(SUM(gap * gap) AS BIGINT) AS squares FROM x WHERE gap IS NOT NULL GROUP BY doc_id, sym HAVING COUNT(*) >= 31""",
    ),
    null_gap_ratio="WITH " + SHUFFLED + """,
             a AS (SELECT user_id, sym, pos - LAG(pos) OVER (PARTITION BY user_id, sym ORDER BY pos) AS gap FROM e),
             b AS (SELECT user_id, sym, pos - LAG(pos) OVER (PARTITION BY user_id, sym ORDER BY pos) AS gap FROM shuffled),
             x AS (SELECT user_id, sym, COUNT(*) AS n, CAST(SUM(gap * gap) AS BIGINT) AS live FROM a WHERE gap IS NOT NULL GROUP BY user_id, sym),
             y AS (SELECT user_id, sym, CAST(SUM(gap * gap) AS BIGINT) AS shuffled_squares FROM b WHERE gap IS NOT NULL GROUP BY user_id, sym)
        SELECT x.user_id, x.sym, x.n, x.live, y.shuffled_squares FROM x JOIN y ON x.user_id = y.user_id AND x.sym = y.sym""",
    second_difference_noise="""
        WITH d AS (SELECT user_id, ABS(v - 2 * LAG(v) OVER (PARTITION BY user_id ORDER BY pos) + LAG(v, 2) OVER (PARTITION BY user_id ORDER BY pos)) AS d FROM e),
             r AS (SELECT user_id, d, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY d) AS place, COUNT(*) OVER (PARTITION BY user_id) AS n FROM d WHERE d IS NOT NULL)
        SELECT user_id, d AS median FROM r WHERE place = DIV(n + 1, 2)""",
    large_step_share="""
        WITH d AS (SELECT user_id, ABS(v - LAG(v) OVER (PARTITION BY user_id ORDER BY pos)) AS d FROM e),
             m AS (SELECT user_id, CAST(SUM(d) AS BIGINT) AS total, COUNT(d) AS n FROM d GROUP BY user_id)
        SELECT d.user_id, CAST(SUM(CASE WHEN d.d * m.n > 2 * m.total THEN 1 ELSE 0 END) AS BIGINT) AS large, MAX(m.n) AS steps FROM d JOIN m ON d.user_id = m.user_id WHERE d.d IS NOT NULL GROUP BY d.user_id""",
    symbol_runs="""
        WITH x AS (SELECT user_id, pos, sym, pos - ROW_NUMBER() OVER (PARTITION BY user_id, sym ORDER BY pos) AS island FROM e)
        SELECT user_id, sym, MIN(pos) AS first_pos, COUNT(*) AS len FROM x GROUP BY user_id, sym, island HAVING COUNT(*) >= 2""",
    roughness="""
        WITH d AS (SELECT part, 1 AS lag, ABS(v - LEAD(v, 1) OVER (PARTITION BY part ORDER BY pos)) AS d FROM q UNION ALL SELECT part, 2, ABS(v - LEAD(v, 2) OVER (PARTITION BY part ORDER BY pos)) FROM q
                   UNION ALL SELECT part, 4, ABS(v - LEAD(v, 4) OVER (PARTITION BY part ORDER BY pos)) FROM q)
        SELECT part, CAST(lag AS BIGINT) AS lag, CAST(SUM(d) AS BIGINT) AS total, COUNT(d) AS n FROM d WHERE d IS NOT NULL GROUP BY part, lag""",
    gray_bits="""
        SELECT x.part, x.pos, b.k AS bit, DIV(x.gray, CAST(POWER(2, b.k) AS BIGINT)) % 2 AS value FROM (SELECT part, pos, XOR(v, h) AS gray FROM (SELECT part, pos, v, DIV(v, 2) AS h FROM q) y) x CROSS JOIN bits b WHERE b.k < 6""",
    morton_order="""
        WITH z AS (SELECT l_partkey AS x, l_suppkey AS y, COUNT(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey),
             largest AS (SELECT MAX(GREATEST(l_partkey, l_suppkey)) AS top FROM lineitem),
             powers AS (SELECT CAST(POWER(2, lo.k + 16 * hi.k) AS BIGINT) AS p FROM bits lo CROSS JOIN bits hi WHERE lo.k + 16 * hi.k < 31)
        SELECT x, y, n, CAST(SUM((DIV(x, b.p) % 2) * b.p * b.p + (DIV(y, b.p) % 2) * 2 * b.p * b.p) AS BIGINT) AS z
        FROM z CROSS JOIN (SELECT p FROM powers CROSS JOIN largest WHERE p = 1 OR p <= top) b GROUP BY x, y, n""",
    levels_around_mean="""
        WITH m AS (SELECT part, CAST(SUM(v) AS BIGINT) AS total, COUNT(*) AS n FROM q GROUP BY part)
        SELECT x.part, x.pos, LEAST(255, GREATEST(0, 128 + DIV(x.d, x.n))) AS level FROM (SELECT q.part, q.pos, 4 * (q.v * m.n - m.total) AS d, m.n FROM q JOIN m ON q.part = m.part) x""",
    envelope="""
        SELECT part, DIV(pos, 8) AS block, COUNT(*) AS n, CAST(SUM((v - 25) * (v - 25)) AS BIGINT) AS energy FROM q GROUP BY part, DIV(pos, 8)""",
    repeat_key="""
        SELECT user_id, pos, (v + 7 * (pos % 5)) % 1000 AS enciphered FROM e WHERE v >= 0""",
    nearest_gap_1d="""
        WITH x AS (SELECT sym, v, event_rank, v - LAG(v) OVER (PARTITION BY sym ORDER BY v, event_rank) AS below, LEAD(v) OVER (PARTITION BY sym ORDER BY v, event_rank) - v AS above
                   FROM (SELECT sym, v, user_id * 1000000 + pos AS event_rank FROM e) y)
        SELECT sym, COUNT(*) AS n, CAST(SUM(LEAST(COALESCE(below, above), COALESCE(above, below))) AS BIGINT) AS total FROM x WHERE below IS NOT NULL OR above IS NOT NULL GROUP BY sym""",
    pearson_lag="""
        WITH x AS (SELECT user_id, v, LEAD(v) OVER (PARTITION BY user_id ORDER BY pos) AS w FROM e)
        SELECT user_id, CAST(SUM(v * w) AS BIGINT) AS vw, CAST(SUM(v) AS BIGINT) AS sv, CAST(SUM(w) AS BIGINT) AS sw, CAST(SUM(v * v) AS BIGINT) AS vv, CAST(SUM(w * w) AS BIGINT) AS ww, COUNT(*) AS n FROM x WHERE w IS NOT NULL GROUP BY user_id""",
    standardized="""
        WITH m AS (SELECT user_id, AVG(v) AS mean, STDDEV_POP(v) AS sd FROM e GROUP BY user_id)
        SELECT e.user_id, e.pos, ROUND((e.v - m.mean) / m.sd, 6) AS z FROM e JOIN m ON e.user_id = m.user_id WHERE m.sd > 0""",
    move_information="""
        WITH m AS (SELECT sym, LEAD(sym) OVER (PARTITION BY user_id ORDER BY pos) AS nxt FROM e), n AS (SELECT sym, nxt, COUNT(*) AS n FROM m WHERE nxt IS NOT NULL GROUP BY sym, nxt),
             x AS (SELECT n, SUM(n) OVER (PARTITION BY sym) AS a, SUM(n) OVER (PARTITION BY nxt) AS b, SUM(n) OVER () AS t FROM n)
        SELECT ROUND(SUM(CAST(n AS DOUBLE) / t * LOG2(CAST(n AS DOUBLE) * t / (CAST(a AS DOUBLE) * b))), 6) AS mutual, ROUND(-SUM(CAST(n AS DOUBLE) / t * LOG2(CAST(n AS DOUBLE) / a)), 6) AS conditional FROM x""",
)
