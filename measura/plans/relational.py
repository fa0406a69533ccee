"""The relational substrate: joins, grouping, windows, sets, JSON and dates on the star tables (survey 2.0)."""

from __future__ import annotations

from measura.plans.shared import family

REGISTRY = family(
    q1_pricing="""
        SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty,
               CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS sum_cents,
               CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT) * (100 - CAST(ROUND(l_discount * 100) AS BIGINT))) AS BIGINT) AS sum_discounted,
               COUNT(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    join_inner_revenue="""
        SELECT c.c_mktsegment AS segment, CAST(SUM(CAST(ROUND(o.o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, COUNT(*) AS n
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment""",
    join_left_counts="""
        SELECT c.c_custkey, COUNT(o.o_orderkey) AS n_orders
        FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey""",
    join_semi_ordered="""
        SELECT c_custkey, c_name FROM customer c
        WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O')""",
    join_anti_idle="""
        SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)""",
    join_anti_busy="""
        SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O' AND o.o_totalprice > 250000)""",
    join_full_nation="""
        SELECT COALESCE(a.k, b.k) AS nationkey, COALESCE(a.n, 0) AS customers, COALESCE(b.n, 0) AS suppliers
        FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey) a
        FULL JOIN (SELECT s_nationkey AS k, COUNT(*) AS n FROM supplier GROUP BY s_nationkey) b ON a.k = b.k""",
    join_cross_region="""
        SELECT a.r_name AS from_region, b.r_name AS to_region FROM region a CROSS JOIN region b WHERE a.r_regionkey < b.r_regionkey""",
    join_range_price_band="""
        WITH bands AS (SELECT 0 AS band, 0 AS lo, 100000 AS hi UNION ALL SELECT 1, 100000, 150000 UNION ALL SELECT 2, 150000, 100000000)
        SELECT b.band, COUNT(*) AS n, CAST(SUM(p.p_size) AS BIGINT) AS size_sum
        FROM part p JOIN bands b ON CAST(ROUND(p.p_retailprice * 100) AS BIGINT) >= b.lo AND CAST(ROUND(p.p_retailprice * 100) AS BIGINT) < b.hi
        GROUP BY b.band""",
    join_asof_event_order="""
        SELECT user_id, pos, last_purchase FROM (
          SELECT user_id, pos, sym, MAX(CASE WHEN sym = 'purchase' THEN pos END)
                 OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM e) x
        WHERE sym <> 'purchase'""",
    agg_rollup="""
        SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    agg_cube="""
        SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
    agg_grouping_sets="""
        SELECT p_brand, p_type, COUNT(*) AS n, CAST(MAX(p_size) AS BIGINT) AS max_size FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())""",
    agg_distinct="""
        SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag""",
    agg_having="""
        SELECT l_partkey, COUNT(*) AS n FROM lineitem GROUP BY l_partkey HAVING COUNT(*) >= 25""",
    win_rank_topk="""
        SELECT segment, c_custkey, place FROM (
          SELECT c_mktsegment AS segment, c_custkey, CAST(ROW_NUMBER() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS place FROM customer) x
        WHERE place <= 3""",
    win_dense_rank="""
        SELECT p_partkey, CAST(RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS rnk,
               CAST(DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS dense,
               CAST(NTILE(4) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS BIGINT) AS quarter FROM part""",
    win_frame_sum="""
        SELECT part, pos, CAST(SUM(v) OVER (PARTITION BY part ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT) AS last4 FROM q""",
    win_lag_lead="""
        SELECT user_id, pos, v - LAG(v) OVER (PARTITION BY user_id ORDER BY pos) AS step, LEAD(sym) OVER (PARTITION BY user_id ORDER BY pos) AS next_sym FROM e""",
    set_union="SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    set_intersect="SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier",
    set_except_buyers="SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders WHERE o_totalprice > 250000",
    set_except="SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier",
    set_intersect_all="SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' INTERSECT ALL SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'",
    topk_orders="SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    date_parts="""
        SELECT CAST(YEAR(o_orderdate) AS BIGINT) AS y, CAST(QUARTER(o_orderdate) AS BIGINT) AS quarter, CAST(MONTH(o_orderdate) AS BIGINT) AS m, COUNT(*) AS n
        FROM orders GROUP BY 1, 2, 3""",
    scalar_subquery="""
        SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.5 * AVG(o_totalprice) FROM orders)""",
    join_three_way="""
        SELECT n.n_name, r.r_name, COUNT(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
        JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_name, r.r_name""",
    recursive_reach="""
        WITH RECURSIVE n AS (SELECT COUNT(*) AS n FROM supplier),
             walk(k, depth) AS (SELECT s_suppkey, CAST(0 AS BIGINT) FROM supplier WHERE s_nationkey < 3 UNION ALL SELECT (w.k * 3 + 1) % n.n, w.depth + 1 FROM walk w CROSS JOIN n WHERE w.depth < 12)
        SELECT k, MIN(depth) AS first_depth FROM walk GROUP BY k""",
)
