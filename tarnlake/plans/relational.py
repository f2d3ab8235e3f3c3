"""Relational core: scans, filters, joins, aggregates, windows, order, sets and common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.plans.text import pair, same
from tarnlake.session import table


def tpch_q06(spark: SparkSession, d: str) -> DataFrame:
    """Filter and ungrouped aggregate; all four predicates reach the scan."""
    x = table(spark, d, "lineitem")
    return x.filter(
        (F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
        & (F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
        & F.col("l_discount").between(0.05, 0.07)
        & (F.col("l_quantity") < 24)
    ).agg(F.sum((F.col("l_extendedprice") * F.col("l_discount")).cast("decimal(18,4)")).cast("double").alias("revenue"), F.count("*").alias("n"))


REVENUE = "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))"

ITEMS = {
    "tpch_q06": (
        tpch_q06,
        """SELECT CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18,4))) AS DOUBLE) AS revenue, count(*) AS n FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'
        AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    ),
    "tpch_q01": same(f"""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base, CAST(sum({REVENUE}) AS DOUBLE) AS sum_disc,
        round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus"""),
    "tpch_q03": same(f"""SELECT l_orderkey, CAST(sum({REVENUE}) AS DOUBLE) AS revenue, o_orderdate FROM customer, orders, lineitem
        WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1996-03-15'
        AND l_shipdate > TIMESTAMP '1996-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10"""),
    "tpch_q05": same(f"""SELECT n_name, CAST(sum({REVENUE}) AS DOUBLE) AS revenue FROM customer, orders, lineitem, supplier, nation, region
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
        AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name"""),
    "tpch_q10": same(f"""SELECT c_custkey, c_name, CAST(sum({REVENUE}) AS DOUBLE) AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey
        GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20"""),
    "tpch_q12": same("""SELECT o_orderpriority, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned, sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS kept
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY o_orderpriority"""),
    "tpch_q14": same(f"""SELECT round(100.0 * CAST(sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REVENUE} ELSE 0 END) AS DOUBLE) / CAST(sum({REVENUE}) AS DOUBLE), 6) AS promo
        FROM lineitem, part WHERE l_partkey = p_partkey"""),
    "tpch_q18": same("""SELECT c_name, c_custkey, o_orderkey, o_totalprice, sum(l_quantity) AS qty FROM customer, orders, lineitem
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 180)
        AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, c_custkey, o_orderkey, o_totalprice"""),
    "tpch_q22": same("""SELECT c_nationkey, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS bal FROM customer
        WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY c_nationkey"""),
    "flat_star": same("""SELECT year(o_orderdate) AS y, p_brand, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS rev FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AMERICA' GROUP BY year(o_orderdate), p_brand"""),
    "filter_project": same("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS q2, l_tax FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_returnflag IN ('A', 'R') AND NOT (l_tax = 0)"),
    "values_scan": same("SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)"),
    "empty_result": same("SELECT n_name FROM nation WHERE false"),
    "dummy_scan": same("SELECT 1 AS one, 'a' AS a"),
    "unnest_zip": pair("SELECT n_nationkey, x.a, x.b FROM (SELECT n_nationkey, arrays_zip(array(1, 2, 3) AS a, array('x', 'y') AS b) z FROM nation) LATERAL VIEW explode(z) t AS x".replace("array(1, 2, 3) AS a", "array(1, 2, 3)").replace("array('x', 'y') AS b", "array('x', 'y')").replace("x.a, x.b", "x['0'] AS a, x['1'] AS b"),
        "SELECT n_nationkey, unnest([1, 2, 3]) AS a, unnest(['x', 'y']) AS b FROM nation"),
    "pivot_agg": pair("SELECT * FROM (SELECT o_orderstatus, o_orderpriority, o_totalprice FROM orders) PIVOT (count(o_totalprice) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))",
        "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, nullif(count(*) FILTER (o_orderstatus = 'P'), -1) AS p FROM orders GROUP BY 1"),
    "unpivot": pair("SELECT s_suppkey, name, v FROM (SELECT s_suppkey, s_acctbal AS bal, CAST(s_nationkey AS DOUBLE) AS nk FROM supplier) UNPIVOT (v FOR name IN (bal, nk))",
        "SELECT s_suppkey, 'bal' AS name, s_acctbal AS v FROM supplier UNION ALL SELECT s_suppkey, 'nk', CAST(s_nationkey AS DOUBLE) FROM supplier"),
    "join_inner": same("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "join_left": same("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000"),
    "join_right": same("SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'"),
    "join_full": same("SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey"),
    "join_semi": pair("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey"),
    "join_anti": pair("SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000"),
    "not_in_with_nulls": same("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey = 2 THEN NULL ELSE r_regionkey END FROM region)"),
    "join_mark": same("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000) AS big FROM customer"),
    "join_single": same("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer"),
    "join_natural": same("SELECT n_nationkey, r_name FROM (SELECT n_nationkey, n_regionkey AS k FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) b"),
    "join_using": same("SELECT k, n, m FROM (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey) a JOIN (SELECT r_regionkey AS k, length(r_name) AS m FROM region) b USING (k)"),
    "cross_product": same("SELECT r_name, n_name FROM region CROSS JOIN nation"),
    "theta_join": same("SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM nation a JOIN region b ON a.n_nationkey < b.r_regionkey OR a.n_regionkey = b.r_regionkey + 1"),
    "lateral_join": same("SELECT c_custkey, t.o_orderkey, t.o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t"),
    "correlated_exists": same("SELECT count(*) AS n FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49)"),
    "group_by_all": same("SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_tax) AS t FROM lineitem GROUP BY ALL"),
    "having": same("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15"),
    "grouping_sets": same("SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())".replace("grouping(l_returnflag) AS g1", "CAST(grouping(l_returnflag) AS INT) AS g1").replace("grouping(l_linestatus) AS g2", "CAST(grouping(l_linestatus) AS INT) AS g2")),
    "rollup": same("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    "cube": same("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "distinct_aggregate": same("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps, count(*) AS n FROM lineitem GROUP BY l_returnflag"),
    "filter_aggregate": same("SELECT l_linestatus, count(*) FILTER (WHERE l_quantity > 25) AS big, sum(l_linenumber) FILTER (WHERE l_tax > 0.04) AS taxed FROM lineitem GROUP BY l_linestatus"),
    "ordered_aggregate": pair("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey"),
    "distinct_rows": same("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "distinct_on": pair("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1",
        "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey"),
    "qualify": pair("SELECT l_orderkey, l_linenumber, rk FROM (SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS rk FROM lineitem) WHERE rk <= 2",
        "SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS rk FROM lineitem QUALIFY rk <= 2"),
    "window_rank": same("""SELECT c_custkey, row_number() OVER w AS rn, rank() OVER p AS rk, dense_rank() OVER p AS dr, ntile(4) OVER w AS nt,
        round(percent_rank() OVER p, 9) AS pr, round(cume_dist() OVER p, 9) AS cd FROM customer
        WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey), p AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)"""),
    "window_value": same("""SELECT o_orderkey, lag(o_totalprice) OVER w AS lg, lead(o_totalprice, 2) OVER w AS ld, first_value(o_orderkey) OVER w AS fv,
        last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv,
        nth_value(o_orderkey, 2) OVER w AS nv FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""),
    "window_ignore_nulls": pair("SELECT event_id, last_value(v) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_v FROM (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)",
        "SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_v FROM (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)"),
    "window_rows_frame": same("SELECT l_orderkey, l_linenumber, sum(l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS s FROM lineitem"),
    "window_range_frame": same("SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_custkey RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS n FROM orders"),
    "window_aggregate": same("SELECT s_suppkey, count(*) OVER (PARTITION BY s_nationkey) AS n, max(s_acctbal) OVER (PARTITION BY s_nationkey) AS m FROM supplier"),
    "top_n": same("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25"),
    "limit_offset": same("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 5"),
    "order_nulls": pair("SELECT x, row_number() OVER (ORDER BY x ASC NULLS LAST) AS rn FROM (VALUES (3), (NULL), (1)) AS t(x)", "SELECT x, row_number() OVER (ORDER BY x) AS rn FROM (VALUES (3), (NULL), (1)) AS t(x)"),
    "union_all": same("SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region"),
    "union_distinct": same("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region"),
    "intersect": same("SELECT s_nationkey AS k FROM supplier INTERSECT SELECT n_regionkey FROM nation"),
    "intersect_all": same("SELECT s_nationkey AS k FROM supplier INTERSECT ALL SELECT c_nationkey FROM customer"),
    "except": same("SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region"),
    "except_all": same("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier"),
    "cte": same("WITH big AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS t FROM orders GROUP BY o_custkey) SELECT a.o_custkey, CAST(a.t AS DOUBLE) AS t FROM big a JOIN big b ON a.o_custkey = b.o_custkey + 1 WHERE a.t > b.t"),
    "recursive_cte": same("WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 15) SELECT n, f FROM r"),
    "h2o_group": same("SELECT l_returnflag AS id1, l_partkey % 100 AS id4, CAST(sum(l_linenumber) AS BIGINT) AS v1, round(avg(l_quantity), 6) AS v2, max(l_tax) - min(l_tax) AS v3 FROM lineitem GROUP BY l_returnflag, l_partkey % 100"),
    "click_hits": same("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS first_ts, max(ts) AS last_ts FROM events WHERE value > 10 GROUP BY event_type ORDER BY n DESC LIMIT 10"),
    "case_when": same("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 's' WHEN l_quantity < 30 THEN 'm' ELSE 'l' END AS size FROM lineitem"),
    "subquery_any_all": pair("SELECT n_nationkey FROM nation WHERE n_regionkey >= (SELECT max(r_regionkey) FROM region) OR n_regionkey IN (SELECT min(r_regionkey) FROM region)",
        "SELECT n_nationkey FROM nation WHERE n_regionkey >= ALL (SELECT r_regionkey FROM region) OR n_regionkey = ANY (SELECT min(r_regionkey) FROM region)"),
}
