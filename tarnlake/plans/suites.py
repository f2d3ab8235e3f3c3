"""Suites over the given tables: flights over a star, grouping and joining, questions to a log of events. The texts run as they are in either engine."""

from __future__ import annotations

from tarnlake.plans.text import same

MONEY = "CAST(sum(CAST({} AS DECIMAL(18,4))) AS DOUBLE)"
#: The star, flattened: a line with its order's date, and with customer, supplier and part.
STAR = """(SELECT l_quantity AS qty, l_extendedprice AS price, l_discount AS off, l_tax AS tax, year(o_orderdate) AS y, month(o_orderdate) AS m, o_custkey, p_brand, p_type, p_size,
    cn.n_name AS c_nation, cr.r_name AS c_region, sn.n_name AS s_nation, sr.r_name AS s_region FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey) AS star"""
GAIN = MONEY.format("price * (1 - off) - price * tax")
SAVED = MONEY.format("price * off")
REVENUE = MONEY.format("price")


def _star(select: str, where: str, group: str = "") -> tuple:
    return same(f"SELECT {select} FROM {STAR} WHERE {where}" + (f" GROUP BY {group}" if group else ""))


FLIGHTS = {
    "star_11": _star(f"{SAVED} AS saved", "y = 1996 AND off BETWEEN 0.01 AND 0.03 AND qty < 25"),
    "star_12": _star(f"{SAVED} AS saved", "y = 1997 AND m = 1 AND off BETWEEN 0.04 AND 0.06 AND qty BETWEEN 26 AND 35"),
    "star_13": _star(f"{SAVED} AS saved", "y = 1997 AND m IN (2, 3) AND off >= 0.05 AND qty BETWEEN 26 AND 40 AND p_size < 20"),
    "star_21": _star(f"y, p_brand, {REVENUE} AS revenue", "p_type = 'PROMO' AND s_region = 'AMERICA'", "y, p_brand"),
    "star_22": _star(f"y, p_brand, {REVENUE} AS revenue", "p_brand BETWEEN 'Brand#12' AND 'Brand#18' AND s_region = 'ASIA'", "y, p_brand"),
    "star_23": _star(f"y, p_brand, {REVENUE} AS revenue", "p_brand = 'Brand#9' AND s_region = 'EUROPE'", "y, p_brand"),
    "star_31": _star(f"c_nation, s_nation, y, {REVENUE} AS revenue", "c_region = 'ASIA' AND s_region = 'ASIA' AND y BETWEEN 1996 AND 1998", "c_nation, s_nation, y"),
    "star_32": _star(f"c_nation, s_nation, y, {REVENUE} AS revenue", "c_nation = 'NATION_2' AND s_nation IN ('NATION_2', 'NATION_7')", "c_nation, s_nation, y"),
    "star_33": _star(f"o_custkey, y, {REVENUE} AS revenue", "c_nation IN ('NATION_1', 'NATION_5') AND s_nation IN ('NATION_1', 'NATION_5')", "o_custkey, y"),
    "star_34": _star(f"o_custkey, y, m, {REVENUE} AS revenue", "c_nation IN ('NATION_1', 'NATION_5') AND s_region = 'AFRICA' AND y = 1997 AND m = 12", "o_custkey, y, m"),
    "star_41": _star(f"y, c_nation, {GAIN} AS gain", "c_region = 'AMERICA' AND s_region = 'AMERICA' AND p_type IN ('PROMO', 'SMALL')", "y, c_nation"),
    "star_42": _star(f"y, s_nation, p_type, {GAIN} AS gain", "c_region = 'AMERICA' AND s_region = 'AMERICA' AND y IN (1997, 1998)", "y, s_nation, p_type"),
    "star_43": _star(f"y, s_nation, p_brand, {GAIN} AS gain", "s_nation = 'NATION_6' AND y IN (1997, 1998) AND p_type = 'LARGE'", "y, s_nation, p_brand"),
}

GROUPS = {
    "group_1": same("SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS v FROM lineitem GROUP BY l_returnflag"),
    "group_2": same("SELECT l_returnflag, l_linestatus, CAST(sum(l_linenumber) AS BIGINT) AS v FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "group_3": same("SELECT l_partkey, CAST(sum(l_linenumber) AS BIGINT) AS v, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY l_partkey"),
    "group_4": same("SELECT l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS a, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS b, CAST(avg(CAST(l_discount * 100 AS DECIMAL(9,4))) AS DECIMAL(9,3)) > 5 AS c FROM lineitem GROUP BY l_suppkey"),
    "group_5": same("SELECT l_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS a, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS b FROM lineitem GROUP BY l_orderkey"),
    "group_6": same("SELECT l_returnflag, l_suppkey, median(l_quantity) AS md, round(stddev_samp(l_quantity), 5) AS sd FROM lineitem GROUP BY l_returnflag, l_suppkey"),
    "group_7": same("SELECT l_partkey, max(l_linenumber) - min(l_suppkey) AS r FROM lineitem GROUP BY l_partkey"),
    "group_8": same("SELECT l_suppkey, l_extendedprice AS top FROM (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS n FROM lineitem) t WHERE n <= 2"),
    "group_9": same("SELECT l_returnflag, l_linenumber, round(pow(corr(l_quantity, l_extendedprice), 2), 5) AS r2 FROM lineitem GROUP BY l_returnflag, l_linenumber"),
    "group_10": same("SELECT l_returnflag, l_linestatus, l_linenumber, l_suppkey, l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber, l_suppkey, l_partkey"),
    "join_small": same("SELECT o_orderpriority, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS s FROM orders JOIN nation ON o_custkey % 25 = n_nationkey GROUP BY o_orderpriority"),
    "join_medium": same("SELECT c_nationkey, count(*) AS n, max(o_totalprice) AS top FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey"),
    "join_medium_outer": same("SELECT count(*) AS n, count(o_orderkey) AS found, count(DISTINCT c_custkey) AS who FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'"),
    "join_big": same("SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey"),
}

LOG = {
    "log_count": same("SELECT count(*) AS n FROM events WHERE event_type <> 'view'"),
    "log_sums": same("SELECT count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS a, max(ts) AS z FROM events"),
    "log_users": same("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10"),
    "log_types": same("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 5) AS v FROM events GROUP BY event_type"),
    "log_like": same("SELECT count(*) AS n FROM events WHERE props LIKE '%9%' AND event_type LIKE '%ign%'"),
    "log_pairs": same("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type ORDER BY n DESC, user_id, event_type LIMIT 10"),
    "log_minutes": same("SELECT user_id, minute(ts) AS m, event_type, count(*) AS n FROM events GROUP BY user_id, minute(ts), event_type ORDER BY n DESC, user_id, m, event_type LIMIT 10"),
    "log_one_user": same("SELECT event_id, ts FROM events WHERE user_id = 31 ORDER BY ts LIMIT 10"),
    "log_longest": same("SELECT event_type, round(avg(length(props)), 5) AS l, count(*) AS n FROM events GROUP BY event_type HAVING count(*) > 100"),
    "log_days": same("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY CAST(ts AS DATE)"),
    "log_hours": same("SELECT hour(ts) AS h, event_type, count(*) AS n FROM events GROUP BY hour(ts), event_type"),
    "log_wide": same("SELECT " + ", ".join(f"CAST(sum(user_id + {k}) AS BIGINT) AS s{k}" for k in range(40)) + " FROM events"),
    "log_offset": same("SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10 OFFSET 20"),
    "log_first": same("SELECT user_id, event_type AS first FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) t WHERE n = 1"),
    "log_funnel": same("""SELECT count(*) AS users, count_if(clicked) AS clicked, count_if(clicked AND bought) AS bought FROM
        (SELECT user_id, bool_or(event_type = 'click') AS clicked, bool_or(event_type = 'purchase' AND value > 10) AS bought FROM events GROUP BY user_id) t"""),
}

MORE = {
    "tpch_q08": same("""SELECT y, round(CAST(sum(CASE WHEN nation = 'NATION_2' THEN volume ELSE 0 END) AS DOUBLE) / CAST(sum(volume) AS DOUBLE), 6) AS share FROM (
        SELECT year(o_orderdate) AS y, CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS volume, sn.n_name AS nation FROM part, supplier, lineitem, orders, customer, nation cn, nation sn, region
        WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = cn.n_nationkey AND cn.n_regionkey = r_regionkey AND r_name = 'AMERICA'
        AND s_nationkey = sn.n_nationkey AND p_type = 'ECONOMY') t GROUP BY y"""),
    "tpch_q09": same("""SELECT n_name, year(o_orderdate) AS y, CAST(sum(CAST(l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity / 10 AS DECIMAL(18,4))) AS DOUBLE) AS gain
        FROM part, supplier, lineitem, orders, nation WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_brand LIKE '%#1%' GROUP BY n_name, year(o_orderdate)"""),
    "tpch_q20": same("""SELECT s_name FROM supplier, nation WHERE s_nationkey = n_nationkey AND n_name IN ('NATION_1', 'NATION_2', 'NATION_3') AND s_suppkey IN
        (SELECT l_suppkey FROM lineitem, part WHERE l_partkey = p_partkey AND p_type = 'PROMO' AND l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' GROUP BY l_suppkey HAVING sum(l_quantity) > 100)"""),
}

ITEMS = {**FLIGHTS, **GROUPS, **LOG, **MORE}
