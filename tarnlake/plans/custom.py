"""Operators without a Spark counterpart: as-of and range joins, positional rows, fill, GROUPS and EXCLUDE frames, table changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions import fn
from tarnlake.operators import joins, rows, windows
from tarnlake.session import table


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events")
    left = e.filter("event_type = 'click'").select(F.col("event_id").alias("l_id"), F.col("user_id").alias("l_user"), F.col("ts").alias("l_ts"))
    right = e.filter("event_type = 'view'").groupBy(F.col("user_id").alias("r_user"), F.col("ts").alias("r_ts")).agg(F.min("event_id").alias("r_id"))
    return left, right


LEFT = "(SELECT event_id AS l_id, user_id AS l_user, ts AS l_ts FROM events WHERE event_type = 'click') l"
RIGHT = "(SELECT user_id AS r_user, ts AS r_ts, min(event_id) AS r_id FROM events WHERE event_type = 'view' GROUP BY ALL) r"


def _asof(op: str, how: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return joins.asof_join(*_sides(spark, d), "l_ts", "r_ts", [("l_user", "r_user")], op, how)

    kind = {"inner": "ASOF JOIN", "left": "ASOF LEFT JOIN", "semi": "ASOF SEMI JOIN", "anti": "ASOF ANTI JOIN", "right": "ASOF RIGHT JOIN", "full": "ASOF FULL JOIN"}[how]
    return run, f"SELECT * FROM {LEFT} {kind} {RIGHT} ON l_user = r_user AND l_ts {op} r_ts"


def overlap(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("a"), (F.col("conv_id") + F.length("text") % 7).alias("b"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("x"), (F.col("s_suppkey") + F.col("s_nationkey") % 5).alias("y"))
    return joins.overlap_join(c, s, ("a", "b"), ("x", "y"), 8)


def within(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("lo"), (F.col("p_retailprice") + 25).alias("hi"))
    return joins.within_join(o, p, "o_totalprice", ("lo", "hi"), 25.0)


def positional(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey")
    s = table(spark, d, "supplier").select("s_suppkey")
    return joins.positional_join(n, s, [F.col("n_nationkey").desc()], [F.col("s_suppkey").asc()])


def row_numbers(spark: SparkSession, d: str) -> DataFrame:
    return joins.numbered(table(spark, d, "orders").select("o_orderkey"), "i", F.col("o_orderkey"))


def filled(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id", F.floor(fn.epoch("ts")).alias("t")).agg(F.max("value").alias("m"))
    e = e.withColumn("v", F.when(F.col("t") % 3 == 0, F.round("m", 3)))
    return e.select("user_id", "t", F.round(windows.fill("v", "t", ["user_id"]), 4).alias("f"))


FILL = """SELECT user_id, t, round(coalesce(v, CASE
    WHEN pk IS NOT NULL AND nk IS NOT NULL THEN pv + (t - pk) * (nv - pv) / (nk - pk)
    WHEN n = 1 THEN v1
    WHEN pk IS NULL THEN v1 + (t - k1) * (v2 - v1) / (k2 - k1)
    ELSE v3 + (t - k3) * (v4 - v3) / (k4 - k3) END), 4) AS f FROM (
  SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS pk, last_value(v IGNORE NULLS) OVER b AS pv,
    first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER a AS nk, first_value(v IGNORE NULLS) OVER a AS nv,
    count(v) OVER p AS n, nth_value(v, 1 IGNORE NULLS) OVER w AS v1, nth_value(v, 2 IGNORE NULLS) OVER w AS v2,
    nth_value(CASE WHEN v IS NOT NULL THEN t END, 1 IGNORE NULLS) OVER w AS k1, nth_value(CASE WHEN v IS NOT NULL THEN t END, 2 IGNORE NULLS) OVER w AS k2,
    nth_value(v, 2 IGNORE NULLS) OVER z AS v3, nth_value(v, 1 IGNORE NULLS) OVER z AS v4,
    nth_value(CASE WHEN v IS NOT NULL THEN t END, 2 IGNORE NULLS) OVER z AS k3, nth_value(CASE WHEN v IS NOT NULL THEN t END, 1 IGNORE NULLS) OVER z AS k4
  FROM (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, CASE WHEN CAST(floor(epoch(ts)) AS BIGINT) % 3 = 0 THEN round(max(value), 3) END AS v FROM events GROUP BY 1, 2)
  WINDOW p AS (PARTITION BY user_id), b AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
    w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), z AS (PARTITION BY user_id ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def groups(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return windows.groups_frame(x, lambda w: F.count("*").over(w), [], [F.col("s_nationkey")], 1, 2, "n").select("s_suppkey", "n")


def groups_by(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return windows.groups_frame(x, lambda w: F.sum("o_orderkey").over(w), ["o_custkey"], [F.col("o_orderpriority")], 1, 0, "s").select("o_orderkey", "s")


def _exclude(what: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
        return windows.sum_excluding(x, "l_linenumber", ["l_suppkey"], [F.col("l_returnflag")], what, "s").select("l_orderkey", "l_linenumber", "s")

    return run, f"""SELECT l_orderkey, l_linenumber, sum(l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY l_returnflag
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE {what.upper()}) AS s FROM lineitem"""


def percent(spark: SparkSession, d: str) -> DataFrame:
    return rows.limit_percent(table(spark, d, "customer").select("c_custkey"), 12.5, F.col("c_custkey"))


def reservoir(spark: SparkSession, d: str) -> DataFrame:
    return rows.reservoir_sample(table(spark, d, "orders"), 100, 7).agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("d"))


def bucket(spark: SparkSession, d: str) -> DataFrame:
    return rows.bernoulli_sample(table(spark, d, "orders"), 100.0).agg(F.count("*").alias("n"))


def bernoulli(spark: SparkSession, d: str) -> DataFrame:
    """Half of the orders, twice by one seed: the same rows, about as many as asked for."""
    o = table(spark, d, "orders").select("o_orderkey")
    a, b = rows.bernoulli_sample(o, 50.0, 3), rows.bernoulli_sample(o, 50.0, 3)
    n = o.count()
    return a.agg(F.count("*").between(int(n * 0.4), int(n * 0.6)).alias("near"), F.countDistinct("o_orderkey").alias("k")).crossJoin(a.join(b, "o_orderkey").agg(F.count("*").alias("m"))).select("near", (F.col("k") == F.col("m")).alias("same"))


def system(spark: SparkSession, d: str) -> DataFrame:
    """A system sample is of rows of the table, none twice; of all, all."""
    o = table(spark, d, "orders").select("o_orderkey")
    some = rows.system_sample(o, 40.0, 2).agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("k"))
    return some.select((F.col("n") == F.col("k")).alias("once")).crossJoin(rows.system_sample(o, 100.0).agg(F.count("*").alias("n")))


def bucketed(spark: SparkSession, d: str) -> DataFrame:
    return rows.bucket_sample(table(spark, d, "orders").select("o_orderkey"), 10.0, "o_orderkey").agg((F.count("*") > 0).alias("some"), F.max(F.crc32(F.col("o_orderkey").cast("string")) < int(0.1 * 2**32)).alias("within"))


def changed(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return rows.update(x, F.col("s_acctbal") < 0, s_acctbal=F.lit(0.0))


def deleted(spark: SparkSession, d: str) -> DataFrame:
    return rows.delete(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), F.col("n_regionkey") == 1)


def _up(spark: SparkSession, d: str):
    t = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("v"))
    s = table(spark, d, "supplier").filter("s_suppkey BETWEEN 20 AND 40").select(F.col("s_suppkey").cast("int").alias("n_nationkey"), (F.col("s_nationkey") + 100).alias("v"))
    return t, s


def upserted(spark: SparkSession, d: str) -> DataFrame:
    return rows.upsert(*_up(spark, d), ["n_nationkey"])


def upsert_nothing(spark: SparkSession, d: str) -> DataFrame:
    return rows.upsert(*_up(spark, d), ["n_nationkey"], do_nothing=True)


def merged(spark: SparkSession, d: str) -> DataFrame:
    t, s = _up(spark, d)
    return rows.merge_into(t, s, ["n_nationkey"], {"v": F.col("v") + F.col("s_v")}, F.col("n_nationkey") % 4 == 1)


UP = "t AS (SELECT n_nationkey, n_regionkey AS v FROM nation), s AS (SELECT CAST(s_suppkey AS INT) AS n_nationkey, s_nationkey + 100 AS v FROM supplier WHERE s_suppkey BETWEEN 20 AND 40)"


def upsert_partial(spark: SparkSession, d: str) -> DataFrame:
    """ON CONFLICT DO UPDATE of one column, from the old and the new value; another keeps the old."""
    t = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("v"), "n_name")
    s = table(spark, d, "supplier").filter("s_suppkey BETWEEN 20 AND 40").select(F.col("s_suppkey").cast("int").alias("n_nationkey"), (F.col("s_nationkey") + 100).alias("v"), F.col("s_name").alias("n_name"))
    return rows.upsert(t, s, ["n_nationkey"], merge={"v": lambda old, new: old * 1000 + new})


def returned_update(spark: SparkSession, d: str) -> DataFrame:
    return rows.update_returning(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), F.col("s_acctbal") < 0, s_acctbal=F.col("s_acctbal") + 10_000)


def returned_delete(spark: SparkSession, d: str) -> DataFrame:
    return rows.delete_returning(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), F.col("n_regionkey") == 1)


def returned_insert(spark: SparkSession, d: str) -> DataFrame:
    return rows.insert_returning(table(spark, d, "region"), table(spark, d, "nation").select(F.col("n_nationkey").alias("r_regionkey")))


CLAUSES = [
    ("matched", "n_nationkey % 4 = 1", "delete"), ("matched", "s_v > 110", {"v": "s_v - v"}), ("not matched", "s_v < 105", {"v": "-s_v"}),
    ("not matched", "s_v > 120", "nothing"), ("not matched", None, "insert"), ("not matched by source", "v = 0", "delete"), ("not matched by source", None, {"v": "v + 1"}),
]


def _clauses() -> list[tuple]:
    act = lambda a: {k: F.expr(e) for k, e in a.items()} if isinstance(a, dict) else a
    return [(case, None if cond is None else F.expr(cond), act(a)) for case, cond, a in CLAUSES]


def merged_clauses(spark: SparkSession, d: str) -> DataFrame:
    return rows.merge(*_up(spark, d), ["n_nationkey"], _clauses())


def merged_returning(spark: SparkSession, d: str) -> DataFrame:
    return rows.merge(*_up(spark, d), ["n_nationkey"], _clauses(), returning=True)


def _merge_sql(returning: bool) -> str:
    case = """CASE WHEN t.n_nationkey IS NOT NULL AND s.n_nationkey IS NOT NULL THEN CASE WHEN t.n_nationkey % 4 = 1 THEN 'DELETE' WHEN s.v > 110 THEN 'UPDATE' ELSE 'KEEP' END
        WHEN t.n_nationkey IS NULL THEN CASE WHEN s.v < 105 THEN 'INSERT' WHEN s.v > 120 THEN 'SKIP' ELSE 'INSERT' END ELSE CASE WHEN t.v = 0 THEN 'DELETE' ELSE 'UPDATE' END END"""
    value = """CASE WHEN t.n_nationkey IS NOT NULL AND s.n_nationkey IS NOT NULL THEN CASE WHEN t.n_nationkey % 4 = 1 THEN t.v WHEN s.v > 110 THEN s.v - t.v ELSE t.v END
        WHEN t.n_nationkey IS NULL THEN CASE WHEN s.v < 105 THEN -s.v ELSE s.v END ELSE CASE WHEN t.v = 0 THEN t.v ELSE t.v + 1 END END"""
    inner = f"WITH {UP} SELECT coalesce(t.n_nationkey, s.n_nationkey) AS n_nationkey, {value} AS v, {case} AS merge_action FROM t FULL JOIN s ON t.n_nationkey = s.n_nationkey"
    return f"SELECT * FROM ({inner}) WHERE merge_action IN ('INSERT', 'UPDATE', 'DELETE')" if returning else f"SELECT n_nationkey, v FROM ({inner}) WHERE merge_action NOT IN ('SKIP', 'DELETE')"


def _by_key(agg: str, what: str, before: int | None, after: int | None):
    """Over an order without ties, so that frames of rows are the same in any engine."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        x = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 1000).alias("v"))
        return windows.excluding(x, agg, "v", ["o_custkey"], [F.col("o_orderkey")], what, "s", before, after).select("o_orderkey", F.round("s", 6).alias("s") if agg == "avg" else F.col("s").cast("long").alias("s"))

    edge = lambda n, way: f"UNBOUNDED {way}" if n is None else "CURRENT ROW" if n == 0 else f"{n} {way}"
    s = f"{agg}(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 1000 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN {edge(before, 'PRECEDING')} AND {edge(after, 'FOLLOWING')} EXCLUDE {what.upper()})"
    return run, f"SELECT o_orderkey, {'round(' + s + ', 6)' if agg == 'avg' else 'CAST(' + s + ' AS BIGINT)'} AS s FROM orders"


def _peers(agg: str, what: str):
    """Over whole partitions, whose peers are many: a row's frame does not hang on the order of its peers."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        x = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", (F.col("o_orderkey") % 1000).alias("v"))
        return windows.excluding(x, agg, "v", ["o_custkey"], [F.col("o_orderpriority")], what, "s").select("o_orderkey", F.round("s", 6).alias("s") if agg == "avg" else F.col("s").cast("long").alias("s"))

    s = f"{agg}(o_orderkey % 1000) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE {what.upper()})"
    return run, f"SELECT o_orderkey, {'round(' + s + ', 6)' if agg == 'avg' else 'CAST(' + s + ' AS BIGINT)'} AS s FROM orders"


def distinct_window(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return windows.distinct_over(x, "count", "o_orderpriority", ["o_custkey"], "n").select("o_orderkey", "n")


def ordered_window(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return windows.ordered_value(x, "first", "o_orderkey", [F.col("o_totalprice")], ["o_custkey"], [F.col("o_orderkey")], "f").select("o_orderkey", "f")


def smallest(spark: SparkSession, d: str) -> DataFrame:
    return rows.n_extremes(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", 3, "s").select("o_custkey", F.to_json("s").alias("s"))


def largest(spark: SparkSession, d: str) -> DataFrame:
    return rows.n_extremes(table(spark, d, "orders"), ["o_orderpriority"], "o_orderkey", 4, "s", largest=True).select("o_orderpriority", F.to_json("s").alias("s"))


def quantiles(spark: SparkSession, d: str) -> DataFrame:
    return rows.quantile_disc(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", 0.3, "q")


def inequality(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").filter("c_nationkey < 4").select("c_custkey", "c_acctbal")
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return joins.choose_join(c, s, compare=[("c_acctbal", ">", "s_acctbal")]).groupBy("c_custkey").agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("s"))


def inequalities(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    both = joins.pair_totals(c, s, [("c_acctbal", "<=", "s_acctbal"), ("c_custkey", ">=", "s_suppkey")], "n", {"s": "c_custkey"})
    return both.groupBy("s_suppkey").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def chosen_equal(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return joins.choose_join(o, c, [("o_custkey", "c_custkey")], [("o_totalprice", "<", "c_acctbal")]).select("o_orderkey", "c_custkey")


def positional_scan(spark: SparkSession, d: str) -> DataFrame:
    """Three tables side by side, the shorter ones filled with nulls."""
    r, n, s = (table(spark, d, t).select(k) for t, k in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("supplier", "s_suppkey")))
    two = joins.positional_join(r, n, [F.col("r_regionkey")], [F.col("n_nationkey")])
    return joins.positional_join(two, s, [F.col("n_nationkey")], [F.col("s_suppkey").desc()])


def wide_rows(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of wide rows in an order of many ties (broken by keys)."""
    x = table(spark, d, "lineitem")
    return joins.numbered(x, "i", F.col("l_returnflag"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_extendedprice")).select("l_orderkey", "l_linenumber", "l_partkey", "i")


def hops(spark: SparkSession, d: str) -> DataFrame:
    """Fewest steps from nation 0 over links n -> (2n+1) % 25 and n -> (n+7) % 25."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    links = n.select("k", F.explode(F.array((F.col("k") * 2 + 1) % 25, (F.col("k") + 7) % 25)).alias("to"))
    start = n.filter("k = 0").select("k", F.lit(0).alias("steps"))
    return rows.iterate_keyed(start, lambda have, fresh: fresh.join(links, "k").select(F.col("to").alias("k"), (F.col("steps") + 1).alias("steps")), ["k"], "steps")


HOPS = """WITH RECURSIVE r AS (SELECT 0 AS k, 0 AS steps UNION SELECT t.x, r.steps + 1 FROM r, LATERAL (SELECT unnest([(r.k * 2 + 1) % 25, (r.k + 7) % 25]) AS x) t WHERE r.steps < 25)
    SELECT k, min(steps) AS steps FROM r GROUP BY k"""

ITEMS = {
    "asof_inner": _asof(">=", "inner"),
    "asof_left": _asof(">=", "left"),
    "asof_strict": _asof(">", "left"),
    "asof_forward": _asof("<=", "left"),
    "asof_forward_strict": _asof("<", "inner"),
    "asof_semi": _asof(">=", "semi"),
    "asof_anti": _asof(">=", "anti"),
    "asof_right": _asof(">=", "right"),
    "asof_full": _asof(">=", "full"),
    "range_overlap_join": (overlap, "SELECT a, b, x, y FROM (SELECT conv_id AS a, conv_id + length(text) % 7 AS b FROM conversations) JOIN (SELECT s_suppkey AS x, s_suppkey + s_nationkey % 5 AS y FROM supplier) ON a <= y AND x <= b"),
    "range_within_join": (within, "SELECT o_orderkey, o_totalprice, p_partkey, p_retailprice AS lo, p_retailprice + 25 AS hi FROM orders JOIN part ON o_totalprice >= p_retailprice AND o_totalprice < p_retailprice + 25"),
    "positional_join": (positional, "SELECT * FROM (SELECT n_nationkey FROM nation ORDER BY n_nationkey DESC) POSITIONAL JOIN (SELECT s_suppkey FROM supplier ORDER BY s_suppkey)"),
    "row_numbers": (row_numbers, "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders"),
    "window_fill": (filled, FILL),
    "window_groups": (groups, "SELECT s_suppkey, count(*) OVER (ORDER BY s_nationkey GROUPS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS n FROM supplier"),
    "window_groups_partitioned": (groups_by, "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM orders"),
    "window_exclude_row": _exclude("current row"),
    "window_exclude_group": _exclude("group"),
    "window_exclude_ties": _exclude("ties"),
    "limit_percent": (percent, "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 12.5%"),
    "reservoir_sample": (reservoir, "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS d FROM (SELECT * FROM orders USING SAMPLE reservoir(100 ROWS))"),
    "bernoulli_sample": (bucket, "SELECT count(*) AS n FROM (SELECT * FROM orders USING SAMPLE 100 PERCENT (bernoulli))"),
    "update_rows": (changed, "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier"),
    "delete_rows": (deleted, "SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey <> 1"),
    "upsert": (upserted, f"WITH {UP} SELECT coalesce(s.n_nationkey, t.n_nationkey) AS n_nationkey, coalesce(s.v, t.v) AS v FROM t FULL JOIN s ON t.n_nationkey = s.n_nationkey"),
    "upsert_do_nothing": (upsert_nothing, f"WITH {UP} SELECT coalesce(t.n_nationkey, s.n_nationkey) AS n_nationkey, coalesce(t.v, s.v) AS v FROM t FULL JOIN s ON t.n_nationkey = s.n_nationkey"),
    "merge_into": (merged, f"WITH {UP} SELECT coalesce(t.n_nationkey, s.n_nationkey) AS n_nationkey, CASE WHEN t.n_nationkey IS NULL THEN s.v WHEN s.n_nationkey IS NULL THEN t.v ELSE t.v + s.v END AS v FROM t FULL JOIN s ON t.n_nationkey = s.n_nationkey WHERE NOT (t.n_nationkey IS NOT NULL AND s.n_nationkey IS NOT NULL AND t.n_nationkey % 4 = 1)"),
    "recursive_keyed": (hops, HOPS),
    "bernoulli_half": (bernoulli, "SELECT true AS near, true AS same"),
    "system_sample": (system, "SELECT true AS once, count(*) AS n FROM orders"),
    "bucket_sample": (bucketed, "SELECT true AS some, true AS within"),
    "upsert_partial": (upsert_partial, "WITH t AS (SELECT n_nationkey, n_regionkey AS v, n_name FROM nation), s AS (SELECT CAST(s_suppkey AS INT) AS n_nationkey, s_nationkey + 100 AS v, s_name AS n_name FROM supplier WHERE s_suppkey BETWEEN 20 AND 40) SELECT coalesce(t.n_nationkey, s.n_nationkey) AS n_nationkey, CASE WHEN t.n_nationkey IS NULL THEN s.v WHEN s.n_nationkey IS NULL THEN t.v ELSE t.v * 1000 + s.v END AS v, coalesce(t.n_name, s.n_name) AS n_name FROM t FULL JOIN s ON t.n_nationkey = s.n_nationkey"),
    "returning_update": (returned_update, "SELECT s_suppkey, s_acctbal + 10000 AS s_acctbal FROM supplier WHERE s_acctbal < 0"),
    "returning_delete": (returned_delete, "SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey = 1"),
    "returning_insert": (returned_insert, "SELECT n_nationkey AS r_regionkey, CAST(NULL AS VARCHAR) AS r_name FROM nation"),
    "merge_clauses": (merged_clauses, _merge_sql(False)),
    "merge_returning": (merged_returning, _merge_sql(True)),
    "exclude_row_running_sum": _by_key("sum", "current row", None, 0),
    "exclude_row_around_avg": _by_key("avg", "current row", 2, 3),
    "exclude_row_around_max": _by_key("max", "current row", 1, 1),
    "exclude_group_count": _peers("count", "group"),
    "exclude_group_min": _peers("min", "group"),
    "exclude_ties_avg": _peers("avg", "ties"),
    "exclude_ties_max": _peers("max", "ties"),
    "window_distinct": (distinct_window, "SELECT o_orderkey, count(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS n FROM orders"),
    "window_ordered_value": (ordered_window, "SELECT o_orderkey, first_value(o_orderkey ORDER BY o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM orders"),
    "smallest_n": (smallest, "SELECT o_custkey, CAST(to_json(min(o_orderkey, 3)) AS VARCHAR) AS s FROM orders GROUP BY o_custkey"),
    "largest_n": (largest, "SELECT o_orderpriority, CAST(to_json(max(o_orderkey, 4)) AS VARCHAR) AS s FROM orders GROUP BY o_orderpriority"),
    "quantile_by_counts": (quantiles, "SELECT l_suppkey, quantile_disc(l_quantity, 0.3) AS q FROM lineitem GROUP BY l_suppkey"),
    "inequality_join": (inequality, "SELECT c_custkey, count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS s FROM customer JOIN supplier ON c_acctbal > s_acctbal WHERE c_nationkey < 4 GROUP BY c_custkey"),
    "inequality_pair_join": (inequalities, "SELECT s_suppkey, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS s FROM customer JOIN supplier ON c_acctbal <= s_acctbal AND c_custkey >= s_suppkey GROUP BY s_suppkey"),
    "chosen_equal_join": (chosen_equal, "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice < c_acctbal"),
    "positional_scan": (positional_scan, "SELECT r_regionkey, n_nationkey, s_suppkey FROM ((SELECT r_regionkey FROM region ORDER BY 1) POSITIONAL JOIN (SELECT n_nationkey FROM nation ORDER BY 1)) POSITIONAL JOIN (SELECT s_suppkey FROM supplier ORDER BY 1 DESC)"),
    "numbered_wide": (wide_rows, "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_returnflag, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i FROM lineitem"),
}
