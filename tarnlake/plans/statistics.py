"""Block statistics: the tables they make, pruned queries, whose oracle is the query without pruning, and what they save.

A block table and its statistics are written once for each application and data directory, as a user would keep them
beside the table; the queries then only evaluate and scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.session import table
from tarnlake.sources import statements
from tarnlake.stats import assign, blocks, workload

ROWS = 2048
_HELD: dict = {}


def _once(spark: SparkSession, key: tuple, make) -> DataFrame:
    key = (spark.sparkContext.applicationId, *key)
    if key not in _HELD:
        df = make()
        _HELD[key] = (df.inputFiles(), df.schema)
    files, schema = _HELD[key]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, (d, "events"), lambda: blocks.stored(table(spark, d, "events"), [F.col("event_id")], ROWS))


def _items(spark: SparkSession, d: str) -> DataFrame:
    def make() -> DataFrame:
        x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", F.when(F.col("l_quantity") < 45, F.col("l_returnflag")).alias("flag"))
        return blocks.stored(x, [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_extendedprice")], ROWS)

    return _once(spark, (d, "lineitem"), make)


def _stats(spark: SparkSession, d: str, source, cols: list[str], kinds: list[str]) -> DataFrame:
    df = source(spark, d)
    return _once(spark, (d, source.__name__, *cols, "/", *kinds), lambda: blocks.saved(blocks.build(df, cols, kinds), "statistics"))


def min_max(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return e.groupBy("block").agg(F.count("*").alias("n"), F.min("user_id").alias("low"), F.max("user_id").alias("high"), F.countDistinct("user_id").alias("kinds"))


def _pruned(source, f: tuple, kinds: list[str], cols: list[str], out: list[str], sql: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return blocks.pruned(source(spark, d), _stats(spark, d, source, cols, kinds), f).select(*out)

    return run, sql


POINTS = [("=", "user_id", 77), ("in", "user_id", [5, 91]), ("=", "user_id", -4), ("=", "user_id", 12.5), ("is null", "user_id")]
SPANS = [("between", "event_id", 100, 2500), ("<", "event_id", 3000.5), (">=", "event_id", 9_000_000_000), ("<>", "event_id", "x"), ("<=", "event_id", -1)]


def _report(filters: list[tuple], cols: list[str], kinds: list[str]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return blocks.report(_events(spark, d), _stats(spark, d, _events, cols, kinds), filters)

    return run


def _left(tests: list[str]) -> str:
    """Blocks and rows left where a block's own rows say so: exact for ranges, and for dictionaries of points."""
    numbered = f"b AS (SELECT (rn - 1) // {ROWS} AS block, * FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS rn FROM events))"
    per = "s AS (SELECT block, count(*) AS n, min(event_id) AS low, max(event_id) AS high, list(DISTINCT user_id) AS users FROM b GROUP BY block)"
    each = " UNION ALL ".join(f"SELECT CAST({i} AS INT) AS query, count(*) AS blocks, CAST(count(*) FILTER ({t}) AS BIGINT) AS scanned, CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER ({t}), 0) AS BIGINT) AS rows_left FROM s" for i, t in enumerate(tests))
    return f"WITH {numbered}, {per} {each}"


KINDS = ["bloom_tiny", "bloom_m", "dictionary", "occupancy_s", "nullspace_s", "nullspace3_s"]
BUDGET = 20_000


def _assigned(name: str):
    """Kinds chosen on one workload under a budget of bytes; the queries of another then read through what was kept."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df, stats = _events(spark, d), _stats(spark, d, _events, ["user_id"], KINDS)
        tune = [("=", "user_id", k) for k in range(0, 200, 7)]
        options = assign.measured(df, stats, tune)
        if name == "priced":
            kept = assign.chosen(stats, assign.priced(options, BUDGET))
        else:
            kept = assign.chosen(stats, assign.ASSIGNERS[name]([assign.Option((r.block, r.col), r.kind, r.bytes, r.prunes) for r in options.collect()], BUDGET))
        return blocks.pruned(df, kept, ("in", "user_id", [3, 44, 150])).select("event_id", "user_id")

    return run, "SELECT event_id, user_id FROM events WHERE user_id IN (3, 44, 150)"


def _budget(spark: SparkSession, d: str) -> DataFrame:
    """Whether each assigner keeps to the budget and saves at least what the simple one does not lose: a row for each."""
    df, stats = _events(spark, d), _stats(spark, d, _events, ["user_id"], KINDS)
    options = assign.measured(df, stats, [("=", "user_id", k) for k in range(0, 200, 7)])
    priced = options.join(assign.priced(options, BUDGET), ["block", "col", "kind"]).agg(F.lit("priced").alias("assigner"), (F.coalesce(F.sum("bytes"), F.lit(0)) <= BUDGET).alias("fits"))
    held = [assign.Option((r.block, r.col), r.kind, r.bytes, r.prunes) for r in options.collect()]
    rows = [(name, sum(o.size for o in f(held, BUDGET).values()) <= BUDGET) for name, f in assign.ASSIGNERS.items()]
    return spark.createDataFrame(rows, "assigner string, fits boolean").unionAll(priced)


def _generated(spark: SparkSession, d: str) -> DataFrame:
    return workload.generate(spark, 50_000, "sorted").select("time", "block")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, (d, "pages"), lambda: blocks.stored(table(spark, d, "pages").select("page_id", "url"), [F.col("page_id")], 32))


def scans_less(spark: SparkSession, d: str) -> DataFrame:
    """What a pruned query's scan reads, from its own plan: fewer rows than the table has, as row groups are skipped."""
    df = _items(spark, d)
    got = statements.explain_analyze(blocks.pruned(df, _stats(spark, d, _items, ["l_orderkey"], []), ("between", "l_orderkey", 100, 400)))
    scan = got.filter("operator LIKE 'Scan%'").agg(F.max("n_rows").alias("read"))
    n = df.filter("l_orderkey BETWEEN 100 AND 400").count()
    return scan.select(F.lit(n).cast("long").alias("n"), ((F.col("read") >= n) & (F.col("read") < df.count())).alias("fewer"))


def _pruned_ntz(spark: SparkSession, d: str) -> DataFrame:
    return blocks.pruned(_events(spark, d), _stats(spark, d, _events, ["ts"], ["occupancy_m"]), ("and", (">=", "ts", "2024-01-03"), ("<", "ts", "2024-01-03 12:00:00"))).select("event_id", "ts")


ITEMS = {
    "block_min_max": (min_max, f"SELECT CAST((rn - 1) // {ROWS} AS BIGINT) AS block, count(*) AS n, min(user_id) AS low, max(user_id) AS high, count(DISTINCT user_id) AS kinds FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS rn FROM events) GROUP BY 1"),
    "prune_min_max": _pruned(_items, ("between", "l_orderkey", 100, 400), [], ["l_orderkey"], ["l_orderkey", "l_linenumber"], "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey BETWEEN 100 AND 400"),
    "prune_cluster": _pruned(_items, ("in", "l_partkey", [5, 17]), ["cluster_l"], ["l_partkey"], ["l_orderkey", "l_partkey"], "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey IN (5, 17)"),
    "prune_cluster_s": _pruned(_items, ("<", "l_orderkey", 70.5), ["cluster_s", "cluster_m"], ["l_orderkey"], ["l_orderkey", "l_partkey"], "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey < 70.5"),
    "prune_dictionary": _pruned(_items, ("and", ("=", "flag", "R"), ("<", "l_suppkey", 3)), ["dictionary"], ["flag", "l_suppkey"], ["l_orderkey", "flag", "l_suppkey"], "SELECT l_orderkey, l_returnflag AS flag, l_suppkey FROM lineitem WHERE l_quantity < 45 AND l_returnflag = 'R' AND l_suppkey < 3"),
    "prune_bloom": _pruned(_events, ("=", "user_id", 77), ["bloom_m"], ["user_id"], ["event_id"], "SELECT event_id FROM events WHERE user_id = 77"),
    "prune_bloom_k2": _pruned(_events, ("or", ("=", "user_id", 5), ("=", "event_type", "purchase")), ["bloom_k2"], ["user_id", "event_type"], ["event_id"], "SELECT event_id FROM events WHERE user_id = 5 OR event_type = 'purchase'"),
    "prune_occupancy": _pruned(_items, ("between", "l_extendedprice", 5000.0, 5010.0), ["occupancy_l"], ["l_extendedprice"], ["l_orderkey", "l_extendedprice"], "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_extendedprice BETWEEN 5000.0 AND 5010.0"),
    "prune_times": (_pruned_ntz, "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-03 12:00:00'"),
    "prune_nullspace": _pruned(_items, ("=", "l_partkey", 33), ["nullspace"], ["l_partkey"], ["l_orderkey", "l_linenumber"], "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = 33"),
    "prune_nullspace_s": _pruned(_items, ("in", "l_partkey", [33, 34]), ["nullspace_s"], ["l_partkey"], ["l_orderkey", "l_linenumber"], "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (33, 34)"),
    "prune_nullspace3": _pruned(_items, ("=", "l_partkey", 35), ["nullspace3_m"], ["l_partkey"], ["l_orderkey", "l_linenumber"], "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = 35"),
    "prune_nulls": _pruned(_items, ("or", ("is null", "flag"), ("not distinct", "l_partkey", 9)), ["dictionary"], ["flag", "l_partkey"], ["l_orderkey", "l_linenumber"], "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 45 OR l_partkey = 9"),
    "prune_ngrams": _pruned(_pages, ("contains", "url", "example.net/en/7"), ["ngram_s"], ["url"], ["page_id"], "SELECT page_id FROM pages WHERE contains(url, 'example.net/en/7')"),
    "prune_reads_fewer_rows": (scans_less, "SELECT count(*) AS n, true AS fewer FROM lineitem WHERE l_orderkey BETWEEN 100 AND 400"),
    "scanned_points": (_report(POINTS, ["user_id"], ["dictionary_l"]), _left(["list_contains(users, 77)", "list_contains(users, 5) OR list_contains(users, 91)", "false", "false", "false"])),
    "scanned_spans": (_report(SPANS, ["event_id"], []), _left(["low <= 2500 AND high >= 100", "low <= 3000", "false", "true", "false"])),
    "assigned_greedy_simple": _assigned("greedy_simple"),
    "assigned_greedy": _assigned("greedy"),
    "assigned_exact": _assigned("exact"),
    "assigned_priced": _assigned("priced"),
    "assigners_keep_budget": (_budget, "SELECT * FROM (VALUES ('greedy_simple', true), ('greedy', true), ('exact', true), ('priced', true)) AS t(assigner, fits)"),
    "workload_sorted": (_generated, f"SELECT {workload.LOW} + CAST(floor(range * {(workload.HIGH - workload.LOW) / 50_000!r}) AS BIGINT) AS time, range // 8192 AS block FROM range(50000)"),
}
