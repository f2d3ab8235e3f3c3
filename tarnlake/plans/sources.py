"""Sources and sinks as round trips, event windows, user functions and statements."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.sources import io, statements
from tarnlake.session import register, scratch_path, table
from tarnlake.streaming import windows


def _trip(format: str, name: str, cols: list[str], **options):  # noqa: A002
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = table(spark, d, name).select(*cols)
        path = scratch_path(spark, f"trip-{format}")
        io.copy_to(df, path, format, **options)
        if format == "csv":
            return io.read_csv(spark, path, ", ".join(f"`{k}` {t}" for k, t in df.dtypes)).select(*cols)
        if format == "json":
            return io.read_json(spark, path, ", ".join(f"`{k}` {t}" for k, t in df.dtypes)).select(*cols)
        if format == "orc":
            return spark.read.orc(path).select(*cols)
        return io.read_parquet(spark, path).select(*cols)

    return run, f"SELECT {', '.join(cols)} FROM {name}"


def summarize(spark: SparkSession, d: str) -> DataFrame:
    return io.summary(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")).select("column", "min", "max", "count", "null_percent")


SUMMARY = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max, count({c}) AS count, CAST(0 AS DOUBLE) AS null_percent FROM customer" for c in ("c_custkey", "c_name", "c_nationkey"))


def text_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "text")
    table(spark, d, "region").select("r_name").coalesce(1).write.text(path)
    return io.read_text(spark, f"{path}/*.txt").select(F.explode(F.split("content", "\n")).alias("r_name")).filter("r_name <> ''")


def by_name(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("a"))
    b = table(spark, d, "region").select(F.col("r_name").alias("b"), F.col("r_regionkey").alias("k"))
    return a.unionByName(b, allowMissingColumns=True)


def repeated(spark: SparkSession, d: str) -> DataFrame:
    return io.repeat_row(spark, 7, 1, "a")


def _window(f, *args):
    return lambda spark, d: f(table(spark, d, "events"), *args)


def udf_scalar(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("long")
    def digits(x: pd.Series) -> pd.Series:
        return x.map(lambda n: sum(map(int, str(n))))

    return table(spark, d, "customer").select("c_custkey", digits("c_custkey").alias("s"))


def udf_aggregate(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("long")
    def span(x: pd.Series) -> int:
        return int(x.max() - x.min())

    return table(spark, d, "supplier").groupBy("s_nationkey").agg(span("s_suppkey").alias("s"))


def udtf(spark: SparkSession, d: str) -> DataFrame:
    @F.udtf(returnType="part: string, place: int")
    class Parts:
        def eval(self, text: str):
            for i, p in enumerate(text.split("_")):
                yield p, i

    spark.udtf.register("tarnlake_parts", Parts)
    register(spark, d, "nation")
    return spark.sql("SELECT n_nationkey, p.part, p.place FROM nation, LATERAL tarnlake_parts(n_name) p")


def macro(spark: SparkSession, d: str) -> DataFrame:
    statements.scalar_macro(spark, "tarnlake_net", "p DOUBLE, q DOUBLE", "DOUBLE", "round(p * (1 - q), 4)")
    register(spark, d, "lineitem")
    return spark.sql("SELECT l_orderkey, l_linenumber, tarnlake_net(l_extendedprice, l_discount) AS net FROM lineitem")


def table_macro(spark: SparkSession, d: str) -> DataFrame:
    statements.table_macro(spark, "tarnlake_steps", "n INT", "i INT", "SELECT explode(sequence(1, n))")
    return spark.sql("SELECT i FROM tarnlake_steps(9)")


def prepared(spark: SparkSession, d: str) -> DataFrame:
    register(spark, d, "orders")
    return statements.Prepared(spark, "SELECT o_orderkey FROM orders WHERE o_custkey = :k AND o_totalprice > :p").execute(k=7, p=1000.0)


def variable(spark: SparkSession, d: str) -> DataFrame:
    register(spark, d, "nation")
    statements.set_variable(spark, "tarnlake_region", "INT", 3)
    return spark.sql("SELECT n_name FROM nation WHERE n_regionkey = tarnlake_region")


def html_titles(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host"), F.length("html").cast("long").alias("n"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.sum(F.length("text")).alias("chars"))


ITEMS = {
    "csv_round_trip": _trip("csv", "supplier", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]),
    "csv_text_round_trip": _trip("csv", "conversations", ["conv_id", "turn", "role"]),
    "parquet_hive_round_trip": _trip("parquet", "orders", ["o_orderkey", "o_custkey", "o_orderstatus"], partition_by=["o_orderstatus"]),
    "parquet_ordered_round_trip": _trip("parquet", "part", ["p_partkey", "p_name"], order=["p_partkey"], compression="zstd"),
    "json_round_trip": _trip("json", "conversations", ["conv_id", "turn", "role", "text"]),
    "orc_round_trip": _trip("orc", "nation", ["n_nationkey", "n_name", "n_regionkey"]),
    "text_files": (text_files, "SELECT r_name FROM region"),
    "summarize": (summarize, SUMMARY),
    "union_by_name": (by_name, "SELECT n_nationkey AS k, n_name AS a, NULL AS b FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region"),
    "repeat_row": (repeated, "SELECT 1 AS column0, 'a' AS column1 FROM range(7)"),
    "event_tumbling": (_window(windows.tumbling, "1 hour"), "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2"),
    "event_sliding": (_window(windows.sliding, "2 hours", "1 hour"), "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1"),
    "event_sessions": (_window(windows.sessions, "30 minutes"), """SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s
        FROM (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"""),
    "udf_scalar": (udf_scalar, "SELECT c_custkey, list_sum(list_transform(string_split(CAST(c_custkey AS VARCHAR), ''), lambda x: CAST(x AS BIGINT))) AS s FROM customer"),
    "udf_aggregate": (udf_aggregate, "SELECT s_nationkey, max(s_suppkey) - min(s_suppkey) AS s FROM supplier GROUP BY 1"),
    "udtf": (udtf, "SELECT n_nationkey, p.part, CAST(p.place AS INT) AS place FROM (SELECT n_nationkey, unnest(list_zip(string_split(n_name, '_'), range(0, len(string_split(n_name, '_'))))) AS z FROM nation), LATERAL (SELECT z[1] AS part, z[2] AS place) p"),
    "macro_scalar": (macro, "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem"),
    "macro_table": (table_macro, "SELECT CAST(range AS INT) AS i FROM range(1, 10)"),
    "prepared_statement": (prepared, "SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000"),
    "session_variable": (variable, "SELECT n_name FROM nation WHERE n_regionkey = 3"),
    "page_hosts": (html_titles, "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, length(html) AS n FROM pages"),
    "conversation_turns": (turns, "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS asked, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id"),
}
