"""Tables, views and schemas of the catalog; inserts; results as Arrow and as batches; system functions."""

from __future__ import annotations

import uuid
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions import fn
from tarnlake.plans.text import same
from tarnlake.session import register, scratch_path, table
from tarnlake.sources import io, statements, trees


def create_table_as(spark: SparkSession, d: str) -> DataFrame:
    """CREATE TABLE AS, then INSERT with a column missing, into files of the shared folder."""
    path = scratch_path(spark, "made")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    n.filter("n_nationkey < 10").write.parquet(path)
    n.filter("n_nationkey >= 20").withColumn("n_name", F.lit(None).cast("string")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def altered(spark: SparkSession, d: str) -> DataFrame:
    """ADD, RENAME and DROP COLUMN, and a change of type, as projections."""
    n = table(spark, d, "nation")
    return n.withColumn("added", F.lit(7)).withColumnRenamed("n_name", "label").drop("n_regionkey").withColumn("n_nationkey", F.col("n_nationkey").cast("string"))


def view_of_view(spark: SparkSession, d: str) -> DataFrame:
    register(spark, d, "orders")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW tarnlake_big AS SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW tarnlake_counts AS SELECT o_custkey, count(*) AS n FROM tarnlake_big GROUP BY o_custkey")
    return spark.sql("SELECT * FROM tarnlake_counts WHERE n > 1")


def through_arrow(spark: SparkSession, d: str) -> DataFrame:
    """A small result as Arrow, and back."""
    return io.read_arrow(spark, table(spark, d, "region").select("r_regionkey", "r_name").toArrow())


def described(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "supplier")
    return spark.createDataFrame([(f.name, i) for i, f in enumerate(df.schema.fields)], "column_name string, place int")


def cached_cte(spark: SparkSession, d: str) -> DataFrame:
    """A materialised common table, read twice: one exchange, reused."""
    t = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max("l_extendedprice").alias("top"))
    return t.alias("a").join(t.alias("b"), F.col("a.l_suppkey") == F.col("b.l_suppkey")).select(F.col("a.l_suppkey").alias("k"), F.col("b.top").alias("top"))


def more_dates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    at = F.col("o_orderdate")
    return o.select("o_orderkey", (at + fn.to_months(F.lit(2))).cast("timestamp_ntz").alias("m"), (at + fn.to_weeks(F.lit(3))).cast("timestamp_ntz").alias("w"), (at - fn.to_hours(F.lit(5))).cast("timestamp_ntz").alias("h"), F.make_timestamp_ntz(F.year(at), F.month(at), F.lit(1), F.lit(2), F.lit(3), F.lit(4)).alias("mk"), fn.epoch(at).alias("e"))


def _jdoc():
    return F.concat(F.lit('{"id":'), F.col("n_nationkey").cast("string"), F.lit(',"tags":["x",-2,1.5,null],"in":{"k":true,"name":"'), F.col("n_name"), F.lit('"}}'))


JDOC = """('{"id":' || n_nationkey || ',"tags":["x",-2,1.5,null],"in":{"k":true,"name":"' || n_name || '"}}')"""


def each(spark: SparkSession, d: str) -> DataFrame:
    return trees.json_each(table(spark, d, "nation").select("n_nationkey", _jdoc().alias("doc")), "doc").drop("doc")


def each_at(spark: SparkSession, d: str) -> DataFrame:
    return trees.json_each(table(spark, d, "nation").select("n_nationkey", _jdoc().alias("doc")), "doc", "$.tags").drop("doc")


def tree(spark: SparkSession, d: str) -> DataFrame:
    return trees.json_tree(table(spark, d, "nation").select("n_nationkey", _jdoc().alias("doc")), "doc").select("n_nationkey", "key", "type", "fullkey")


def variants(spark: SparkSession, d: str) -> DataFrame:
    v = F.parse_json(_jdoc())
    return table(spark, d, "nation").select("n_nationkey", fn.variant_typeof(fn.variant_extract(v, "tags")).alias("t"), F.variant_get(fn.variant_extract(fn.variant_extract(v, "tags"), 2), "$", "int").alias("e"), fn.variant_typeof(fn.variant_extract(v, "none")).alias("n"))


def structs(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    x, y = F.struct(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b")), F.struct(F.col("n_name").alias("c"))
    made = fn.struct_concat((x, ["a", "b"]), (y, ["c"]))
    remapped = fn.remap_struct(x, {"key": ("a", 0), "more": (None, 7)})
    return n.select("n_nationkey", made.getField("c").alias("c"), fn.struct_position(x, 1, ["a", "b"]).alias("p"), fn.struct_contains(x, 3, ["a", "b"]).alias("h"), remapped.getField("key").alias("k"), remapped.getField("more").alias("m"))


def misc(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    at = F.lit("0190163d-8694-739b-aea5-966c26f8ad90")
    return n.select(
        "n_nationkey", fn.strpos("n_name", "_1").alias("sp"), fn.array_slice("n_name", 2, 4).alias("sl"), fn.array_slice("n_name", -3, -1).alias("se"), fn.formatReadableDecimalSize(F.col("n_nationkey").cast("long") * 54321).alias("ds"),
        F.size(fn.string_to_array("n_name", "_")).cast("long").alias("ar"), fn.constant_or_null(F.lit("x"), F.nullif(F.col("n_regionkey"), F.lit(2))).alias("cn"), fn.uuid_extract_version(at).alias("uv"), F.length(fn.uuidv7()).cast("long").alias("ul"), fn.uuid_extract_version(fn.uuidv7()).alias("u7"),
    )


def split_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", fn.regexp_split_to_table("n_name", "[_1]").alias("part"))


def footers(spark: SparkSession, d: str) -> DataFrame:
    """Rows, values, nulls, and the least and largest key, from the footers alone."""
    m = trees.parquet_metadata(spark, f"{d}/orders.parquet").filter("path_in_schema = 'o_orderkey'")
    return m.agg(F.sum("row_group_num_rows").alias("n"), F.sum("num_values").alias("v"), F.min(F.col("stats_min").cast("long")).alias("a"), F.max(F.col("stats_max").cast("long")).alias("z"), F.coalesce(F.sum("stats_null_count"), F.lit(0)).alias("nulls"))


def file_footers(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "footers")
    table(spark, d, "orders").select("o_orderkey").repartition(3).write.parquet(path)
    f, kv = trees.parquet_file_metadata(spark, path), trees.parquet_kv_metadata(spark, path)
    return f.agg(F.sum("num_rows").alias("n"), F.count("*").alias("files")).crossJoin(kv.filter("key LIKE '%row.metadata'").agg(F.count("*").alias("schemas")))


def all_types(spark: SparkSession, d: str) -> DataFrame:
    return trees.test_all_types(spark).select("boolean", "tinyint", "smallint", "int", "bigint", "double", "date")


def schemas(spark: SparkSession, d: str) -> DataFrame:
    """CREATE SCHEMA, CREATE TABLE AS in it, INSERT, ANALYZE, and DROP of all; what the statistics said of the rows."""
    name = f"tarnlake_{uuid.uuid4().hex[:8]}"
    statements.create_schema(spark, name, replace=True)
    try:
        table(spark, d, "region").select("r_regionkey", "r_name").write.option("path", scratch_path(spark, "catalog")).saveAsTable(f"{name}.made")
        spark.sql(f"INSERT INTO {name}.made VALUES (99, 'NOWHERE')")
        said = statements.analyze(spark, f"{name}.made").filter("name = 'Statistics'").first()["value"]
        columns = [r.column_name for r in io.columns(spark, f"{name}.made").collect()]
        listed = [t.name for t in spark.catalog.listTables(name) if not t.isTemporary]
    finally:
        statements.drop(spark, "SCHEMA", name, cascade=True)
    there = any(x.name == name for x in spark.catalog.listDatabases())
    return spark.createDataFrame([(int(said.split(", ")[1].split()[0]), ",".join(columns), ",".join(listed), there)], "n long, columns string, tables string, there boolean")


def options(spark: SparkSession, d: str) -> DataFrame:
    """SET and RESET of a setting, by what the session says of it."""
    key, held = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    statements.set_option(spark, "tarnlake.option", 7)
    one = spark.conf.get("tarnlake.option")
    statements.reset(spark, "tarnlake.option")
    return spark.createDataFrame([(one, spark.conf.get("tarnlake.option", "none"), spark.conf.get(key) == held)], "set string, reset string, others boolean")


def streamed_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first rows of an ordered result as they are streamed, and back."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey")
    return spark.createDataFrame(list(islice(statements.streamed(o), 20)), o.schema)


def analyzed(spark: SparkSession, d: str) -> DataFrame:
    """The rows that the scan and the filter of a query put out."""
    df = table(spark, d, "lineitem").filter("l_quantity < 10 AND l_tax > 0.02").select("l_orderkey")
    got = statements.explain_analyze(df)
    return got.groupBy().agg(F.max(F.when(F.col("operator") == "Filter", F.col("n_rows"))).alias("filtered"))


def exported(spark: SparkSession, d: str) -> DataFrame:
    """EXPORT of a schema to files and IMPORT into another; the rows of the copy."""
    a, b = (f"tarnlake_{uuid.uuid4().hex[:8]}" for _ in range(2))
    path = scratch_path(spark, "export")
    for s in (a, b):
        statements.create_schema(spark, s)
    try:
        table(spark, d, "nation").select("n_nationkey", "n_name").write.option("path", scratch_path(spark, "catalog")).saveAsTable(f"{a}.made")
        names = io.export_database(spark, path, a)
        for t in names:
            spark.read.parquet(f"{path}/{t}").write.option("path", scratch_path(spark, "catalog")).saveAsTable(f"{b}.{t}")
        rows = spark.table(f"{b}.made").collect()
    finally:
        for s in (a, b):
            statements.drop(spark, "SCHEMA", s, cascade=True)
    return spark.createDataFrame([tuple(r) for r in rows], "n_nationkey int, n_name string")


def ordered_by_all(spark: SparkSession, d: str) -> DataFrame:
    from tarnlake.operators.rows import order_by_all

    x = order_by_all(table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", "o_orderkey")).limit(50)
    return x


def sorted_table(spark: SparkSession, d: str) -> DataFrame:
    """A whole table in an order of several keys, with each row's place, as the sort gives it."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey").limit(2000)
    return x


def bucketed_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """An aggregate by the key that a table is bucketed on: each task has whole groups, and nothing is exchanged."""
    name = f"tarnlake_{uuid.uuid4().hex[:8]}"
    x = table(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_linenumber")
    x.write.bucketBy(8, "l_suppkey").sortBy("l_suppkey").option("path", scratch_path(spark, "buckets")).saveAsTable(name)
    out = spark.table(name).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("s"))
    if "Exchange" in statements.plan_text(out, "simple"):
        raise AssertionError("an aggregate by the bucketing key was exchanged")
    return out


ITEMS = {
    "bucketed_aggregate": (bucketed_aggregate, "SELECT l_suppkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_suppkey"),
    "json_each": (each, f"SELECT n_nationkey, e.key, CAST(e.value AS VARCHAR) AS value, e.type FROM nation, json_each({JDOC}) e"),
    "json_each_path": (each_at, f"SELECT n_nationkey, e.key, CAST(e.value AS VARCHAR) AS value, e.type FROM nation, json_each({JDOC}, '$.tags') e"),
    "json_tree": (tree, f"SELECT n_nationkey, e.key, e.type, e.fullkey FROM nation, json_tree({JDOC}) e"),
    "fn_variants": (variants, "SELECT n_nationkey, 'ARRAY' AS t, -2 AS e, CAST(NULL AS VARCHAR) AS n FROM nation"),
    "fn_structs": (structs, "SELECT n_nationkey, n_name AS c, CASE WHEN n_nationkey = 1 THEN 1 WHEN n_regionkey = 1 THEN 2 END AS p, n_nationkey = 3 OR n_regionkey = 3 AS h, n_nationkey AS k, 7 AS m FROM nation"),
    "fn_misc": (misc, "SELECT n_nationkey, CAST(strpos(n_name, '_1') AS INT) AS sp, array_slice(n_name, 2, 4) AS sl, n_name[-3:] AS se, formatReadableDecimalSize(CAST(n_nationkey AS BIGINT) * 54321) AS ds, len(string_to_array(n_name, '_')) AS ar, CASE WHEN n_regionkey <> 2 THEN 'x' END AS cn, 7 AS uv, 36 AS ul, 7 AS u7 FROM nation"),
    "split_to_table": (split_rows, "SELECT n_nationkey, unnest(regexp_split_to_array(n_name, '[_1]')) AS part FROM nation"),
    "parquet_metadata": (footers, "SELECT count(*) AS n, count(*) AS v, min(o_orderkey) AS a, max(o_orderkey) AS z, 0 AS nulls FROM orders"),
    "parquet_file_metadata": (file_footers, "SELECT count(*) AS n, 3 AS files, 3 AS schemas FROM orders"),
    "all_types": (all_types, "SELECT * FROM (VALUES (false, CAST(-128 AS TINYINT), CAST(-32768 AS SMALLINT), CAST(-2147483648 AS INT), CAST(-9223372036854775808 AS BIGINT), CAST('-1.7976931348623157E308' AS DOUBLE), DATE '0001-01-01'), (true, 127, 32767, 2147483647, 9223372036854775807, CAST('1.7976931348623157E308' AS DOUBLE), DATE '9999-12-31'), (NULL, NULL, NULL, NULL, NULL, NULL, NULL)) AS t(boolean, tinyint, smallint, int, bigint, double, date)"),
    "schema_statements": (schemas, "SELECT count(*) + 1 AS n, 'r_regionkey,r_name' AS columns, 'made' AS tables, false AS there FROM region"),
    "set_and_reset": (options, "SELECT '7' AS set, 'none' AS reset, true AS others"),
    "streamed_result": (streamed_rows, "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 20"),
    "explain_analyze": (analyzed, "SELECT count(*) AS filtered FROM lineitem WHERE l_quantity < 10 AND l_tax > 0.02"),
    "export_import": (exported, "SELECT n_nationkey, n_name FROM nation"),
    "order_by_all": (ordered_by_all, "SELECT o_orderstatus, o_orderpriority, o_orderkey FROM orders ORDER BY ALL LIMIT 50"),
    "sort_keys": (sorted_table, "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 2000"),
    "create_table_as": (create_table_as, "SELECT n_nationkey, CASE WHEN n_nationkey < 10 THEN n_name END AS n_name FROM nation WHERE n_nationkey < 10 OR n_nationkey >= 20"),
    "alter_columns": (altered, "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name AS label, 7 AS added FROM nation"),
    "view_of_view": (view_of_view, "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY o_custkey HAVING count(*) > 1"),
    "arrow_result": (through_arrow, "SELECT r_regionkey, r_name FROM region"),
    "describe": (described, "SELECT * FROM (VALUES ('s_suppkey', 0), ('s_name', 1), ('s_nationkey', 2), ('s_acctbal', 3)) AS t(column_name, place)"),
    "cte_reused": (cached_cte, "SELECT l_suppkey AS k, max(l_extendedprice) AS top FROM lineitem GROUP BY l_suppkey"),
    "fn_intervals": (more_dates, "SELECT o_orderkey, o_orderdate + INTERVAL 2 MONTH AS m, o_orderdate + INTERVAL 21 DAY AS w, o_orderdate - INTERVAL 5 HOUR AS h, make_timestamp(year(o_orderdate), month(o_orderdate), 1, 2, 3, 4) AS mk, epoch(o_orderdate) AS e FROM orders"),
    "tpch_q04": same("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-07-01' AND o_orderdate < TIMESTAMP '1996-10-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority"),
    "tpch_q07": same("""SELECT n1.n_name AS a, n2.n_name AS b, year(l_shipdate) AS y, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS rev FROM supplier, lineitem, orders, customer, nation n1, nation n2
        WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND n1.n_nationkey < 3 AND n2.n_nationkey < 3 GROUP BY n1.n_name, n2.n_name, year(l_shipdate)"""),
    "tpch_q13": same("SELECT c_count, count(*) AS n FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) t GROUP BY c_count"),
    "tpch_q15": same("""WITH rev AS (SELECT l_suppkey AS k, sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS t FROM lineitem GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, CAST(t AS DOUBLE) AS t FROM supplier, rev WHERE s_suppkey = k AND t = (SELECT max(t) FROM rev)"""),
    "tpch_q17": same("SELECT round(sum(l_extendedprice) / 7.0, 2) AS y FROM lineitem, part WHERE p_partkey = l_partkey AND p_size < 10 AND l_quantity < (SELECT 0.2 * avg(l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)"),
    "tpch_q19": same("SELECT CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS rev FROM lineitem, part WHERE p_partkey = l_partkey AND ((p_size BETWEEN 1 AND 5 AND l_quantity BETWEEN 1 AND 11) OR (p_size BETWEEN 10 AND 15 AND l_quantity BETWEEN 20 AND 30))"),
    "tpch_q21": same("""SELECT s_name, count(*) AS n FROM supplier, lineitem l1, orders WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F'
        AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
        AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R') GROUP BY s_name"""),
}
