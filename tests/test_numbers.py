"""Row numbers and what rests on them: over many partitions, wide rows, ties, and at two settings of shuffle partitions."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tarnlake.operators import joins, rows
from tarnlake.plans import registry

D = "/root/testdata/sf0.1"


@pytest.fixture(params=["8", "200"])
def parts(spark, request):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", held)


def test_numbers_of_wide_rows(spark, parts):
    n = 200_000
    df = spark.range(0, n, 1, 24).select((F.col("id") * 7919 % n).alias("id"), F.repeat(F.md5(F.col("id").cast("string")), 8).alias("wide"), (F.col("id") % 3).alias("tie"))
    got = joins.numbered(df, "n", F.col("id"))
    assert got.agg(F.count("*"), F.countDistinct("n"), F.count_if(F.col("n") != F.col("id"))).first() == (n, n, 0)
    tied = joins.numbered(df, "n", F.col("tie"))
    r = tied.groupBy("tie").agg(F.min("n").alias("a"), F.max("n").alias("z"), F.countDistinct("n").alias("k")).orderBy("tie").collect()
    assert r[0].a == 0 and all(x.z - x.a + 1 == x.k for x in r) and [x.a for x in r[1:]] == [x.z + 1 for x in r[:-1]]


def test_ties_are_dealt_out(spark, parts):
    df = spark.range(20_000).select(F.lit(1).alias("k"), "id")
    assert joins.numbered(df, "n", F.col("k")).select(F.input_file_name().alias("f")).distinct().count() >= int(parts) // 2
    assert joins.numbered(df.limit(0), "n", F.col("k")).count() == 0


@pytest.mark.parametrize("name", ["row_numbers", "positional_join", "numbered_wide", "block_min_max", "prune_min_max", "prune_bloom", "prune_occupancy", "prune_nulls", "scanned_points", "limit_percent"])
def test_at_a_larger_size(spark, parts, name):
    con = duckdb.connect()
    for t in ("nation", "supplier", "orders", "lineitem", "events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got = registry.queries()[name](spark, D)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(cols).collect()))) == sorted(map(repr, want))


def test_percentages(spark):
    assert rows.limit_percent(spark.range(1000).repartition(7), 12.5, F.col("id").desc()).agg(F.min("id"), F.count("*")).first() == (875, 125)
