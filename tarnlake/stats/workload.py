"""Tables and queries for measuring block statistics, all on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOW, HIGH = 1767225600000, 1769817600000  # milliseconds: the span of generated keys


def generate(spark: SparkSession, rows: int, shape: str, block: int = 8192, seed: int = 1) -> DataFrame:
    """(time, data, block): keys of LOW..HIGH that are unsorted, sorted, sorted with an outlier every 10,000 rows, of few
    values a block (cardinality), or a third of each of the first three (combined)."""
    span = HIGH - LOW
    r = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(span))
    step = LOW + F.floor(F.col("id") * F.lit(span / max(rows, 1)))
    outlier = F.when(F.col("id") % 10_000 == 9_999, LOW + r).otherwise(step)
    few = LOW + F.pmod(F.xxhash64(F.floor(F.col("id") / block), F.pmod(F.xxhash64("id"), F.lit(64))), F.lit(span))
    third = F.floor(F.col("id") * 3 / max(rows, 1))
    combined = F.when(third == 0, LOW + r).when(third == 1, step).otherwise(outlier)
    key = {"unsorted": LOW + r, "sorted": step, "outliers": outlier, "cardinality": few, "combined": combined}[shape]
    return spark.range(rows).select(key.cast("long").alias("time"), F.pmod(F.xxhash64("id", F.lit(99)), F.lit(1000)).alias("data"), F.floor(F.col("id") / block).alias("block"))


def points(df: DataFrame, col: str, n: int, seed: int = 5) -> list[tuple]:
    """n equality filters on values that the table has."""
    found = df.select(col).distinct().orderBy(F.xxhash64(F.col(col).cast("string"), F.lit(seed)), col).limit(n).collect()
    return [("=", col, r[0]) for r in found]


def ranges(df: DataFrame, col: str, n: int, share: float = 0.01) -> list[tuple]:
    """n closed ranges between quantiles of the column, each of about a share of the rows."""
    at = [i / n * (1 - share) for i in range(n)]
    q = df.approxQuantile(col, [*at, *(a + share for a in at)], 0.001)
    return [("between", col, a, b) for a, b in zip(q[:n], q[n:], strict=True)]
