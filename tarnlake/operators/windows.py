"""Window forms that Spark's frames lack: linear fill, GROUPS frames, EXCLUDE, a percentage limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill(value: str, key: str, partition: list[str]) -> Column:
    """Nulls of value by linear interpolation over key; at the ends, extrapolated from the two nearest known.

    Rows with a null key, and partitions with a single known value beyond it, keep what is known: with one known
    value all nulls take it.
    """
    w = Window.partitionBy(*partition).orderBy(F.col(key).asc_nulls_last())
    back = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull() & F.col(key).isNotNull(), F.struct(F.col(key).cast("double").alias("k"), F.col(value).cast("double").alias("v")))
    last, nxt = F.last(known, True).over(back), F.first(known, True).over(ahead)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turned = Window.partitionBy(*partition).orderBy(F.col(key).desc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = F.col(key).cast("double")
    line = lambda a, b: F.when(a["k"] == b["k"], a["v"]).otherwise(a["v"] + (x - a["k"]) * (b["v"] - a["v"]) / F.nullif(b["k"] - a["k"], F.lit(0.0)))
    # the two nearest known at either end (with one known, that one twice), each by a window that skips nulls
    first, end = F.first(known, True).over(whole), F.first(known, True).over(turned)
    second, before_end = (F.coalesce(F.nth_value(known, 2, True).over(o), one) for o, one in ((whole, first), (turned, end)))
    filled = F.when(first.isNull(), F.lit(None)).when(last.isNotNull() & nxt.isNotNull(), line(last, nxt)).when(last.isNull(), line(first, second)).otherwise(line(before_end, end))
    return F.when(F.col(value).isNotNull() | F.col(key).isNull(), F.col(value).cast("double")).otherwise(filled)


def groups_frame(df: DataFrame, agg, partition: list[str], order: list[Column], before: int, after: int, name: str) -> DataFrame:
    """agg (a function of a window) over GROUPS BETWEEN before PRECEDING AND after FOLLOWING: RANGE over dense ranks."""
    w = Window.partitionBy(*partition).orderBy(*order)
    x = df.withColumn("__g", F.dense_rank().over(w))
    frame = Window.partitionBy(*partition).orderBy("__g").rangeBetween(-before, after)
    return x.withColumn(name, agg(frame)).drop("__g")


def sum_excluding(df: DataFrame, value: str, partition: list[str], order: list[Column], what: str, name: str) -> DataFrame:
    """sum(value) over the whole partition with EXCLUDE CURRENT ROW, GROUP or TIES. Null where nothing is left."""
    peers = Window.partitionBy(*partition, *order)
    every = Window.partitionBy(*partition)
    total, n = F.sum(value).over(every), F.count(value).over(every)
    own, one = F.coalesce(F.col(value), F.lit(0)), F.col(value).isNotNull().cast("long")
    group, m = F.coalesce(F.sum(value).over(peers), F.lit(0)), F.count(value).over(peers)
    minus, less = {"current row": (own, one), "group": (group, m), "ties": (group - own, m - one)}[what]
    return df.withColumn(name, F.when(n - less > 0, total - minus))


def running_excluding_current(df: DataFrame, agg, partition: list[str], order: list[Column], name: str) -> DataFrame:
    """agg over ROWS UNBOUNDED PRECEDING EXCLUDE CURRENT ROW: the frame ends a row before."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, agg(w))


def excluding(df: DataFrame, agg: str, value: str, partition: list[str], order: list[Column], what: str, name: str, before: int | None = None, after: int | None = None) -> DataFrame:
    """agg (sum, count, avg, min or max) of value over ROWS BETWEEN before PRECEDING AND after FOLLOWING with EXCLUDE
    CURRENT ROW, GROUP or TIES. None is unbounded; a frame is bounded at both ends, or unbounded before and then either
    unbounded after or ending at the current row (after = 0). Null (for count 0) where nothing is left.

    Peers lie together in the order. So an unbounded frame without them is what lies before the first and after the
    last, two running aggregates that the peers share; a bounded frame is short, and its rows are looked through.
    """
    low, high = Window.unboundedPreceding, Window.unboundedFollowing
    x = df.withColumn("__tl_at", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
    peers = Window.partitionBy(*partition, *order)
    first, last = (F.col("__tl_at"), F.col("__tl_at")) if what == "current row" else (F.min("__tl_at").over(peers), F.max("__tl_at").over(peers))
    x = x.withColumn("__tl_a", first).withColumn("__tl_z", last)
    at = Window.partitionBy(*partition).orderBy("__tl_at")
    extra = ["__tl_at", "__tl_a", "__tl_z"]
    if before is not None and after is not None:
        rows = F.collect_list(F.struct(F.col("__tl_at").alias("at"), F.col(value).alias("v"))).over(at.rowsBetween(-before, after))
        own = (lambda e: e["at"] == F.col("__tl_at")) if what == "ties" else lambda e: F.lit(False)
        x = x.withColumn("__tl_rows", F.filter(rows, lambda e: e["v"].isNotNull() & (~e["at"].between(F.col("__tl_a"), F.col("__tl_z")) | own(e))))
        values = F.transform("__tl_rows", lambda e: e["v"])
        n = F.size("__tl_rows").cast("long")
        total = F.aggregate(values, F.lit(0).cast("double" if df.schema[value].dataType.typeName() in ("float", "double") else "decimal(38,0)" if df.schema[value].dataType.typeName() == "decimal" else "long"), lambda t, v: t + v)
        got = {"sum": F.when(n > 0, total), "count": n, "avg": F.when(n > 0, total / n), "min": F.array_min(values), "max": F.array_max(values)}[agg]
        return x.withColumn(name, got).drop(*extra, "__tl_rows")
    if before is not None or after not in (None, 0):
        raise ValueError("a frame unbounded at one end begins there and ends at the current row")
    shared = Window.partitionBy(*partition, "__tl_a").orderBy("__tl_at").rowsBetween(low, high)
    made, parts = [], {}
    for k in ("sum", "count") if agg == "avg" else (agg,):
        f = getattr(F, k)
        x = x.withColumn(f"__tl_{k}_b", f(value).over(at.rowsBetween(low, -1)))
        sides = [F.first(f"__tl_{k}_b").over(shared)]
        made.append(f"__tl_{k}_b")
        if after is None:
            x = x.withColumn(f"__tl_{k}_f", f(value).over(at.rowsBetween(1, high)))
            sides.append(F.last(f"__tl_{k}_f").over(shared))
            made.append(f"__tl_{k}_f")
        if what == "ties":
            sides.append(F.col(value).isNotNull().cast("long") if k == "count" else F.col(value))
        parts[k] = sides

    def plus(sides: list[Column]) -> Column:
        some = F.coalesce(*sides).isNotNull()
        return F.when(some, sum((F.coalesce(s, F.lit(0)) for s in sides[1:]), F.coalesce(sides[0], F.lit(0))))

    def pick(f, sides: list[Column]) -> Column:
        return f(*sides) if len(sides) > 1 else sides[0]

    got = {
        "sum": lambda: plus(parts["sum"]), "count": lambda: plus(parts["count"]), "avg": lambda: plus(parts["sum"]) / F.nullif(plus(parts["count"]), F.lit(0)),
        "min": lambda: pick(F.least, parts["min"]), "max": lambda: pick(F.greatest, parts["max"]),
    }[agg]()
    return x.withColumn(name, got).drop(*extra, *made)


def distinct_over(df: DataFrame, agg: str, value: str, partition: list[str], name: str) -> DataFrame:
    """count, sum or avg of the DISTINCT values over a partition: the first row of each value in it counts."""
    new = F.row_number().over(Window.partitionBy(*partition, value).orderBy(value)) == 1
    f = getattr(F, agg)
    x = df.withColumn("__tl_new", new)
    return x.withColumn(name, f(F.when(F.col("__tl_new"), F.col(value))).over(Window.partitionBy(*partition))).drop("__tl_new")


def ordered_value(df: DataFrame, what: str, value: str, by: list[Column], partition: list[str], order: list[Column], name: str, before: int | None = None, after: int | None = 0) -> DataFrame:
    """first_value or last_value with an ORDER BY of its own, over a ROWS frame in another order: the value of the
    frame's smallest (or largest) row by `by`."""
    low, high = Window.unboundedPreceding, Window.unboundedFollowing
    w = Window.partitionBy(*partition).orderBy(*order)
    frame = w.rowsBetween(low if before is None else -before, high if after is None else after)
    x = df.withColumn("__tl_rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*by, *order)))
    f = F.min_by if what == "first" else F.max_by
    return x.withColumn(name, f(F.col(value), F.col("__tl_rank")).over(frame)).drop("__tl_rank")
