"""Joins that Spark has no operator for: as-of, interval overlap, one inequality, sums over two, positional."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.session import scratch_path

SIDE, LEFT_ROW, RIGHT_ROW = "__side", "__l", "__r"


def _struct(df: DataFrame) -> Column:
    return F.struct(*(df[c] for c in df.columns))


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[tuple[str, str]] = [], op: str = ">=", how: str = "inner") -> DataFrame:  # noqa: B006
    """Each left row with the nearest right row for which `left_on op right_on` holds within equal keys.

    op is one of >=, >, <=, <. how: inner, left, semi, anti, right or full (for the last two, right rows that no
    left row took are rows too). Both sides go through one shuffle on the keys and one sort: a running last-seen right
    row takes the place of a join, so nothing is multiplied and each side is read once: rows need no ids, which would differ
    where a side is computed again and gives its rows in another order. Rows with a null key or time match nothing; of
    right rows with equal keys and time any one matches, the same for all. Output columns are those of left, then
    of right (only left for semi and anti); names must not clash.
    """
    if op not in (">=", ">", "<=", "<"):
        raise ValueError(op)
    if not by and how in ("inner", "left", "semi", "anti"):
        return _asof_by_ranges(left, right, left_on, right_on, op, how)
    keys = [f"__k{i}" for i in range(len(by))]
    dead = lambda df, cols: reduce(lambda a, b: a | b, (F.col(c).isNull() for c in cols))
    at, ends = "__at", op in (">=", "<=")
    lcols = [F.col(a).alias(k) for (a, _), k in zip(by, keys, strict=True)]
    rcols = [F.col(b).alias(k) for (_, b), k in zip(by, keys, strict=True)]
    want_rest = how in ("right", "full")
    r = right.select(*rcols, F.col(right_on).alias(at), _struct(right).alias(RIGHT_ROW))
    r = r.filter(~dead(r, [*keys, at])) if not want_rest else r
    side_of_right = 0 if ends else 1  # at equal times, before the left rows only if equality matches
    lt, rt = left.schema, right.schema
    a = left.select(*lcols, F.col(left_on).alias(at), F.lit(1 - side_of_right).alias(SIDE), _struct(left).alias(LEFT_ROW), F.lit(None).cast(rt).alias(RIGHT_ROW))
    b = r.select(*keys, at, F.lit(side_of_right).alias(SIDE), F.lit(None).cast(lt).alias(LEFT_ROW), RIGHT_ROW)
    order = F.col(at).asc() if op in (">=", ">") else F.col(at).desc()
    ordered = Window.partitionBy(*keys).orderBy(order, F.col(SIDE))
    w = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    alive = ~dead(a, [*keys, at])
    is_left = F.col(LEFT_ROW).isNotNull()
    usable = F.when(F.col(RIGHT_ROW).isNotNull() & alive, F.struct(F.col(RIGHT_ROW).alias("row")))
    met = a.unionByName(b).withColumn("__got", F.last(usable, ignorenulls=True).over(w))
    if want_rest:  # a right row is taken if the row that follows it is a left row that can match
        met = met.withColumn("__taken", alive & F.coalesce(F.lead(is_left & alive).over(ordered), F.lit(False)))
    met = met.withColumn("__got", F.when(alive, F.col("__got")))
    whole = [F.col(f"{LEFT_ROW}.`{c}`").alias(c) for c in left.columns]
    if how == "semi":
        return met.filter(is_left & F.col("__got").isNotNull()).select(*whole)
    if how == "anti":
        return met.filter(is_left & F.col("__got").isNull()).select(*whole)
    keep = is_left if how in ("left", "full") else is_left & F.col("__got").isNotNull()
    row = F.when(is_left, F.col("__got.row")).otherwise(F.col(RIGHT_ROW)) if want_rest else F.col("__got.row")
    met = met.filter(keep | ~is_left & ~F.col("__taken") if want_rest else keep)
    return met.select(*whole, *(row.getField(c).alias(c) for c in right.columns))


def _cuts(df: DataFrame, c: str, n: int) -> list:
    """Up to n values that cut a column into ranges of about as many rows each; n bounds what comes to the driver."""
    found = df.agg(F.percentile_approx(c, [k / n for k in range(1, n)], 10_000).alias("q")).first()["q"]
    return sorted(set(found or []))


def _place(cuts: list, like: DataFrame, c: str, value: Column) -> Column:
    """Which range a value lies in: how many cuts are below it."""
    at = F.array(*(F.lit(x).cast(like.schema[c].dataType) for x in cuts)) if cuts else F.array().cast("array<int>")
    return F.size(F.filter(at, lambda x: x < value)) if cuts else F.lit(0)


def _asof_by_ranges(left: DataFrame, right: DataFrame, left_on: str, right_on: str, op: str, how: str) -> DataFrame:
    """asof_join without keys: both sides by ranges of the time, each of which also gets the right row that is nearest
    before (or after) it, so that no task holds a whole side."""
    known = right.filter(F.col(right_on).isNotNull())
    cuts = _cuts(known, right_on, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    back = op in (">=", ">")
    r = known.withColumn("__tl_rr", _place(cuts, right, right_on, F.col(right_on)))
    pick = F.max_by if back else F.min_by
    edge = r.groupBy("__tl_rr").agg(pick(_struct(right), F.col(right_on)).alias("row"))
    every = left.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("range"))
    w = Window.orderBy(F.col("range") if back else F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    carried = every.join(F.broadcast(edge), every["range"] == edge["__tl_rr"], "left").select(F.last("row", ignorenulls=True).over(w).alias("row"), "range").filter("row IS NOT NULL")
    r = r.unionAll(carried.select(*(F.col(f"row.`{c}`").alias(c) for c in right.columns), F.col("range").alias("__tl_rr")))
    x = left.withColumn("__tl_lr", _place(cuts, right, right_on, F.col(left_on)))
    return asof_join(x, r, left_on, right_on, [("__tl_lr", "__tl_rr")], op, how).drop("__tl_lr", "__tl_rr")


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width: float, by: list[tuple[str, str]] = []) -> DataFrame:  # noqa: B006
    """Pairs whose closed intervals overlap: two inequalities, as an equality join on bins of `width`.

    Each interval is listed in the bins it touches; a pair is kept only in the bin where the later of both
    starts lies, so it appears once. Choose width near the usual interval length: longer intervals are listed in
    more bins, shorter bins hold fewer candidates.
    """
    bins = lambda a, b: F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))
    (la, lb), (ra, rb) = left_span, right_span
    x = left.filter(F.col(la) <= F.col(lb)).withColumn("__bin", F.explode(bins(la, lb)))
    y = right.filter(F.col(ra) <= F.col(rb)).withColumn("__rbin", F.explode(bins(ra, rb)))
    on = [F.col("__bin") == F.col("__rbin"), F.col(la) <= F.col(rb), F.col(ra) <= F.col(lb), *(F.col(a) == F.col(b) for a, b in by)]
    met = x.join(y, on).filter(F.col("__bin") == F.floor(F.greatest(la, ra) / width))
    return met.drop("__bin", "__rbin")


def within_join(left: DataFrame, right: DataFrame, value: str, span: tuple[str, str], width: float, by: list[tuple[str, str]] = []) -> DataFrame:  # noqa: B006
    """Left rows whose value lies in right intervals [a, b): only the intervals are listed in bins."""
    a, b = span
    x = left.withColumn("__bin", F.floor(F.col(value) / width))
    y = right.filter(F.col(a) < F.col(b)).withColumn("__rbin", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))))
    on = [F.col("__bin") == F.col("__rbin"), F.col(value) >= F.col(a), F.col(value) < F.col(b), *(F.col(p) == F.col(q) for p, q in by)]
    return x.join(y, on).drop("__bin", "__rbin")


HOLDS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def inequality_join(left: DataFrame, right: DataFrame, left_on: str, op: str, right_on: str, more: Column | None = None, buckets: int | None = None) -> DataFrame:
    """Pairs with left_on op right_on (op one of <, <=, >, >=) that also pass `more`, such as a second inequality.

    Values of the right side are cut into ranges at its quantiles; a row of the left is listed for the ranges that hold
    any right value it can pair with, and meets only those, so that no pair of rows in ranges apart is ever tried.
    What is left is an equality join on the range's number, which is dealt out (and split where it is skewed) like any
    other. Rows with a null value pair with nothing. Numbers, dates and timestamps; names must not clash.
    """
    if op not in HOLDS:
        raise ValueError(op)
    n = buckets or 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = right.filter(F.col(right_on).isNotNull())
    cuts = r.agg(F.percentile_approx(right_on, [k / n for k in range(n + 1)], 10_000).alias("q")).first()["q"]  # n + 1 values
    cuts = sorted(set(cuts or []))
    if not cuts:
        return left.join(right.limit(0), F.lit(False))
    at = F.array(*(F.lit(c).cast(right.schema[right_on].dataType) for c in cuts))
    # range k holds the values from cut k - 1 (exclusive) to cut k (inclusive); the last one what lies beyond
    place = lambda c: F.size(F.filter(at, lambda x: x < c))
    mine = place(F.col(left_on))
    ranges = F.sequence(mine, F.lit(len(cuts))) if op in ("<", "<=") else F.sequence(F.lit(0), mine)
    x = left.filter(F.col(left_on).isNotNull()).withColumn("__tl_range", F.explode(ranges))
    y = r.withColumn("__tl_own", place(F.col(right_on)))
    on = [F.col("__tl_range") == F.col("__tl_own"), HOLDS[op](F.col(left_on), F.col(right_on))]
    return x.join(y, on if more is None else [*on, more]).drop("__tl_range", "__tl_own")


def choose_join(left: DataFrame, right: DataFrame, equal: list[tuple[str, str]] = [], compare: list[tuple[str, str, str]] = []) -> DataFrame:  # noqa: B006
    """An inner join by what its conditions are: equalities (left column, right column) are Spark's own hash or merge
    join, with comparisons (left column, op, right column) as conditions on it; comparisons alone go to
    inequality_join, by the first, with the others as conditions; with none it is Spark's cross join."""
    residual = [HOLDS[op](F.col(a), F.col(b)) for a, op, b in compare]
    if equal:
        return left.join(right, [*(F.col(a) == F.col(b) for a, b in equal), *residual])
    if compare:
        a, op, b = compare[0]
        return inequality_join(left, right, a, op, b, reduce(lambda p, q: p & q, residual[1:]) if residual[1:] else None)
    return left.crossJoin(right)


def spread_key(df: DataFrame) -> Column:
    """A hash of a row's columns (maps and variants aside): splits rows of equal order over partitions."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if not re.search("map<|variant|calendarinterval", f.dataType.simpleString())]
    return F.xxhash64(*plain) if plain else F.lit(0)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Row numbers from 0 without a single-partition sort; the column `name` is added last.

    Rows are range-partitioned by the order (rows that it leaves equal by a hash of their columns, so that a value of
    many rows is many partitions) and written once with their partition and place in it. Counts and numbers are both
    taken from that table, so they are of the same partitions whatever is replanned or lost; rows keep the numbers
    they once got, also where the order leaves them equal.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, spread_key(df).asc()]
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    tagged = dealt.withColumn("__tl_part", F.spark_partition_id()).withColumn("__tl_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    path = scratch_path(spark, "numbered")
    tagged.write.parquet(path)
    held = spark.read.schema(tagged.schema).parquet(path)
    bases, at = [], 0
    for r in held.groupBy("__tl_part").count().orderBy("__tl_part").collect():  # a row for each partition
        bases.append((r["__tl_part"], at))
        at += r["count"]
    base = F.broadcast(spark.createDataFrame(bases, "__tl_part int, __tl_base long"))
    return held.join(base, "__tl_part").select(*(F.col(f"`{c}`") for c in df.columns if c != name), (F.col("__tl_base") + F.col("__tl_at")).alias(name))


SPAN = 1 << 17  # rows, at most, that a task sums in one run


def pair_totals(left: DataFrame, right: DataFrame, compare: list[tuple[str, str, str]], count: str, sums: dict[str, str]) -> DataFrame:
    """Right rows that pair with a left row by two comparisons (left column, op, right column), each once, with the number of
    left rows that they pair with and sums (new column: left column) over those: what a join and sums over its pairs
    give, but the pairs, which may be all of both tables, are never made.

    Rows of both sides are numbered by the first comparison and by the second, so that a left row pairs with a right row
    if both its numbers are smaller. Of two numbers the smaller has a 0 and the larger a 1 at the first bit in which they
    differ: a row is listed for those bits of its first number where it can be the one, with the bits above, and each list is one
    running sum by the second number. So n rows are about n log n / 2 in all. Lists of over SPAN rows are
    summed in spans of the second number, to which the spans before are added. Rows with a null pair with nothing;
    sums skip nulls and are null where there is no value. Names must not clash.
    """
    (la, op, ra), (lb, op2, rb) = compare
    if op not in HOLDS or op2 not in HOLDS:
        raise ValueError(compare)
    own = {f"__tl_s{k}": c for k, c in enumerate(sums.values())}
    x = left.filter(F.col(la).isNotNull() & F.col(lb).isNotNull())
    x = x.select(F.lit(0).alias("__tl_q"), F.col(la).alias("__tl_a"), F.col(lb).alias("__tl_b"), F.lit(None).cast(right.schema).alias(RIGHT_ROW), *(F.col(c).alias(s) for s, c in own.items()))
    y = right.filter(F.col(ra).isNotNull() & F.col(rb).isNotNull())
    y = y.select(F.lit(1).alias("__tl_q"), F.col(ra).alias("__tl_a"), F.col(rb).alias("__tl_b"), _struct(right).alias(RIGHT_ROW), *(F.lit(None).cast(left.schema[c].dataType).alias(s) for s, c in own.items()))
    both = x.unionByName(y)
    for c, o, to in (("__tl_a", op, "__tl_i"), ("__tl_b", op2, "__tl_j")):  # at equal values left rows are first if equal ones pair
        both = numbered(both, to, F.col(c).asc() if o[0] == "<" else F.col(c).desc(), F.col("__tl_q").asc() if o[1:] else F.col("__tl_q").desc()).drop(c)
    bits = max(1, (both.count() - 1).bit_length())
    listed = both.drop(RIGHT_ROW).withColumn("__tl_bit", F.explode(F.expr(f"filter(sequence(0, {bits - 1}), b -> (shiftright(__tl_i, b) & 1) = __tl_q)")))
    long = F.col("__tl_bit") >= SPAN.bit_length() - 1
    listed = listed.withColumn("__tl_above", F.expr("shiftright(__tl_i, __tl_bit + 1)")).withColumn("__tl_span", F.when(long, F.expr(f"__tl_j div {SPAN}")).otherwise(F.lit(0)))
    total = [F.sum(1 - F.col("__tl_q")).alias("__tl_n"), *(F.sum(s).alias(s) for s in own)]
    names = ["__tl_n", *own]
    where = ["__tl_bit", "__tl_above", "__tl_span"]
    w = Window.partitionBy(*where).orderBy("__tl_j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = listed.select("__tl_i", "__tl_q", F.sum(1 - F.col("__tl_q")).over(w).alias("__tl_n"), *(F.sum(s).over(w).alias(s) for s in own)).filter("__tl_q = 1")
    before = Window.partitionBy("__tl_bit", "__tl_above").orderBy("__tl_span").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each span
    spans = listed.filter(long).groupBy(*where).agg(*total).select(*where, *(F.sum(c).over(before).alias(c) for c in names))
    carried = listed.filter(long & (F.col("__tl_q") == 1)).select("__tl_i", *where).join(spans, where)
    got = within.select("__tl_i", *names).unionAll(carried.select("__tl_i", *names)).filter("__tl_n > 0").groupBy("__tl_i").agg(*(F.sum(c).alias(c) for c in names))
    rows = both.filter("__tl_q = 1").select("__tl_i", RIGHT_ROW).join(got, "__tl_i")
    return rows.select(*(F.col(f"{RIGHT_ROW}.`{c}`").alias(c) for c in right.columns), F.col("__tl_n").alias(count), *(F.col(s).alias(c) for s, c in zip(own, sums, strict=True)))


def positional_join(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Rows side by side in the given orders; the shorter side is filled with nulls."""
    a, b = numbered(left, "__i", *left_order), numbered(right, "__j", *right_order)  # names must not clash
    return a.join(b, F.col("__i") == F.col("__j"), "full").drop("__i", "__j")
