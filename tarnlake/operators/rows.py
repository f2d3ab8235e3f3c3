"""Row operators: percentage limits, samples, changes to tables, keyed recursion."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.operators.joins import numbered


def limit_percent(df: DataFrame, percent: float, *order: Column) -> DataFrame:
    """The first percent of the rows in an order, by row numbers over a range-partitioned table: no task holds them all."""
    rows = numbered(df, "__tl_n", *order)
    return rows.filter(F.col("__tl_n") < math.floor(rows.count() * percent / 100)).drop("__tl_n")


def reservoir_sample(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows (all, if fewer), each set alike likely: the n smallest of random keys, kept by a bounded heap."""
    return df.withColumn("__r", F.rand(seed)).orderBy("__r").limit(n).drop("__r")


def bernoulli_sample(df: DataFrame, percent: float, seed: int = 0) -> DataFrame:
    return df.sample(withReplacement=False, fraction=percent / 100, seed=seed)


def n_extremes(df: DataFrame, group: list[str], value: str, n: int, name: str, largest: bool = False) -> DataFrame:
    """The n smallest (or largest) values of each group as a list, best first, nulls left out. Each task keeps n of a group
    before the shuffle and no more are ever gathered, where fn.min_n gathers the group."""
    order = F.col(value).desc() if largest else F.col(value).asc()
    w = Window.partitionBy(*group).orderBy(order)
    top = df.filter(F.col(value).isNotNull()).select(*group, value).withColumn("__tl_n", F.row_number().over(w)).filter(F.col("__tl_n") <= n)
    return top.groupBy(*group).agg(F.sort_array(F.collect_list(value), not largest).alias(name))


def quantile_disc(df: DataFrame, group: list[str], value: str, q: float, name: str) -> DataFrame:
    """The smallest value of each group with at least a share q of its values up to it: by counts of distinct values, whose
    running sum is a window over them and not over all rows."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).count()
    upto = F.sum("count").over(Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("count").over(Window.partitionBy(*group))
    x = counts.withColumn("__tl_at", upto).withColumn("__tl_all", total)
    return x.filter(F.col("__tl_at") >= F.greatest(F.ceil(F.col("__tl_all") * q), F.lit(1))).groupBy(*group).agg(F.min(value).alias(name))


def system_sample(df: DataFrame, percent: float, seed: int = 0, rows: int = 2048) -> DataFrame:
    """Whole runs of `rows` rows as the scan gives them, each kept with the given chance."""
    at = F.monotonically_increasing_id()
    run = F.struct(F.shiftright(at, 33), F.floor(at.bitwiseAND((1 << 33) - 1) / rows))
    return df.withColumn("__tl_run", F.xxhash64(run, F.lit(seed))).filter(F.pmod("__tl_run", F.lit(1_000_000)) < int(percent * 10_000)).drop("__tl_run")


def bucket_sample(df: DataFrame, percent: float, *keys: str) -> DataFrame:
    """A sample that any engine repeats: rows whose crc32 of the keys' text is below the share."""
    text = F.concat_ws("|", *(F.col(k).cast("string") for k in keys))
    return df.filter(F.crc32(text) < int(percent / 100 * (1 << 32)))


def order_by_all(df: DataFrame, descending: bool = False) -> DataFrame:
    """ORDER BY ALL: by every column, left to right, nulls last."""
    return df.orderBy(*((F.col(f"`{c}`").desc_nulls_last() if descending else F.col(f"`{c}`").asc_nulls_last()) for c in df.columns))


def update(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Rows where the condition holds (not where it is null), with new values; a rewrite in one narrow pass."""
    hit = F.coalesce(where, F.lit(False))
    return df.select(*(F.when(hit, values[c].cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns))


def update_returning(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """RETURNING of update: the rows that the condition holds for, with their new values."""
    return update(df.filter(F.coalesce(where, F.lit(False))), F.lit(True), **values)


def delete(df: DataFrame, where: Column) -> DataFrame:
    return df.filter(~F.coalesce(where, F.lit(False)))


def delete_returning(df: DataFrame, where: Column) -> DataFrame:
    """RETURNING of delete: the rows that go."""
    return df.filter(F.coalesce(where, F.lit(False)))


def insert_returning(target: DataFrame, source: DataFrame) -> DataFrame:
    """RETURNING of an insert: the rows of source in target's columns (by name; columns that source lacks are null) and types."""
    have = set(source.columns)
    return source.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema.fields))


def upsert(target: DataFrame, source: DataFrame, keys: list[str], do_nothing: bool = False, merge: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT: rows of source are added; on equal keys the old row stays (do_nothing), or takes the new
    values, or those of merge (functions of old and new). One full join on the keys; source keys must be unique."""
    s = source.select(*(F.col(c).alias(f"__new_{c}") for c in target.columns), F.lit(True).alias("__in"))
    t = target.withColumn("__out", F.lit(True))
    on = [F.col(k).eqNullSafe(F.col(f"__new_{k}")) for k in keys]
    x = t.join(s, on, "full")
    both = F.col("__in").isNotNull() & F.col("__out").isNotNull()

    def value(c: str) -> Column:
        new = F.col(c) if do_nothing or c in keys else merge[c](F.col(c), F.col(f"__new_{c}")) if merge and c in merge else F.col(c) if merge else F.col(f"__new_{c}")
        return F.when(both, new).when(F.col("__in").isNotNull(), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c)

    return x.select(*map(value, target.columns))


ACTION = "merge_action"


def merge(target: DataFrame, source: DataFrame, keys: list[str], clauses: list[tuple], returning: bool = False) -> DataFrame:
    """MERGE INTO target USING source ON equal keys, with any number of clauses, of which a row takes the first that holds.

    A clause is (case, condition or None, action): case is "matched", "not matched" (rows of source alone) or "not matched
    by source" (rows of target alone); action is a dict of new values by column, "insert" (source's columns by
    name), "delete", "nothing" or "error". Columns of source are named s_<column> in conditions and values. A row of
    target that two rows of source match is an error, as in SQL, if an action would change it; null keys match nothing.
    Rows that no clause takes stay (target's) or are left out (source's). returning: only the rows that were changed,
    with merge_action INSERT, UPDATE or DELETE. One full join on the keys.
    """
    times = F.count("*").over(Window.partitionBy(*keys))
    s = source.withColumn("__tl_times", times).select(*(F.col(c).alias(f"s_{c}") for c in source.columns), "__tl_times", F.lit(True).alias("__tl_in"))
    x = target.withColumn("__tl_out", F.lit(True)).join(s, [F.col(k) == F.col(f"s_{k}") for k in keys], "full")
    there, here = F.col("__tl_in").isNotNull(), F.col("__tl_out").isNotNull()
    is_case = {"matched": there & here, "not matched": there & ~here, "not matched by source": ~there & here}
    which = F.lit(None).cast("int")
    for i, (case, cond, _) in reversed(list(enumerate(clauses))):
        which = F.when(is_case[case] & F.coalesce(F.lit(True) if cond is None else cond, F.lit(False)), F.lit(i)).otherwise(which)
    x = x.withColumn("__tl_which", which)
    twice = F.raise_error(F.lit("MERGE: a row of the target matches several rows of the source"))
    stop = F.raise_error(F.lit("MERGE: a row reached a clause that is an error"))
    said = F.when(here, F.lit("KEEP")).otherwise("SKIP")
    for i, (case, _, act) in enumerate(clauses):
        what = {"delete": F.lit("DELETE"), "nothing": F.when(here, F.lit("KEEP")).otherwise("SKIP"), "error": stop.cast("string")}.get(act if isinstance(act, str) else "", F.lit("INSERT" if case == "not matched" else "UPDATE"))
        if case == "matched" and act != "nothing":
            what = F.when(F.col("__tl_times") > 1, twice.cast("string")).otherwise(what)
        said = F.when(F.col("__tl_which") == i, what).otherwise(said)
    x = x.withColumn(ACTION, said).filter(F.col(ACTION) != "SKIP")

    def value(c: str) -> Column:
        t = target.schema[c].dataType
        given = F.col(f"s_{c}").cast(t) if c in source.columns else F.lit(None).cast(t)
        out = F.col(c)
        for i, (case, _, act) in enumerate(clauses):
            new = (act[c] if c in act else given if case == "not matched" and c in keys else F.lit(None) if case == "not matched" else F.col(c)) if isinstance(act, dict) else given if act == "insert" else F.col(c)
            out = F.when(F.col("__tl_which") == i, new.cast(t)).otherwise(out)
        return out.alias(c)

    if returning:
        return x.filter(F.col(ACTION).isin("INSERT", "UPDATE", "DELETE")).select(*map(value, target.columns), ACTION)
    return x.filter(F.col(ACTION) != "DELETE").select(*map(value, target.columns))


def merge_into(target: DataFrame, source: DataFrame, keys: list[str], matched: dict[str, Column] | None = None, delete_when: Column | None = None, insert: bool = True) -> DataFrame:
    """MERGE of the usual three clauses: matched rows go where delete_when holds, or get new values; others are inserted."""
    clauses: list[tuple] = [] if delete_when is None else [("matched", delete_when, "delete")]
    clauses += [("matched", None, matched)] if matched else []
    return merge(target, source, keys, clauses + ([("not matched", None, "insert")] if insert else []))


def iterate_keyed(start: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], keys: list[str], better: str, rounds: int = 100) -> DataFrame:
    """Recursion USING KEY: each round's rows (step of all rows so far, and of the last round's) replace those of
    their key if `better` is smaller. Ends when a round changes nothing; rounds are checkpointed."""
    have = start.groupBy(*keys).agg(F.min(better).alias(better)).checkpoint()
    fresh = have
    for _ in range(rounds):
        new = step(have, fresh).groupBy(*keys).agg(F.min(better).alias("__new"))
        old = have.withColumnRenamed(better, "__old")
        changed = new.join(old, keys, "left").filter("__old IS NULL OR __new < __old").select(*keys, F.col("__new").alias(better)).checkpoint()
        if changed.isEmpty():
            return have
        have = have.unionByName(changed).groupBy(*keys).agg(F.min(better).alias(better)).checkpoint()
        fresh = changed
    raise RuntimeError(f"no end after {rounds} rounds")
