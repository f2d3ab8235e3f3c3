"""Aggregates that Spark names or defines otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALIASES = {
    "count_star": "count", "arbitrary": "first", "mean": "avg", "favg": "avg",
    "fsum": "sum", "kahan_sum": "sum", "sum_no_overflow": "sum", "quantile_cont": "percentile", "approx_quantile": "approx_percentile",
    "reservoir_quantile": "approx_percentile", "bool_and": "bool_and", "group_concat": "listagg", "kurtosis_pop": "kurtosis",
}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def list_(c) -> Column:
    """All values, nulls kept, in no order of its own."""
    return F.transform(F.collect_list(F.struct(_c(c).alias("v"))), lambda s: s["v"])


def list_ordered(c, *order) -> Column:
    """All values, nulls kept, by ascending order keys."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*(_c(o).alias(f"o{i}") for i, o in enumerate(order)), _c(c).alias("v")))), lambda s: s["v"])


def arg_min_n(c, by, n: int) -> Column:
    """Values of the n rows of smallest by; rows with a null value or key are left out."""
    rows = F.collect_list(F.when(_c(c).isNotNull() & _c(by).isNotNull(), F.struct(_c(by).alias("b"), _c(c).alias("v"))))
    return F.transform(F.slice(F.array_sort(rows), 1, n), lambda s: s["v"])


def arg_max_n(c, by, n: int) -> Column:
    rows = F.collect_list(F.when(_c(c).isNotNull() & _c(by).isNotNull(), F.struct(_c(by).alias("b"), _c(c).alias("v"))))
    return F.transform(F.slice(F.sort_array(rows, False), 1, n), lambda s: s["v"])


def arg_min(c, by) -> Column:
    """The value at the smallest key; rows with a null value or key are left out."""
    return F.min_by(_c(c), F.when(_c(c).isNotNull(), _c(by)))


def arg_max(c, by) -> Column:
    return F.max_by(_c(c), F.when(_c(c).isNotNull(), _c(by)))


def arg_min_null(c, by) -> Column:
    """The value at the smallest key, null if it is; only null keys are left out."""
    return F.min_by(_c(c), _c(by))


def arg_max_null(c, by) -> Column:
    return F.max_by(_c(c), _c(by))


def min_n(c, n: int) -> Column:
    return F.slice(F.array_sort(F.collect_list(_c(c))), 1, n)


def max_n(c, n: int) -> Column:
    return F.slice(F.sort_array(F.collect_list(_c(c)), False), 1, n)


def weighted_avg(c, w) -> Column:
    use = _c(c).isNotNull() & _c(w).isNotNull()
    return F.sum(F.when(use, _c(c) * _c(w))) / F.nullif(F.sum(F.when(use, _c(w))), F.lit(0))


def geomean(c) -> Column:
    return F.exp(F.avg(F.ln(_c(c))))


def mad(c) -> Column:
    """Median of the distances from the median."""
    values = F.collect_list(_c(c).cast("double"))
    mid = F.percentile(_c(c).cast("double"), 0.5)
    away = F.array_sort(F.transform(values, lambda v: F.abs(v - mid)))
    n = F.size(away)
    return F.when(n > 0, (F.element_at(away, F.floor((n + 1) / 2).cast("int")) + F.element_at(away, F.floor(n / 2).cast("int") + 1)) / 2)


def sem(c) -> Column:
    """Standard error of the mean, from the population deviation."""
    return F.stddev_pop(_c(c)) / F.sqrt(F.count(_c(c)))


def skewness(c) -> Column:
    """With the correction for bias; null under three values."""
    n = F.count(_c(c)).cast("double")
    return F.when(n > 2, F.skewness(_c(c)) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(c) -> Column:
    """Excess, with the correction for bias; null under four values."""
    n = F.count(_c(c)).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(_c(c)) + 6))


def _counts(c) -> Column:
    """Map of each value to how often it occurs, by one sorted list and the places where it changes."""
    values = F.array_sort(F.collect_list(_c(c)))
    n = F.size(values)
    before = F.concat(F.slice(F.array_append(F.slice(values, 1, 0), F.lit(None)), 1, 1), F.slice(values, 1, F.greatest(n - 1, F.lit(0))))
    starts = F.array_compact(F.transform(F.zip_with(values, before, lambda a, b: ~a.eqNullSafe(b)), lambda new, i: F.when(new, i)))
    ends = F.array_append(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), n)
    return F.map_from_arrays(F.array_distinct(values), F.zip_with(starts, F.slice(ends, 1, F.size(starts)), lambda a, z: (z - a).cast("long")))


def histogram(c) -> Column:
    """value -> count in a group. For many distinct values group by the value first (see plans.functions)."""
    return _counts(c)


def histogram_exact(c, bins: list) -> Column:
    """Map of each of the given values to how often it occurs; null, as the last key cannot be, stands for no other value."""
    return F.map_from_arrays(F.array(*map(F.lit, bins)), F.array(*(F.count_if(_c(c) == F.lit(b)) for b in bins)))


def approx_top_k(c, k: int) -> Column:
    """The k most frequent values, most first; ties in no order of their own."""
    return F.transform(F.approx_top_k(_c(c), k), lambda s: s["item"])


def entropy_of_counts(n) -> Column:
    """Bits of entropy from a column of counts by value."""
    t = F.sum(n)
    return F.coalesce(F.log2(t) - F.sum(_c(n) * F.log2(_c(n))) / t, F.lit(0.0))


def quantile_disc(c, q: float) -> Column:
    """The smallest value with at least a share q of values up to it."""
    values = F.array_sort(F.collect_list(_c(c)))
    return F.element_at(values, F.greatest(F.ceil(F.size(values) * F.lit(q)).cast("int"), F.lit(1)))


def quantile(c, q: float = 0.5) -> Column:
    return quantile_disc(c, q)


def bitstring_agg(c, low: int, high: int) -> Column:
    """A text of 0 and 1: which of low..high occur."""
    seen = F.collect_set(_c(c).cast("long"))
    return F.array_join(F.transform(F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long")), lambda v: F.when(F.array_contains(seen, v), "1").otherwise("0")), "")


def string_agg(c, sep: str, *order) -> Column:
    """Non-null values joined, by order keys (else by the values)."""
    keys = order or (c,)
    rows = F.array_sort(F.collect_list(F.when(_c(c).isNotNull(), F.struct(*(_c(o).alias(f"o{i}") for i, o in enumerate(keys)), _c(c).alias("v")))))
    return F.when(F.size(rows) > 0, F.array_join(F.transform(rows, lambda s: s["v"].cast("string")), sep))
