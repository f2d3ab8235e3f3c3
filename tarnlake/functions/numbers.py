"""Numeric functions that Spark lacks or defines otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALIASES = {"ceiling": "ceil", "power": "pow", "pow": "pow", "ln": "ln", "gcd_": "gcd", "xor": "bitwise_xor", "random": "rand", "hash": "xxhash64", "signbit_": "signum"}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def divide(a, b) -> Column:
    """Of doubles, as IEEE has it: x/0 is an infinity, 0/0 is not a number; nothing raises."""
    x, y = _c(a).cast("double"), _c(b).cast("double")
    inf = F.lit(float("inf"))
    zero = F.when((x == 0) | F.isnan(x), F.lit(float("nan"))).when(x > 0, inf).otherwise(-inf)
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(y == 0, zero).otherwise(F.try_divide(x, y))


def int_divide(a, b) -> Column:
    """Of integers, towards zero; null for a zero divisor."""
    q = F.try_divide(_c(a), _c(b))
    return F.when(q >= 0, F.floor(q)).otherwise(F.ceil(q))


def mod(a, b) -> Column:
    return F.try_mod(_c(a), _c(b))


def fdiv(a, b) -> Column:
    return F.floor(divide(a, b))


def fmod(a, b) -> Column:
    """The remainder of division towards minus infinity."""
    return _c(a) - F.floor(_c(a) / _c(b)) * _c(b)


def xor(a, b) -> Column:
    return _c(a).bitwiseXOR(_c(b))


def signbit(c) -> Column:
    """Whether the sign is negative; of -0.0 too."""
    return _c(c).cast("double").cast("string").startswith("-")


def round_even(c, digits: int = 0) -> Column:
    return F.bround(_c(c), digits)


def trunc(c) -> Column:
    return F.when(_c(c) < 0, F.ceil(_c(c))).otherwise(F.floor(_c(c))).cast("double")


def even(c) -> Column:
    """The next even number away from zero."""
    return F.signum(_c(c)) * F.ceil(F.abs(_c(c)) / 2) * 2


def isinf(c) -> Column:
    return F.abs(_c(c)) == F.lit(float("inf"))


def isfinite(c) -> Column:
    return ~(F.isnan(_c(c)) | isinf(c))


def gcd(a, b) -> Column:
    """By Euclid's steps; 94 are enough for 64 bits."""
    pair = F.struct(F.abs(_c(a)).cast("long").alias("x"), F.abs(_c(b)).cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(94)), pair, lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, s["y"]).otherwise(F.try_mod(s["x"], s["y"])).alias("y")))["x"]


def lcm(a, b) -> Column:
    return F.when((_c(a) == 0) | (_c(b) == 0), F.lit(0).cast("long")).otherwise(F.abs((_c(a) / gcd(a, b)).cast("long") * _c(b)))


def _doubles(f):
    def run(*cs):
        import pandas as pd

        def g(*xs):
            return pd.Series([None if any(pd.isna(v) for v in row) else f(*row) for row in zip(*xs, strict=True)], dtype="float64")

        return F.pandas_udf(g, "double", F.PandasUDFType.SCALAR)(*(_c(c).cast("double") for c in cs))

    return run


def _gamma(x: float) -> float:
    import math

    return math.gamma(x)


def _lgamma(x: float) -> float:
    import math

    return math.lgamma(x)


def _after(x: float, y: float) -> float:
    import math

    return math.nextafter(x, y)


gamma, lgamma, nextafter = _doubles(_gamma), _doubles(_lgamma), _doubles(_after)


def equi_width_bins(low, high, n: int) -> list[float]:
    """Upper bounds of n bins of equal width."""
    return [low + (high - low) * (k + 1) / n for k in range(n)]


def add(a, b) -> Column:
    return _c(a) + _c(b)


def subtract(a, b) -> Column:
    return _c(a) - _c(b)


def multiply(a, b) -> Column:
    return _c(a) * _c(b)
