"""Date and time functions: parts, differences by boundaries or by whole units, truncation, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALIASES = {"dayofmonth": "dayofmonth", "day": "dayofmonth", "weekofyear": "weekofyear", "week": "weekofyear", "get_current_timestamp": "now", "today": "current_date", "epoch_s": "unix_seconds"}

MICROS = {"microsecond": 1, "millisecond": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6}
MONTHS = {"month": 1, "quarter": 3, "year": 12, "decade": 120, "century": 1200, "millennium": 12000}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _micros(c) -> Column:
    """Microseconds of a wall clock since 1970, by its fields: a session's zone, and its clock changes, do not matter."""
    x = _c(c).cast("timestamp_ntz")
    clock = (F.hour(x) * 3600 + F.minute(x) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), x) * 1_000_000).cast("long")
    return F.unix_date(F.to_date(x)).cast("long") * 86_400_000_000 + clock


def _at(micros: Column) -> Column:
    """The wall clock so many microseconds after 1970 began."""
    day = F.floor(micros / F.lit(86_400_000_000))
    seconds = (F.pmod(micros, F.lit(86_400_000_000)).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    return F.date_from_unix_date(day.cast("int")).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def _months(c) -> Column:
    return F.year(_c(c)) * 12 + F.month(_c(c)) - 1


def date_diff(part: str, a, b) -> Column:
    """Boundaries of a part between a and b."""
    if part in MICROS:
        return F.floor(_micros(b) / MICROS[part]) - F.floor(_micros(a) / MICROS[part])
    if part == "day":
        return F.datediff(_c(b).cast("date"), _c(a).cast("date")).cast("long")
    if part == "week":  # spans of seven days between the dates, whatever day a week begins on
        days = F.datediff(_c(b).cast("date"), _c(a).cast("date"))
        return F.when(days >= 0, F.floor(days / 7)).otherwise(F.ceil(days / 7)).cast("long")
    n = MONTHS[part]
    if part in ("month", "quarter", "year"):
        return F.floor(_months(b) / n) - F.floor(_months(a) / n)
    return F.floor(F.year(_c(b)) / (n // 12)) - F.floor(F.year(_c(a)) / (n // 12))


datediff = date_diff


def date_sub(part: str, a, b) -> Column:
    """Whole units of a part between a and b, towards zero."""
    gap = _micros(b) - _micros(a)
    unit = MICROS.get(part) or {"day": 86400 * 10**6, "week": 7 * 86400 * 10**6}.get(part)
    if unit:
        return F.when(gap >= 0, F.floor(gap / unit)).otherwise(F.ceil(gap / unit)).cast("long")
    def whole(x, y) -> Column:
        """Months that can be added to x, at most to the end of a month, without passing y (y is not before x)."""
        m = (_months(y) - _months(x)).cast("int")
        day, clock = F.add_months(_c(x).cast("date"), m), lambda c: _micros(c) - _micros(_c(c).cast("date").cast("timestamp_ntz"))
        return m - F.when((day > _c(y).cast("date")) | ((day == _c(y).cast("date")) & (clock(x) > clock(y))), 1).otherwise(0)

    n = MONTHS[part]
    return F.when(gap >= 0, F.floor(whole(a, b) / n)).otherwise(-F.floor(whole(b, a) / n)).cast("long")


datesub = date_sub


def date_part(part: str, c) -> Column:
    x = _c(c)
    y = F.year(x)
    own = {
        "decade": lambda: F.floor(y / 10), "century": lambda: F.floor((y - 1) / 100) + 1, "millennium": lambda: F.floor((y - 1) / 1000) + 1,
        "era": lambda: F.when(y > 0, 1).otherwise(0), "isodow": lambda: F.weekday(x) + 1, "dow": lambda: F.dayofweek(x) - 1, "dayofweek": lambda: F.dayofweek(x) - 1,
        "yearweek": lambda: F.extract(F.lit("YEAROFWEEK"), x) * 100 + F.weekofyear(x), "isoyear": lambda: F.extract(F.lit("YEAROFWEEK"), x),
        "epoch": lambda: _micros(x) / 1e6, "epoch_ms": lambda: F.floor((_micros(x) + 500) / 1000), "epoch_us": lambda: _micros(x), "epoch_ns": lambda: _micros(x) * 1000,
        "julian": lambda: F.datediff(x.cast("date"), F.lit("1970-01-01").cast("date")) + 2440588 + (_micros(x) - _micros(x.cast("date").cast("timestamp_ntz"))) / (86400 * 1e6),
        "second": lambda: F.second(x), "millisecond": lambda: F.floor(F.pmod(_micros(x), F.lit(60 * 10**6)) / 1000), "microsecond": lambda: F.pmod(_micros(x), F.lit(60 * 10**6)),
        "dayofyear": lambda: F.dayofyear(x), "week": lambda: F.weekofyear(x), "day": lambda: F.dayofmonth(x), "minute": lambda: F.minute(x), "hour": lambda: F.hour(x),
        "month": lambda: F.month(x), "quarter": lambda: F.quarter(x), "year": lambda: y,
    }
    return own[part]().cast("double" if part in ("epoch", "julian") else "long")


def _part(name: str):
    return lambda c: date_part(name, c)


century, decade, millennium, era, julian = map(_part, ("century", "decade", "millennium", "era", "julian"))
isodow, dayofweek, yearweek, isoyear = map(_part, ("isodow", "dayofweek", "yearweek", "isoyear"))
epoch, epoch_ms, epoch_us, epoch_ns, microsecond, millisecond = map(_part, ("epoch", "epoch_ms", "epoch_us", "epoch_ns", "microsecond", "millisecond"))


def dayname(c) -> Column:
    return F.date_format(_c(c), "EEEE")


def monthname(c) -> Column:
    return F.date_format(_c(c), "MMMM")


def date_trunc(part: str, c) -> Column:
    x = _c(c)
    if part in ("decade", "century", "millennium"):
        n = MONTHS[part] // 12
        start = F.floor(F.year(x) / n) * n if part == "decade" else F.floor((F.year(x) - 1) / n) * n + 1
        start = F.floor(F.year(x) / n) * n if part != "decade" else start
        return F.make_date(start.cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    if part.lower() in MICROS:
        return _at(F.floor(_micros(x) / MICROS[part.lower()]) * MICROS[part.lower()])
    return (x.cast("date") if part.lower() == "day" else F.trunc(x.cast("date"), part)).cast("timestamp_ntz")


def time_bucket(micros: int, c, origin: str = "2000-01-03 00:00:00") -> Column:
    """The start of the bucket of a fixed width that a time lies in; buckets count from the origin, a Monday."""
    at = _micros(F.lit(origin).cast("timestamp_ntz"))
    return _at(F.floor((_micros(c) - at) / micros) * micros + at)


def last_day(c) -> Column:
    return F.last_day(_c(c).cast("date"))


#: The signs of strftime and Spark's letters for them.
SIGNS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "SSSSSS", "g": "SSS", "y": "yy", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "p": "a", "I": "hh", "j": "DDD", "-d": "d", "-m": "M", "-H": "H", "-M": "m", "-S": "s", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "%": "%"}


def pattern_of(fmt: str) -> str:
    """Spark's pattern of a strftime format."""
    import re

    def one(m):
        return SIGNS[m[1]] if m[1] else "''" if m[2] == "'" else f"'{m[2]}'" if m[2].isalpha() else m[2]

    return re.sub(r"%(-?[A-Za-z%])|(.)", one, fmt, flags=re.S)


def strftime(c, fmt: str) -> Column:
    return F.date_format(_c(c), pattern_of(fmt))


def strptime(c, fmt: str) -> Column:
    return F.to_timestamp_ntz(_c(c), F.lit(pattern_of(fmt)))


def try_strptime(c, fmt: str) -> Column:
    return F.try_to_timestamp(_c(c), F.lit(pattern_of(fmt))).cast("timestamp_ntz")


def age(a, b) -> Column:
    """Whole months and the rest, from b to a: struct(months, micros)."""
    m = date_sub("month", b, a)
    return F.struct(m.alias("months"), (_micros(a) - _micros(F.add_months(_c(b).cast("date"), m.cast("int")).cast("timestamp_ntz"))).alias("micros"))


def _interval(unit: str, n: int = 1):
    return lambda c: F.make_interval(**{unit: (_c(c) * n).cast("int") if unit != "secs" else _c(c) * n})


to_years, to_months, to_weeks, to_days = _interval("years"), _interval("months"), _interval("weeks"), _interval("days")
to_decades, to_centuries, to_millennia, to_quarters = _interval("years", 10), _interval("years", 100), _interval("years", 1000), _interval("months", 3)
to_hours, to_minutes = _interval("hours"), _interval("mins")


def to_seconds(c) -> Column:
    return F.make_interval(secs=_c(c).cast("decimal(18,6)"))


def to_milliseconds(c) -> Column:
    return F.make_interval(secs=(_c(c) / 1000).cast("decimal(18,6)"))


def to_microseconds(c) -> Column:
    return F.make_interval(secs=(_c(c) / 1000000).cast("decimal(18,6)"))


def make_time(h, m, s) -> Column:
    """Microseconds since midnight."""
    return (_c(h) * 3600 + _c(m) * 60).cast("long") * 1000000 + F.round(_c(s) * 1000000).cast("long")


def make_timestamp_ns(n) -> Column:
    return _at(F.floor(_c(n) / 1000))
