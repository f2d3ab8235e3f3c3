"""SQL functions by their usual names, as functions of columns.

``fn.name(...)`` finds a function of this package first (where Spark has none, or another meaning), then an alias
of a Spark function, then Spark's own. Arguments are columns or column names; other values are literals where a
module says so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from tarnlake.functions import aggregates, dates, documents, lists, numbers, text

MODULES = (aggregates, text, numbers, dates, lists, documents)


def lookup(name: str) -> Callable:
    for m in MODULES:
        if f"{name}_" in m.__dict__:  # names that Python keeps for itself
            return m.__dict__[f"{name}_"]
        if name in m.__dict__ and callable(m.__dict__[name]) and not name.startswith("_") and name not in ("F", "Column"):
            return m.__dict__[name]
        if name in m.ALIASES:
            return getattr(F, m.ALIASES[name])
    if hasattr(F, name):
        return getattr(F, name)
    raise AttributeError(f"no function {name}")


class _Names:
    def __getattr__(self, name: str) -> Callable:
        return lookup(name.rstrip("_"))


fn = _Names()
