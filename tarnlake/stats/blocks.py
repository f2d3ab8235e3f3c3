"""Block statistics beside a table, and queries that skip blocks by them.

A table is written in blocks of rows, a Parquet row group each, with its block number as a column. The
statistics are a second table: (block, col, kind, n, nulls, low, high, bytes, payload), built by one grouped
pass. A filter is evaluated over the statistics first; the blocks that may match become a filter on the block
number, which Parquet's row-group ranges turn into skipped row groups.

A filter is a tree: ("=", col, v), and so for <>, <, <=, >, >=, ("in", col, [v]), ("between", col, a, b),
("is null", col), ("is not null", col), ("is distinct", col, v), ("not distinct", col, v), ("contains", col, text), ("and", f...), ("or", f...).

Constants may be of another type than the column: they are compared as Spark compares them (in the wider type), never
cast to the column's. A constant that no value of the column can equal, or that lies beyond all of them, makes the
filter true or false of every value; where a comparison's meaning depends on the session (a number with a text, a time
with a zone), nothing is skipped. Constants for timestamps without a zone are datetimes without one, or their ISO text.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from enum import IntEnum
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from tarnlake.operators.joins import numbered
from tarnlake.session import scratch_path
from tarnlake.stats.kinds import KINDS, key_of

ROWS = 8192
GRAM = 3


class Outcome(IntEnum):
    """What a filter is on a block."""

    SOME = 0  # nothing is known
    ALWAYS_TRUE = 1
    ALWAYS_FALSE = 2
    TRUE_OR_NULL = 3
    FALSE_OR_NULL = 4

    @property
    def skips(self) -> bool:
        return self in (Outcome.ALWAYS_FALSE, Outcome.FALSE_OR_NULL)

    @property
    def holds(self) -> bool:
        return self in (Outcome.ALWAYS_TRUE, Outcome.TRUE_OR_NULL)


def with_blocks(df: DataFrame, order: list[Column], rows: int = ROWS) -> DataFrame:
    """df with block, the number of a row in the order divided by rows. Where the order has ties, write it before use."""
    return numbered(df, "__n", *order).withColumn("block", F.floor(F.col("__n") / rows)).drop("__n")


def write_blocks(df: DataFrame, path: str, rows: int = ROWS) -> None:
    """A table with its block column, sorted by it, so that row groups hold few blocks each."""
    df.repartitionByRange("block").sortWithinPartitions("block").write.option("parquet.block.row.count.limit", rows).parquet(path)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, reread."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, order: list[Column], rows: int = ROWS) -> DataFrame:
    """df in blocks, written and reread: statistics and later scans then see the same blocks, whatever the order's ties."""
    path = scratch_path(df.sparkSession, "blocks")
    write_blocks(with_blocks(df, order, rows), path, rows)
    return df.sparkSession.read.parquet(path)


INTEGERS = {"byte": 8, "short": 16, "integer": 32, "long": 64}
EPOCH = dt.datetime(1970, 1, 1)


def is_ordered(t: DataType) -> bool:
    """Whether keys of a column of this type have the order of its values (others are hashes)."""
    return t.typeName() in (*INTEGERS, "boolean", "float", "double", "date", "timestamp", "timestamp_ntz") or t.typeName() == "decimal" and t.precision <= 18


def key_column(df: DataFrame, c: str, x: Column) -> tuple[Column, bool]:
    """x, of column c's type, as what key_of takes (times as microseconds, decimals unscaled, texts by hash), and whether it has an order."""
    t = df.schema[c].dataType
    kind = t.typeName()
    if kind == "timestamp":
        return F.unix_micros(x), True
    if kind == "timestamp_ntz":  # by its fields: a session's zone must not matter
        clock = F.hour(x) * 3600 + F.minute(x) * 60
        return F.unix_date(F.to_date(x)).cast("long") * 86_400_000_000 + clock.cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), x) * 1_000_000).cast("long"), True
    if kind == "date":
        return F.unix_date(x).cast("long"), True
    if kind in ("float", "double"):
        return x.cast("double"), True
    if kind == "decimal" and is_ordered(t):
        return (x * Decimal(10**t.scale)).cast("long"), True
    if kind in INTEGERS or kind == "boolean":
        return x.cast("long"), True
    return F.when(x.isNotNull(), F.xxhash64(x.cast("string"))), False  # of null, the hash is a number


def grams_of(x: Column) -> Column:
    """Hashes of a text's runs of GRAM characters; none of a shorter one."""
    n = F.length(x)
    return F.when(n >= GRAM, F.transform(F.sequence(F.lit(1), F.greatest(n - GRAM + 1, F.lit(1))), lambda i: F.xxhash64(F.substring(x, i, F.lit(GRAM)))))


def build(df: DataFrame, cols: list[str], kinds: list[str]) -> DataFrame:
    """The statistics table of df (with block) for each column and kind; min_max is always there.

    Kinds named ngram_* are of texts alone, and of their runs of GRAM characters in place of whole values.
    """
    out = None
    for c, of_grams in [(c, g) for c in cols for g in (False, True)]:
        mine = [k for k in kinds if k.startswith("ngram") == of_grams]
        if of_grams and (not mine or df.schema[c].dataType.typeName() != "string"):
            continue
        k, ordered = key_column(df, c, F.col(c))
        g = df.select("block", k.alias("k")).groupBy("block").agg(F.count("*").alias("n"), F.count_if(F.col("k").isNull()).alias("nulls"), F.sort_array(F.collect_set("k")).alias("keys"))
        if of_grams:
            each = df.select("block", F.explode_outer(grams_of(F.col(c))).alias("k")).groupBy("block").agg(F.sort_array(F.collect_set("k")).alias("grams"))
            g = g.join(each, "block").select("block", "n", "nulls", F.col("grams").alias("keys"))

        def run(batches: Iterator, c=c, ordered=ordered, mine=mine, of_grams=of_grams) -> Iterator:
            import numpy as np
            import pyarrow as pa

            names = ["block", "col", "kind", "n", "nulls", "low", "high", "bytes", "payload"]
            for b in batches:
                rows = []
                for block, n, nulls, values in zip(*(b.column(x).to_pylist() for x in ("block", "n", "nulls", "keys")), strict=True):
                    keys = np.array(sorted({key_of(v) for v in values}), np.uint64)
                    low, high = (int(keys[0]).to_bytes(8), int(keys[-1]).to_bytes(8)) if ordered and len(keys) else (None, None)
                    if not of_grams:
                        rows.append((block, c, "min_max", n, nulls, low, high, 16, None))
                    for name in mine:
                        if ordered or name.startswith(("bloom", "dictionary", "nullspace", "ngram")):
                            raw = KINDS[name].build(keys)
                            if raw is not None:
                                rows.append((block, c, name, n, nulls, low, high, len(raw), raw))
                t = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*rows, strict=True) if rows else [[]] * 9, t, strict=True)], names=names)

        one = g.mapInArrow(run, "block long, col string, kind string, n long, nulls long, low binary, high binary, bytes long, payload binary")
        out = one if out is None else out.unionAll(one)
    return out


@dataclass
class Column1:
    """What is known of a column in a block: rows, nulls, range, and (kind, payload) of further statistics."""

    n: int
    nulls: int
    low: int | None
    high: int | None
    more: list[tuple[str, bytes]]
    ordered: bool = True

    def may(self, low: int, high: int) -> bool:
        if self.low is not None and (high < self.low or low > self.high):
            return False
        return all(KINDS[k].may(raw, low, high) for k, raw in self.more if not k.startswith("ngram"))

    def may_hold(self, grams: list[int]) -> bool:
        """Whether a text with all these runs of characters may be there."""
        return all(KINDS[k].may(raw, g, g) for k, raw in self.more if k.startswith("ngram") for g in grams)


TOP = (1 << 64) - 1


def evaluate(f: tuple, cols: dict[str, Column1]) -> Outcome:
    """The outcome of a filter on a block. Constants are keys already (see keyed).

    Further leaves that keyed makes: ("all", col) and ("no", col) are true and false of every value but null;
    ("any",) and ("none",) of every row; ("unknown",) may be anything.
    """
    op = f[0]
    if op in ("any", "none", "unknown"):
        return {"any": Outcome.ALWAYS_TRUE, "none": Outcome.ALWAYS_FALSE, "unknown": Outcome.SOME}[op]
    if op == "and":
        found = [evaluate(x, cols) for x in f[1:]]
        if Outcome.ALWAYS_FALSE in found:
            return Outcome.ALWAYS_FALSE
        if any(x.skips for x in found):
            return Outcome.FALSE_OR_NULL
        if all(x.holds for x in found):
            return Outcome.ALWAYS_TRUE if all(x == Outcome.ALWAYS_TRUE for x in found) else Outcome.TRUE_OR_NULL
        return Outcome.SOME
    if op == "or":
        found = [evaluate(x, cols) for x in f[1:]]
        if Outcome.ALWAYS_TRUE in found:
            return Outcome.ALWAYS_TRUE
        if any(x.holds for x in found):
            return Outcome.TRUE_OR_NULL
        if all(x.skips for x in found):
            return Outcome.ALWAYS_FALSE if all(x == Outcome.ALWAYS_FALSE for x in found) else Outcome.FALSE_OR_NULL
        return Outcome.SOME
    c = cols.get(f[1])
    if c is None:
        return Outcome.SOME
    none, some = c.nulls == c.n, c.nulls > 0
    if op == "is null":
        return Outcome.ALWAYS_TRUE if none else Outcome.SOME if some else Outcome.ALWAYS_FALSE
    if op == "is not null":
        return Outcome.ALWAYS_FALSE if none else Outcome.SOME if some else Outcome.ALWAYS_TRUE
    if op == "is distinct":
        return Outcome.ALWAYS_TRUE if none or not c.may(f[2], f[2]) else Outcome.SOME
    if op == "not distinct":
        return Outcome.ALWAYS_FALSE if none or not c.may(f[2], f[2]) else Outcome.SOME
    if none:
        return Outcome.FALSE_OR_NULL
    false, true = (Outcome.FALSE_OR_NULL, Outcome.TRUE_OR_NULL) if some else (Outcome.ALWAYS_FALSE, Outcome.ALWAYS_TRUE)
    if op in ("all", "no"):
        return true if op == "all" else false
    if op == "contains":
        return Outcome.SOME if c.may_hold(f[2]) else false
    if op == "in":
        return Outcome.SOME if any(c.may(v, v) for v in f[2]) else false
    if op == "<>":
        if c.low is not None and c.low == c.high == f[2]:
            return false
        return Outcome.SOME if c.may(f[2], f[2]) else true
    span = {"=": lambda v: (v, v), "<": lambda v: (0, v - 1), "<=": lambda v: (0, v), ">": lambda v: (v + 1, TOP), ">=": lambda v: (v, TOP), "between": lambda v: (v, f[3] if op == "between" else 0)}[op](f[2])
    if span[0] > span[1]:
        return false
    if c.low is None and span[0] != span[1]:
        return Outcome.SOME  # without an order only points can be told
    if not c.may(*span):
        return false
    return true if c.low is not None and span[0] <= c.low and c.high <= span[1] else Outcome.SOME


def number_of(v, t: DataType) -> Fraction | float | None:
    """A constant on the scale of keys of an ordered type t, exact (floats where t is one, or not finite); None: not comparable here."""
    kind = t.typeName()
    if kind == "boolean" or isinstance(v, bool):
        return Fraction(int(v)) if kind == "boolean" and isinstance(v, bool) else None
    if kind == "timestamp_ntz":
        if isinstance(v, str):
            try:
                v = dt.datetime.fromisoformat(v)
            except ValueError:
                return None
        if isinstance(v, dt.datetime) and v.tzinfo is None:
            return Fraction((v - EPOCH) // dt.timedelta(microseconds=1))
        return None
    if kind == "timestamp":
        if isinstance(v, dt.datetime) and v.tzinfo is not None:
            return Fraction((v - EPOCH.replace(tzinfo=dt.UTC)) // dt.timedelta(microseconds=1))
        return None
    if kind == "date":
        return Fraction((v - EPOCH.date()).days) if isinstance(v, dt.date) and not isinstance(v, dt.datetime) else None
    if not isinstance(v, (int, float, Decimal)):
        return None
    if kind in ("float", "double"):
        return float(v)
    if isinstance(v, float):
        if not math.isfinite(v):
            return v
        # Spark compares in doubles, in which long integers and decimals of many digits are not told apart
        if kind == "decimal" or 1 << 53 <= abs(v) < 1 << 64:
            return None
    if isinstance(v, Decimal) and not v.is_finite():
        return None
    return Fraction(v) * (10**t.scale if kind == "decimal" else 1)


def leaf(op: str, c: str, flat: list, t: DataType) -> tuple:
    """One comparison of column c, of type t, with its constants as keys, or what it comes to for every value."""
    if any(v is None for v in flat) and op != "in":
        return {"is distinct": ("is not null", c), "not distinct": ("is null", c)}.get(op, ("no", c))
    flat = [v for v in flat if v is not None]
    if op == "contains":
        (v,) = flat
        if t.typeName() != "string" or getattr(t, "collation", "UTF8_BINARY") != "UTF8_BINARY" or not isinstance(v, str) or len(v) < GRAM:
            return ("unknown",)
        return (op, c, [key_of(text_key(v[i : i + GRAM])) for i in range(len(v) - GRAM + 1)])
    if not is_ordered(t):
        if op not in ("=", "<>", "in", "is distinct", "not distinct") or t.typeName() not in ("string", "binary") or getattr(t, "collation", "UTF8_BINARY") != "UTF8_BINARY" or not all(isinstance(v, str if t.typeName() == "string" else (bytes, bytearray)) for v in flat):
            return ("unknown",)
        keys = [key_of(text_key(v)) for v in flat]
        return ("in", c, keys) if op == "in" else (op, c, *keys)
    numbers = [number_of(v, t) for v in flat]
    if any(n is None for n in numbers):
        return ("unknown",)
    if t.typeName() in ("float", "double"):
        keys = [key_of(n) for n in numbers]
        return ("in", c, keys) if op == "in" else (op, c, *keys)
    least, most = -(1 << 63), (1 << 63) - 1
    if op == "in":
        keys = [key_of(int(n)) for n in numbers if isinstance(n, Fraction) and n.denominator == 1 and least <= n <= most]
        return ("in", c, keys) if keys else ("no", c)
    # infinities lie beyond all; NaN is above them
    numbers = [Fraction(least - 1 if n == -math.inf else most + 1) if isinstance(n, float) else n for n in numbers]
    if op == "between":
        low, high = max(math.ceil(numbers[0]), least), min(math.floor(numbers[1]), most)
        return ("between", c, key_of(low), key_of(high)) if low <= high else ("no", c)
    (n,) = numbers
    inside = least <= n <= most
    if op in ("=", "<>", "is distinct", "not distinct"):
        if inside and n.denominator == 1:
            return (op, c, key_of(int(n)))
        return {"=": ("no", c), "<>": ("all", c), "is distinct": ("any",), "not distinct": ("none",)}[op]
    if not inside:
        return ("all" if (n > 0) == (op in ("<", "<=")) else "no", c)
    if n.denominator == 1:
        return (op, c, key_of(int(n)))
    return ("<=", c, key_of(math.floor(n))) if op in ("<", "<=") else (">=", c, key_of(math.ceil(n)))


def text_key(v: str | bytes) -> int:
    """What xxhash64 gives for a text or bytes: XXH64 of its UTF-8, seed 42, signed."""
    import xxhash

    h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else bytes(v), 42)
    return h - (1 << 64) if h >> 63 else h


def keyed(schema: StructType, f: tuple) -> tuple:
    """A filter with its constants as keys, on the driver alone."""
    if f[0] in ("and", "or"):
        return (f[0], *(keyed(schema, x) for x in f[1:]))
    if len(f) == 2:
        return f
    return leaf(f[0], f[1], list(f[2]) if f[0] == "in" else list(f[2:]), schema[f[1]].dataType)


def columns_of(rows: list[dict]) -> dict[str, Column1]:
    """What rows of a statistics table, all of one block, say of each column."""
    cols: dict[str, Column1] = {}
    for r in rows:
        c = cols.setdefault(r["col"], Column1(r["n"], r["nulls"], None if r["low"] is None else int.from_bytes(r["low"]), None if r["high"] is None else int.from_bytes(r["high"]), []))
        if r["payload"] is not None:
            c.more.append((r["kind"], r["payload"]))
    return cols


def outcomes(stats: DataFrame, f: tuple) -> DataFrame:
    """(block, outcome) of a keyed filter on every block of a statistics table; evaluated where the statistics are."""
    g = stats.groupBy("block").agg(F.collect_list(F.struct("col", "kind", "n", "nulls", "low", "high", "payload")).alias("rows"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = [int(evaluate(f, columns_of(rows))) for rows in b.column("rows").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(out, pa.int32())], names=["block", "outcome"])

    return g.mapInArrow(run, "block long, outcome int")


def constant(v, t: DataType | None) -> Column:
    """A literal; for a timestamp without a zone, the same wall clock in any session."""
    if t is not None and t.typeName() == "timestamp_ntz" and (isinstance(v, str) or isinstance(v, dt.datetime) and v.tzinfo is None):
        at = dt.datetime.fromisoformat(v) if isinstance(v, str) else v
        return F.expr(f"TIMESTAMP_NTZ '{at.isoformat(sep=' ')}'")
    if isinstance(v, int) and not -(1 << 63) <= v < 1 << 63:
        v = Decimal(v)
    return F.lit(v)


def condition(f: tuple, schema: StructType | None = None) -> Column:
    """The filter itself, over rows."""
    op = f[0]
    if op in ("and", "or"):
        from functools import reduce

        return reduce(lambda a, b: a & b if op == "and" else a | b, (condition(x, schema) for x in f[1:]))
    c = F.col(f[1])
    if op == "is null":
        return c.isNull()
    if op == "is not null":
        return c.isNotNull()
    t = None if schema is None else schema[f[1]].dataType
    if op == "in":
        return c.isin([constant(v, t) for v in f[2]]) if f[2] else F.lit(False)
    at = [constant(v, t) for v in f[2:]]
    if op == "contains":
        return c.contains(at[0])
    if op == "between":
        return c.between(*at)
    if op in ("is distinct", "not distinct"):
        same = c.eqNullSafe(at[0])
        return ~same if op == "is distinct" else same
    return {"=": c == at[0], "<>": c != at[0], "<": c < at[0], "<=": c <= at[0], ">": c > at[0], ">=": c >= at[0]}[op]


#: Blocks up to which their numbers become a literal list; beyond, a join on them.
LISTED = 10_000


def pruned(df: DataFrame, stats: DataFrame, f: tuple) -> DataFrame:
    """Rows of df (with block) that pass f, read from the blocks that may hold some."""
    keep = outcomes(stats, keyed(df.schema, f)).filter(~F.col("outcome").isin(int(Outcome.ALWAYS_FALSE), int(Outcome.FALSE_OR_NULL))).select("block")
    known = [r.block for r in keep.limit(LISTED + 1).collect()]
    if len(known) <= LISTED:
        return df.filter(F.col("block").isin(known) & condition(f, df.schema))
    return df.join(keep, "block", "left_semi").filter(condition(f, df.schema))


def report(df: DataFrame, stats: DataFrame, filters: list[tuple]) -> DataFrame:
    """Per filter: blocks, blocks left to scan, rows, and rows in the blocks left. One pass over the statistics."""
    fs = [keyed(df.schema, f) for f in filters]
    g = stats.groupBy("block").agg(F.max("n").alias("n"), F.collect_list(F.struct("col", "kind", "n", "nulls", "low", "high", "payload")).alias("rows"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        seen = np.zeros((len(fs), 4), np.int64)
        for b in batches:
            for n, rows in zip(b.column("n").to_pylist(), b.column("rows").to_pylist(), strict=True):
                cols = columns_of(rows)
                for i, f in enumerate(fs):
                    left = not evaluate(f, cols).skips
                    seen[i] += (1, left, n, n * left)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(fs)), pa.int32()), *(pa.array(c) for c in seen.T)], names=["query", "blocks", "scanned", "n_rows", "rows_left"])

    each = g.mapInArrow(run, "query int, blocks long, scanned long, n_rows long, rows_left long")
    return each.groupBy("query").agg(*(F.sum(c).alias(c) for c in ("blocks", "scanned", "n_rows", "rows_left")))


def statistics_bytes(stats: DataFrame) -> DataFrame:
    """(kind, bytes, blocks) that each kind takes."""
    return stats.groupBy("kind").agg(F.sum("bytes").alias("bytes"), F.countDistinct("block").alias("blocks"))
