"""Block statistics: nothing present is ever ruled out; pruned results equal unpruned; assignments against brute force."""

import datetime as dt
import random
from decimal import Decimal
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnlake.session import table
from tarnlake.stats import assign, blocks, kinds, workload
from tarnlake.stats.blocks import Column1, Outcome, evaluate
from tarnlake.stats.kinds import KINDS, key_of, rice, unrice


@given(st.lists(st.one_of(st.integers(-(1 << 63), (1 << 63) - 1)), min_size=1, max_size=60), st.integers(-(1 << 63), (1 << 63) - 1), st.integers(0, 1 << 20))
@settings(max_examples=60, deadline=None)
def test_no_false_negatives(values, low, width):
    keys = np.array(sorted({key_of(v) for v in values}), np.uint64)
    a = key_of(low)
    b = min(a + width, (1 << 64) - 1)
    inside = any(a <= int(k) <= b for k in keys)
    for name, kind in KINDS.items():
        raw = kind.build(keys)
        if raw is not None:
            assert all(kind.may(raw, int(k), int(k)) for k in keys), name
            assert not inside or kind.may(raw, a, b), name


@given(st.lists(st.floats(allow_infinity=True), min_size=2, max_size=20))
def test_key_order_of_floats(xs):
    order = sorted(xs, key=key_of)
    plain = [x for x in order if x == x]
    assert plain == sorted(plain) and key_of(-0.0) == key_of(0.0)


@given(st.lists(st.integers(0, 1 << 30), min_size=1, max_size=50))
def test_rice_round_trip(gaps):
    p, bits = rice(np.array(gaps, np.int64))
    assert unrice(p, bits, len(gaps)).tolist() == gaps


def test_false_positive_rates():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 62, 1000, dtype=np.uint64))
    for name, most in (("bloom_m", 0.02), ("bloom_k2", 0.03), ("nullspace", 0.03), ("dictionary", 0.0)):
        raw = KINDS[name].build(keys[:1000])
        probes = rng.integers(1 << 62, 1 << 63, 2000, dtype=np.uint64)
        assert sum(KINDS[name].may(raw, int(x), int(x)) for x in probes) <= most * len(probes), name


def test_outcomes():
    c = {"x": Column1(5, 0, 10, 20, []), "y": Column1(5, 2, 10, 20, []), "z": Column1(5, 5, None, None, [])}
    assert evaluate(("=", "x", 9), c) == Outcome.ALWAYS_FALSE and evaluate(("=", "y", 9), c) == Outcome.FALSE_OR_NULL
    assert evaluate(("<", "x", 21), c) == Outcome.ALWAYS_TRUE and evaluate(("<", "y", 21), c) == Outcome.TRUE_OR_NULL
    assert evaluate(("and", ("=", "y", 9), ("=", "x", 12)), c) == Outcome.FALSE_OR_NULL
    assert evaluate(("or", ("=", "y", 9), ("=", "x", 12)), c) == Outcome.SOME
    assert evaluate(("or", ("=", "y", 9), ("=", "x", 8)), c).skips and evaluate(("in", "x", [1, 2]), c).skips
    assert evaluate(("=", "z", 1), c) == Outcome.FALSE_OR_NULL and evaluate(("is distinct", "z", 1), c) == Outcome.ALWAYS_TRUE
    assert evaluate(("is null", "x"), c).skips and evaluate(("not distinct", "y", 9), c) == Outcome.ALWAYS_FALSE


@pytest.mark.parametrize("shape", ["unsorted", "sorted", "outliers", "cardinality", "combined"])
def test_pruning_keeps_results(spark, shape):
    df = workload.generate(spark, 6000, shape, block=500).cache()
    stats = blocks.build(df, ["time"], [k for k in KINDS if k not in ("bloom_l", "occupancy_l")]).cache()
    filters = workload.points(df, "time", 3) + workload.ranges(df, "time", 2) + [("=", "time", 5), (">", "time", workload.HIGH)]
    for f in filters:
        got = blocks.pruned(df, stats, f)
        want = df.filter(blocks.condition(f))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    seen = {r.query: r for r in blocks.report(df, stats, filters[-2:]).collect()}
    assert seen[0].scanned == 0 and seen[1].blocks == 12


def brute(options, budget):
    places = sorted({o.place for o in options})
    best = 0
    for pick in product(*([None, *(o for o in options if o.place == p)] for p in places)):
        if sum(o.size for o in pick if o) <= budget:
            best = max(best, sum(o.prunes for o in pick if o))
    return best


def test_assigners():
    rng = random.Random(1)
    for _ in range(30):
        options = [assign.Option(p, k, rng.randint(1, 9), rng.randint(0, 9)) for p in range(4) for k in "abc"] + [assign.Option(0, "d", 3, 4), assign.Option(0, "e", 3, 5)]
        for budget in (0, 5, 11, 40):
            top = brute(options, budget)
            for name, f in assign.ASSIGNERS.items():
                taken = f(options, budget)
                assert sum(o.size for o in taken.values()) <= budget and all(o.place == p for p, o in taken.items())
                assert sum(o.prunes for o in taken.values()) <= top
                if name == "exact":
                    assert sum(o.prunes for o in taken.values()) == top


def test_tune_and_evaluate_apart(spark, sf):
    df = blocks.stored(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), [blocks.F.col("l_orderkey")], 512)
    stats = blocks.build(df, ["l_partkey"], ["bloom_s", "dictionary", "occupancy_s"]).cache()
    tune, test = workload.points(df, "l_partkey", 3, seed=1), workload.points(df, "l_partkey", 3, seed=2)
    options = assign.measure(df, stats, tune)
    taken = assign.greedy(options, 4000)
    kept = assign.chosen(stats, taken)
    for f in test:
        assert sorted(map(tuple, blocks.pruned(df, kept, f).collect())) == sorted(map(tuple, df.filter(blocks.condition(f)).collect()))


BIG = 1 << 62
TYPED = {
    "i int": ([5, 5, -3, None, 2147483647], [5, 5.5, -3.5, 3_000_000_000, -3_000_000_000, 1e300, float("inf"), float("nan"), Decimal("5.0"), Decimal("5.5"), None]),
    "l long": ([1, BIG, BIG + 1, -BIG, None], [BIG, BIG + 1, float(BIG), BIG + 0.5, 1.5, Decimal(BIG) + Decimal("0.5")]),
    "d double": ([0.0, -0.0, 1.5, float("nan"), float("inf"), None], [0, 0.0, -0.0, 1.5, 1, float("nan"), float("-inf"), Decimal("1.5")]),
    "f float": ([0.1, 2.5, None], [0.1, 2.5, 2]),
    "c decimal(9,2)": ([Decimal("1.25"), Decimal("-7.10"), None], [1, 1.25, Decimal("1.25"), Decimal("1.255"), Decimal("-7.1"), 10**12]),
    "s string": (["a", "", "é", None], ["a", "é", "zz"]),
    "t date": ([dt.date(2024, 1, 5), dt.date(1960, 2, 3), None], [dt.date(2024, 1, 5), dt.date(2024, 1, 6), dt.date(1900, 1, 1)]),
    "n timestamp_ntz": ([dt.datetime(2024, 3, 31, 2, 30, 0, 7), dt.datetime(1960, 1, 1, 23, 59, 59, 999999), None], [dt.datetime(2024, 3, 31, 2, 30, 0, 7), "2024-03-31 02:30:00", "1960-01-02"]),
    "b boolean": ([True, True, None], [True, False]),
}


@pytest.mark.parametrize(("form", "zone"), [(f, "UTC") for f in TYPED] + [(f, "Europe/Berlin") for f in ("t date", "n timestamp_ntz")])
def test_constants_of_any_type_prune_as_plain_filters(spark, form, zone):
    held = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        c, (values, constants) = form.split()[0], TYPED[form]
        rows = [(k, v) for k, v in enumerate(values)] + [(9, values[0]), (9, values[0]), (10, None)]
        df = blocks.saved(spark.createDataFrame(rows, f"block long, {form}").coalesce(1), "typed")
        stats = blocks.build(df, [c], ["dictionary", "bloom_s", "occupancy_s", "cluster_m", "nullspace3_s"]).collect()
        filters = [(op, c, v) for v in constants for op in ("=", "<>", "<", "<=", ">", ">=", "is distinct", "not distinct")]
        filters += [("in", c, constants[:2]), ("between", c, constants[0], constants[-1]), ("between", c, constants[-1], constants[0]), ("or", ("=", c, constants[-1]), ("is null", c)), ("and", (">=", c, constants[0]), ("is not null", c))]
        passing = df.select("block", *(F.coalesce(blocks.condition(f, df.schema), F.lit(False)).alias(f"f{i}") for i, f in enumerate(filters))).collect()
        held_in = {i: {r.block for r in passing if r[f"f{i}"]} for i in range(len(filters))}
        by_block = {}
        for r in stats:
            by_block.setdefault(r.block, []).append(r.asDict())
        skipped = 0
        for i, f in enumerate(filters):
            key = blocks.keyed(df.schema, f)
            for block, got in by_block.items():
                o = evaluate(key, blocks.columns_of(got))
                assert not (o.skips and block in held_in[i]), (f, block, o)
                assert o != Outcome.ALWAYS_TRUE or all(r[f"f{i}"] for r in passing if r.block == block), (f, block)
                skipped += o.skips
        assert skipped
    finally:
        spark.conf.set("spark.sql.session.timeZone", held)


def test_constants_beside_all_values():
    from pyspark.sql.types import IntegerType, StructType

    schema = StructType().add("x", IntegerType())
    c = {"x": Column1(5, 0, key_of(5), key_of(5), [])}
    for f, want in ((("<", "x", 5.5), Outcome.ALWAYS_TRUE), ((">", "x", 5.5), Outcome.ALWAYS_FALSE), (("<>", "x", 5.5), Outcome.ALWAYS_TRUE), (("=", "x", 5.5), Outcome.ALWAYS_FALSE), (("<", "x", 3_000_000_000), Outcome.ALWAYS_TRUE), ((">", "x", 1 << 70), Outcome.ALWAYS_FALSE), (("in", "x", [5.5, None]), Outcome.ALWAYS_FALSE), (("between", "x", 4.5, 1e30), Outcome.ALWAYS_TRUE), (("=", "x", "5"), Outcome.SOME)):
        assert evaluate(blocks.keyed(schema, f), c) == want, f


def test_null_bases():
    rng = np.random.default_rng(5)
    for p in (2, 3):
        for n in (1, 5, 12):
            a = rng.integers(0, p, (n, 10))
            v = kinds.null_basis(a, p)
            assert not ((a @ v.T) % p).any() and len(v) >= 10 - n and len({tuple(x) for x in v}) == len(v)


def test_fitted_null_spaces_take_the_better_form():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 150, dtype=np.uint64))
    probes = np.random.default_rng(2).integers(1 << 62, 1 << 63, 1000, dtype=np.uint64)
    for name in ("nullspace_s", "nullspace_m", "nullspace3_s", "nullspace3_m"):
        raw = KINDS[name].build(keys)
        assert len(raw) <= KINDS[name].budget and all(KINDS[name].may(raw, int(k), int(k)) for k in keys)
        share = sum(KINDS[name].may(raw, int(x), int(x)) for x in probes) / len(probes)
        assert share < (0.45 if name.endswith("_s") else 0.05), (name, share)
    assert kinds.FittedNullSpace(2000, 2).build(keys)[0] == 0 and kinds.FittedNullSpace(16, 2).build(keys[:45])[0] == 2


def test_prices_keep_to_the_budget(spark):
    rng = random.Random(3)
    rows = [(b, "x", k, rng.randint(5, 90), rng.randint(0, 20)) for b in range(40) for k in ("p", "q", "r")]
    df = spark.createDataFrame(rows, "block long, col string, kind string, bytes long, prunes long")
    size = {(b, k): (n, p) for b, _, k, n, p in rows}
    for budget in (0, 300, 1000, 10**6):
        got = [(r.block, r.kind) for r in assign.priced(df, budget).collect()]
        assert len({b for b, _ in got}) == len(got) and sum(size[x][0] for x in got) <= budget
        best = sum(o.prunes for o in assign.exact([assign.Option(b, k, n, p) for b, _, k, n, p in rows], min(budget, 4000)).values())
        assert sum(size[x][1] for x in got) >= (0.8 * best if budget >= 300 else 0)


def test_runs_of_characters(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(0, 9)))
    rows = [(b, rng.choice([None, word()])) for b in range(20) for _ in range(6)]
    df = blocks.saved(spark.createDataFrame(rows, "block long, t string"), "grams")
    stats = blocks.build(df, ["t"], ["ngram_s", "dictionary"]).collect()
    by_block = {}
    for r in stats:
        by_block.setdefault(r.block, []).append(r.asDict())
    skipped = 0
    for part in ["abc", "abcd", "éab", "ab", "", "zzz", "eeeee", *{t[1:5] for _, t in rows if t and len(t) > 4}]:
        f = blocks.keyed(df.schema, ("contains", "t", part))
        for b, held in by_block.items():
            o = evaluate(f, blocks.columns_of(held))
            assert not (o.skips and any(x == b and t is not None and part in t for x, t in rows)), (part, b)
            skipped += o.skips
    assert skipped > 100
