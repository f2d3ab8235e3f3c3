"""Custom operators against brute force on small tables, with nulls, ties and empty sides."""

import random

import pytest
from pyspark.sql import functions as F

from tarnlake.operators import joins, rows, windows
from tarnlake.plans import registry


def brute_asof(left, right, op, how):
    ok = {">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, "<": lambda a, b: a < b}[op]
    out, took = [], set()
    for i, k, t in left:
        best = None
        for j, k2, t2 in right:
            if None not in (k, t, k2, t2) and k == k2 and ok(t, t2) and (best is None or (t2 > best[2] if op[0] == ">" else t2 < best[2])):
                best = (j, k2, t2)
        if best:
            took.add(best[0])
        if how in ("left", "full"):
            out.append((i, best[0] if best else None))
        elif how == "semi" and best or how == "anti" and not best:
            out.append((i,))
        elif how in ("inner", "right") and best:
            out.append((i, best[0]))
    if how in ("right", "full"):
        out += [(None, j) for j, *_ in right if j not in took]
    return sorted(out, key=str)


@pytest.mark.parametrize("op", [">=", ">", "<=", "<"])
@pytest.mark.parametrize("how", ["inner", "left", "semi", "anti", "right", "full"])
def test_asof(spark, op, how):
    rng = random.Random(f"{op}{how}")
    left = [(i, rng.choice([1, 2, None]), rng.choice([None, *range(12)])) for i in range(40)]
    times = [(k, t) for k in (1, 2, None) for t in (None, 0, 3, 4, 8, 11)]  # no ties on the right
    right = [(i, k, t) for i, (k, t) in enumerate(times)]
    a, b = spark.createDataFrame(left, "i int, k int, t int"), spark.createDataFrame(right, "j int, k2 int, t2 int")
    got = joins.asof_join(a, b, "t", "t2", [("k", "k2")], op, how)
    cols = ["i"] if how in ("semi", "anti") else ["i", "j"]
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == brute_asof(left, right, op, how)
    assert joins.asof_join(a.limit(0), b, "t", "t2", [("k", "k2")], op, "left").count() == 0


@pytest.mark.parametrize("how", ["full", "right"])
def test_asof_of_rows_in_another_order_each_time(spark, how):
    """As rows come out of a shuffle on a cluster."""

    def shuffled(batches):
        import os

        for b in batches:
            yield b.sample(frac=1, random_state=int.from_bytes(os.urandom(4), "big"))

    left = [(i, i % 7, 10 * (i % 31)) for i in range(60)]
    right = [(i, i % 7, i) for i in range(300)]
    a, b = spark.createDataFrame(left, "i int, k int, t int"), spark.createDataFrame(right, "j int, k2 int, t2 int").mapInPandas(shuffled, "j int, k2 int, t2 int")
    got = joins.asof_join(a, b, "t", "t2", [("k", "k2")], ">=", how)
    assert sorted(map(tuple, got.select("i", "j").collect()), key=str) == brute_asof(left, right, ">=", how)


@pytest.mark.parametrize("op", [">=", ">", "<=", "<"])
@pytest.mark.parametrize("how", ["inner", "left", "semi", "anti"])
def test_asof_without_keys(spark, op, how):
    rng = random.Random(f"{op}{how}")
    left = [(i, 1, rng.choice([None, *range(-5, 400)])) for i in range(150)]
    right = [(i, 1, t) for i, t in enumerate([*rng.sample(range(380), 60), None, None])]
    a, b = spark.createDataFrame(left, "i int, k int, t int").repartition(5), spark.createDataFrame(right, "j int, k2 int, t2 int").repartition(3)
    got = joins.asof_join(a, b, "t", "t2", [], op, how)
    cols = ["i"] if how in ("semi", "anti") else ["i", "j"]
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == brute_asof(left, right, op, how)
    assert joins.asof_join(a, b.limit(0), "t", "t2", [], op, "left").count() == len(left)


@pytest.mark.parametrize("op", [">=", ">", "<=", "<"])
def test_one_inequality(spark, op):
    rng = random.Random(op)
    left = [(i, rng.choice([None, *range(60)])) for i in range(90)]
    right = [(i, rng.choice([None, *range(50)])) for i in range(70)]
    a, b = spark.createDataFrame(left, "i int, x int"), spark.createDataFrame(right, "j int, y int")
    ok = {">=": lambda p, q: p >= q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, "<": lambda p, q: p < q}[op]
    want = sorted((i, j) for i, p in left for j, q in right if None not in (p, q) and ok(p, q))
    assert sorted((r.i, r.j) for r in joins.inequality_join(a, b, "x", op, "y").collect()) == want
    assert joins.inequality_join(a, b.limit(0), "x", op, "y").count() == 0
    assert sorted((r.i, r.j) for r in joins.choose_join(a, b, compare=[("x", op, "y"), ("i", "<", "j")]).collect()) == [p for p in want if p[0] < p[1]]


@pytest.mark.parametrize("op, op2", [("<=", ">="), (">=", "<"), (">", "<="), ("<", ">")])
def test_totals_of_two_inequalities(spark, monkeypatch, op, op2):
    monkeypatch.setattr(joins, "SPAN", 16)  # so that lists are summed in spans
    rng = random.Random(op + op2)
    value = lambda n: rng.choice([None, *[3.0] * 9, *map(float, range(n))])  # noqa: E731  # one value of many rows
    left = [(i, value(20), value(25), rng.choice([None, *range(-5, 30)])) for i in range(120)]
    right = [(j, value(22), value(20)) for j in range(40)]
    a, b = spark.createDataFrame(left, "i int, x double, y double, v long"), spark.createDataFrame(right, "j int, x2 double, y2 double").repartition(3)
    ok = {">=": lambda p, q: p >= q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, "<": lambda p, q: p < q}
    want = []
    for j, x2, y2 in right:
        met = [(i, v) for i, x, y, v in left if None not in (x, y, x2, y2) and ok[op](x, x2) and ok[op2](y, y2)]
        held = [v for _, v in met if v is not None]
        want += [(j, x2, y2, len(met), sum(held) if held else None, sum(i for i, _ in met))] if met else []
    got = joins.pair_totals(a, b, [("x", op, "x2"), ("y", op2, "y2")], "n", {"s": "v", "t": "i"})
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert joins.pair_totals(a.limit(0), b, [("x", op, "x2"), ("y", op2, "y2")], "n", {}).count() == 0


def test_pairs_of_two_inequalities_are_not_made(spark, tmp_path):
    """Of 40,000 customers and 40,000 suppliers nearly all pair; a join that makes the pairs has 1.6 billion rows."""
    n = 40_000
    spark.range(n).selectExpr("id + 40000 AS c_custkey", "CAST(id % 7 AS DOUBLE) AS c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(n).selectExpr("id AS s_suppkey", "7D AS s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    got = registry.queries()["inequality_pair_join"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any("Join" in x and "s_acctbal#" in x for x in plan.splitlines())
    assert [tuple(r) for r in got.select("n", "s").distinct().collect()] == [(n, n * (n - 1) // 2 + n * n)] and got.count() == n


def test_merge_errors_and_nulls(spark):
    t = spark.createDataFrame([(1, 10), (2, 20), (None, 30)], "k int, v int")
    s = spark.createDataFrame([(1, 5), (1, 6), (None, 7), (9, 8)], "k int, v int")
    read = lambda df: sorted(map(tuple, df.collect()), key=str)
    with pytest.raises(Exception, match="several rows"):
        rows.merge_into(t, s, ["k"], {"v": F.col("s_v")}).collect()
    assert read(rows.merge(t, s, ["k"], [("matched", None, "nothing"), ("not matched", None, "insert")]).filter("k IS NULL OR k > 1")) == sorted([(2, 20), (None, 30), (None, 7), (9, 8)], key=str)
    with pytest.raises(Exception, match="clause that is an error"):
        rows.merge(t, s, ["k"], [("not matched", F.col("s_k") == 9, "error")]).collect()
    got = rows.merge(t, s.filter("k = 9 OR k IS NULL"), ["k"], [("not matched", None, "insert"), ("not matched by source", F.col("k") == 2, "delete")], returning=True)
    assert read(got) == sorted([(None, 7, "INSERT"), (9, 8, "INSERT"), (2, 20, "DELETE")], key=str)


def test_range_joins(spark):
    rng = random.Random(2)
    a = [(i, x, x + rng.randint(0, 60)) for i in range(60) for x in [rng.randint(-100, 100)]] + [(99, 5, 1), (98, None, 3)]
    b = [(i, x, x + rng.randint(0, 9)) for i in range(60) for x in [rng.randint(-100, 100)]]
    left, right = spark.createDataFrame(a, "i int, p int, q int"), spark.createDataFrame(b, "j int, r int, s int")
    good = [x for x in a if None not in x and x[1] <= x[2]]
    got = joins.overlap_join(left, right, ("p", "q"), ("r", "s"), 7)
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((x[0], y[0]) for x in good for y in b if x[1] <= y[2] and y[1] <= x[2])
    got = joins.within_join(left, right, "p", ("r", "s"), 7)
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((x[0], y[0]) for x in a if x[1] is not None for y in b if y[1] <= x[1] < y[2])


def test_positions(spark):
    a = spark.range(100).repartition(7)
    assert sorted((r.id, r.n) for r in joins.numbered(a, "n", F.col("id").desc()).collect()) == [(i, 99 - i) for i in range(100)]
    got = joins.positional_join(spark.range(3), spark.range(5).withColumnRenamed("id", "x"), [F.col("id")], [F.col("x").desc()])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(0, 4), (1, 3), (2, 2), (None, 1), (None, 0)], key=str)


def test_fill(spark):
    rows_in = [(1, 0, None), (1, 1, 10.0), (1, 3, None), (1, 5, 30.0), (1, 6, None), (2, 1, None), (2, 2, 7.0), (2, 9, None), (3, 1, None), (4, None, None)]
    df = spark.createDataFrame(rows_in, "g int, t int, v double")
    got = {(r.g, r.t): r.f for r in df.select("g", "t", windows.fill("v", "t", ["g"]).alias("f")).collect()}
    assert got == {(1, 0): 5.0, (1, 1): 10.0, (1, 3): 20.0, (1, 5): 30.0, (1, 6): 35.0, (2, 1): 7.0, (2, 2): 7.0, (2, 9): 7.0, (3, 1): None, (4, None): None}


def test_table_changes(spark):
    t = spark.createDataFrame([(1, 10), (2, None), (3, 30)], "k int, v int")
    s = spark.createDataFrame([(2, 200), (4, 400)], "k int, v int")
    read = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert read(rows.upsert(t, s, ["k"])) == [(1, 10), (2, 200), (3, 30), (4, 400)]
    assert read(rows.upsert(t, s, ["k"], do_nothing=True)) == [(1, 10), (2, None), (3, 30), (4, 400)]
    assert read(rows.update(t, F.col("v") > 5, v=F.lit(0))) == [(1, 0), (2, None), (3, 0)]
    assert read(rows.delete(t, F.col("v") > 5)) == [(2, None)]
    assert read(rows.merge_into(t, s, ["k"], delete_when=F.col("s_v") > 100)) == [(1, 10), (3, 30), (4, 400)]
    assert rows.limit_percent(spark.range(10), 25, F.col("id")).count() == 2
    assert rows.reservoir_sample(spark.range(50), 9).distinct().count() == 9 and rows.reservoir_sample(spark.range(3), 9).count() == 3
