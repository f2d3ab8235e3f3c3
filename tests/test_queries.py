"""Every registered query of the library runs; sources, streams and functions on small fixtures."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tarnlake.functions import fn, lookup
from tarnlake.plans import registry
from tarnlake.session import table
from tarnlake.sources import io
from tarnlake.streaming import windows

NAMES = sorted(registry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_has_a_stable_schema(spark, sf, name):
    """The same columns each time the query is made, none twice; results are told by test_results_equal_their_oracles."""
    df = registry.queries()[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns) and registry.queries()[name](spark, sf).schema == df.schema


def test_registry_has_oracles():
    assert set(registry.oracle_sql()) == set(NAMES)


def test_stream_equals_batch(spark, sf, tmp_path):
    events = table(spark, sf, "events")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    s = windows.read_stream(spark, f"{tmp_path}/in", events.schema)
    windows.drain(windows.tumbling(s, "1 day", "1 hour"), f"{tmp_path}/out", f"{tmp_path}/ck")
    want = {(r.start, r.event_type): r.n for r in windows.tumbling(events, "1 day").collect()}
    got = {(r.start, r.event_type): r.n for r in spark.read.schema("start timestamp_ntz, event_type string, n long, total double").parquet(f"{tmp_path}/out").collect()}
    last = max(k[0] for k in want)
    assert got and got.items() <= want.items()  # windows that the watermark has not passed are still open
    assert all(k in got for k in want if k[0] < last - dt.timedelta(days=1)) and s.isStreaming


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;a\n2;\n")
    (tmp_path / "b.csv").write_text("x,z\n5,q\n")
    assert io.sniff_csv(spark, f"{tmp_path}/a.csv")["delim"] == ";"
    (tmp_path / "c.csv").write_text('x,y\n1,"a ""b"", c"\n')
    assert io.read_csv(spark, f"{tmp_path}/c.csv").collect()[0].y == 'a "b", c'
    (tmp_path / "d.csv").write_text("x,y\n7,s\n")
    got = io.read_csv(spark, [f"{tmp_path}/b.csv", f"{tmp_path}/d.csv"], union_by_name=True)
    assert got.columns == ["x", "z", "y"] and got.count() == 2


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()


def test_function_values(spark):
    t = F.lit("2024-03-31 10:00:00").cast("timestamp_ntz")
    r = one(
        spark, fn.regexp_replace(F.lit("banana"), "an", "[x]"), fn.regexp_replace(F.lit("banana"), "(a)(n)", r"\2\1", "g"), fn.split_part(F.lit("a.b.c"), ".", -1),
        fn.concat(F.lit("a"), F.lit(None), F.lit("b")), fn.flatten(F.array(F.array(F.lit(1)), F.lit(None).cast("array<int>"))), fn.divide(F.lit(1), F.lit(0)),
        fn.date_diff("month", t, F.lit("2024-04-01").cast("timestamp_ntz")), fn.datesub("month", t, F.lit("2024-04-30 10:00:00").cast("timestamp_ntz")), fn.bar(F.lit(5), 0, 10, 10),
        fn.parse_dirname(F.lit("a/b/c.txt")), fn.parse_filename(F.lit("a/b/c.txt"), True), fn.parse_path(F.lit("/a/b")), fn.even(F.lit(-2.5)), fn.list_resize(F.array(F.lit(1)), 3, 0), fn.json_valid(F.lit("{}x")),
    )
    assert tuple(r) == ("b[x]ana", "bnanaa", "c", "ab", [1], float("inf"), 1, 1, "█████     ", "a", "c", ["/", "a", "b"], -4.0, [1, 0, 0], False)


def test_lookup():
    for name in ("list_sort", "list", "if", "sha256", "arg_min", "json_keys", "lower", "to_base64", "array_has", "kurtosis_pop"):
        assert callable(lookup(name))
    with pytest.raises(AttributeError):
        lookup("no_such_function")


def test_stream_of_distinct_events(spark, sf, tmp_path):
    """Repeats within the watermark go, in a stream as in a table."""
    events = table(spark, sf, "events").limit(200)
    events.unionAll(events.limit(50)).repartition(2).write.parquet(f"{tmp_path}/in")
    s = windows.read_stream(spark, f"{tmp_path}/in", events.schema)
    windows.drain(windows.distinct_events(s, ["event_id"], "100 days").select("event_id"), f"{tmp_path}/out", f"{tmp_path}/ck")
    got = sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = sorted(r.event_id for r in windows.distinct_events(spark.read.parquet(f"{tmp_path}/in"), ["event_id"]).collect())
    assert got == want and len(got) == 200


def test_results_do_not_hang_on_the_zone(spark, sf):
    """Queries over times give the same in a session of another zone."""
    names = ("fn_date_parts", "fn_date_diff", "fn_date_make", "fn_intervals", "fn_date_more", "event_tumbling", "event_sliding", "event_sessions", "log_days")
    read = lambda: {n: sorted(map(str, registry.queries()[n](spark, sf).collect())) for n in names}
    held = spark.conf.get("spark.sql.session.timeZone")
    want = read()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert read() == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", held)


def test_results_equal_their_oracles(spark, sf):
    """Every registered query against its oracle SQL on the smallest tables."""
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "conversations", "embeddings", "documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")

    def plain(v):
        if isinstance(v, (float, Decimal)):
            return f"{float(v) + 0.0:.9g}"  # of zeros one
        return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v

    wrong = []
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, sf)
        rel = con.execute(sql)
        names = [x[0] for x in rel.description]
        got = sorted(repr([plain(r[c]) for c in sorted(names)]) for r in df.collect()) if sorted(df.columns) == sorted(names) else None
        order = [names.index(c) for c in sorted(names)]
        if got != sorted(repr([plain(r[i]) for i in order]) for r in rel.fetchall()):
            wrong.append(name)
    assert not wrong
