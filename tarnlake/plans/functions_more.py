"""Further members of the function families, under the names that users know them by, each against an oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions import fn
from tarnlake.plans.functions import _grouped, _j, _json, _select, c, r6
from tarnlake.session import table

SUMS = _grouped(
    "supplier", "s_nationkey",
    n=lambda: F.count("*"), av=lambda: fn.any_value(F.lit(3)), ar=lambda: fn.arbitrary(F.lit("x")), sn=lambda: fn.sum_no_overflow("s_suppkey"), fs=r6(lambda: fn.fsum(c("s_acctbal"))), ks=r6(lambda: fn.kahan_sum(c("s_acctbal"))),
    me=r6(lambda: fn.mean("s_acctbal")), fa=r6(lambda: fn.favg("s_acctbal")), q=lambda: fn.quantile(c("s_suppkey"), 0.4), sd=r6(lambda: fn.stddev("s_acctbal")), va=lambda: F.round(fn.variance("s_acctbal") / 1000, 2),
    xy=lambda: F.round(F.regr_sxy("s_acctbal", "s_suppkey") / 1000, 3), yy=lambda: F.round(F.regr_syy("s_acctbal", "s_suppkey") / 1000, 2), gc=lambda: fn.string_agg(c("s_name"), ";", c("s_suppkey")), aa=lambda: F.to_json(fn.list_ordered(c("s_suppkey"), c("s_suppkey"))),
    mb=lambda: F.min_by("s_name", "s_acctbal"), xb=lambda: F.max_by("s_name", "s_acctbal"), ba=lambda: fn.bitstring_agg(c("s_nationkey"), 0, 24),
    hx=lambda: F.element_at(fn.histogram_exact(c("s_nationkey"), [0, 3, 7]), 3),
)
SUMS_SQL = f"""SELECT s_nationkey, count_star() AS n, any_value(3) AS av, arbitrary('x') AS ar, CAST(sum_no_overflow(CAST(s_suppkey AS INT)) AS BIGINT) AS sn, round(fsum(s_acctbal), 6) AS fs, round(kahan_sum(s_acctbal), 6) AS ks, round(mean(s_acctbal), 6) AS me, round(favg(s_acctbal), 6) AS fa, quantile(s_suppkey, 0.4) AS q,
    round(stddev(s_acctbal), 6) AS sd, round(variance(s_acctbal) / 1000, 2) AS va, round(regr_sxy(s_acctbal, s_suppkey) / 1000, 3) AS xy, round(regr_syy(s_acctbal, s_suppkey) / 1000, 2) AS yy, group_concat(s_name, ';' ORDER BY s_suppkey) AS gc, {_j('array_agg(s_suppkey ORDER BY s_suppkey)')} AS aa,
    min_by(s_name, s_acctbal) AS mb, max_by(s_name, s_acctbal) AS xb, CAST(bitstring_agg(s_nationkey, 0, 24) AS VARCHAR) AS ba, count(*) FILTER (s_nationkey = 3) AS hx FROM supplier GROUP BY s_nationkey"""


def extremes(spark: SparkSession, d: str) -> DataFrame:
    """Values at the smallest and largest key, where values may be null."""
    x = table(spark, d, "orders").withColumn("v", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")))
    by = c("o_totalprice")
    return x.groupBy("o_custkey").agg(fn.arg_min(c("v"), by).alias("a"), fn.arg_max(c("v"), by).alias("b"), fn.arg_min_null(c("v"), by).alias("an"), fn.arg_max_null(c("v"), by).alias("bn"))


EXTREMES_SQL = "SELECT o_custkey, arg_min(v, o_totalprice) AS a, arg_max(v, o_totalprice) AS b, arg_min_null(v, o_totalprice) AS an, arg_max_null(v, o_totalprice) AS bn FROM (SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS v FROM orders) GROUP BY o_custkey"

HISTOGRAMS = _grouped("orders", "o_orderstatus", h=lambda: F.to_json(F.array_sort(F.map_entries(fn.histogram(c("o_orderpriority"))))))
HISTOGRAMS_SQL = f"SELECT o_orderstatus, {_j('list_transform(list_sort(map_keys(h)), lambda k: {key: k, value: h[k]})')} AS h FROM (SELECT o_orderstatus, histogram(o_orderpriority) AS h FROM orders GROUP BY 1)"

TEXTS = _select(
    "customer", ["c_custkey"],
    bl=lambda: F.bit_length("c_name").cast("long"), od=lambda: fn.ord(c("c_name")), pf=lambda: fn.prefix(c("c_name"), F.lit("Cust")), sf=lambda: fn.suffix(c("c_name"), F.lit("7")), po=lambda: F.position(F.lit("#"), c("c_name")).cast("long"),
    lg=lambda: fn.left_grapheme(c("c_name"), 3), rg=lambda: fn.right_grapheme(c("c_name"), 2), sg=lambda: fn.substring_grapheme(c("c_name"), 2, 3), su=lambda: F.substring("c_name", 3, 4), lt=lambda: F.ltrim(F.concat(F.lit("  "), c("c_name"))), rt=lambda: F.rtrim(F.concat(c("c_name"), F.lit("  "))),
    ss=_json(lambda: fn.string_split(c("c_mktsegment"), "I")), re=lambda: fn.regexp_escape(F.concat(c("c_name"), F.lit(".*"))), uh=lambda: F.decode(F.unhex(F.hex("c_name")), "UTF-8"), ud=lambda: F.url_decode(F.url_encode("c_name")),
    pr=lambda: F.printf(F.lit("%d-%s"), c("c_custkey"), c("c_mktsegment")), fn=lambda: fn.parse_filename(F.concat(F.lit("a/b/"), c("c_mktsegment"), F.lit(".txt"))), dp=lambda: fn.parse_dirpath(F.concat(F.lit("a/b/"), c("c_mktsegment"))), ty=lambda: F.upper(F.typeof("c_custkey")), md=lambda: F.md5("c_name"),
    mm=lambda: fn.mismatches(F.lpad("c_mktsegment", 10, "x"), F.lpad("c_name", 10, "x")), iff=lambda: fn.if_(c("c_custkey") % 2 == 0, F.lit("even"), F.lit("odd")), ifn=lambda: fn.ifnull(F.nullif(c("c_nationkey"), F.lit(3)), F.lit(-1)),
)
TEXTS_SQL = f"""SELECT c_custkey, bit_length(c_name) AS bl, CAST(ord(c_name) AS INT) AS od, prefix(c_name, 'Cust') AS pf, suffix(c_name, '7') AS sf, position('#' IN c_name) AS po, left_grapheme(c_name, 3) AS lg, right_grapheme(c_name, 2) AS rg, substring_grapheme(c_name, 2, 3) AS sg,
    substring(c_name, 3, 4) AS su, ltrim('  ' || c_name) AS lt, rtrim(c_name || '  ') AS rt, {_j("str_split(c_mktsegment, 'I')")} AS ss, regexp_escape(c_name || '.*') AS re, decode(unhex(hex(c_name))) AS uh, url_decode(url_encode(c_name)) AS ud, printf('%d-%s', c_custkey, c_mktsegment) AS pr,
    parse_filename('a/b/' || c_mktsegment || '.txt') AS fn, parse_dirpath('a/b/' || c_mktsegment) AS dp, typeof(c_custkey) AS ty, md5(c_name) AS md, CAST(mismatches(lpad(c_mktsegment, 10, 'x'), lpad(c_name, 10, 'x')) AS BIGINT) AS mm, if(c_custkey % 2 = 0, 'even', 'odd') AS iff, ifnull(nullif(c_nationkey, 3), -1) AS ifn FROM customer"""

SUM = _select(
    "supplier", ["s_suppkey"],
    ad=r6(lambda: fn.add("s_acctbal", F.lit(1.5))), sb=r6(lambda: fn.subtract("s_acctbal", F.lit(1.5))), mu=r6(lambda: fn.multiply("s_acctbal", F.lit(2))), dv=r6(lambda: fn.divide("s_acctbal", F.col("s_nationkey") % 3 + 1)), md=lambda: fn.mod(c("s_suppkey"), F.lit(7)).cast("long"), fd=lambda: fn.fdiv(c("s_acctbal"), F.lit(7)).cast("double"), fm=r6(lambda: fn.fmod(c("s_acctbal"), F.lit(7))),
    lg=r6(lambda: F.log10(F.abs("s_acctbal") + 1)), ac=r6(lambda: F.acosh(c("s_suppkey"))), at=r6(lambda: F.atanh(c("s_nationkey") / 30)), nn=lambda: F.isnan("s_acctbal"),
)
SUM_SQL = "SELECT s_suppkey, round(add(s_acctbal, 1.5), 6) AS ad, round(subtract(s_acctbal, 1.5), 6) AS sb, round(multiply(s_acctbal, 2), 6) AS mu, round(divide(s_acctbal, s_nationkey % 3 + 1), 6) AS dv, mod(s_suppkey, 7) AS md, fdiv(s_acctbal, 7) AS fd, round(fmod(s_acctbal, 7), 6) AS fm, round(log(abs(s_acctbal) + 1), 6) AS lg, round(acosh(s_suppkey), 6) AS ac, round(atanh(s_nationkey / 30), 6) AS at, isnan(s_acctbal) AS nn FROM supplier"

DATES = _select(
    "orders", ["o_orderkey"],
    dd=lambda: fn.datediff("day", F.lit("1996-05-05 00:00:00").cast("timestamp_ntz"), c("o_orderdate")), ds=lambda: fn.datesub("month", F.lit("1996-05-05 00:00:00").cast("timestamp_ntz"), c("o_orderdate")), wy=lambda: F.weekofyear("o_orderdate").cast("long"), dw=lambda: fn.dayofweek("o_orderdate").cast("long"), dm=lambda: F.dayofmonth("o_orderdate").cast("long"),
    en=lambda: fn.epoch_ns(c("o_orderdate")), ts=lambda: fn.try_strptime(F.lit("1999-02-03"), "%Y-%m-%d").cast("timestamp_ntz"), tn=lambda: fn.try_strptime(F.lit("nope"), "%Y-%m-%d").cast("timestamp_ntz"),
    y=lambda: (c("o_orderdate") + fn.to_years(F.lit(2))).cast("timestamp_ntz"), q=lambda: (c("o_orderdate") + fn.to_quarters(F.lit(3))).cast("timestamp_ntz"), de=lambda: (c("o_orderdate") + fn.to_decades(F.lit(1))).cast("timestamp_ntz"), ce=lambda: (c("o_orderdate") + fn.to_centuries(F.lit(1))).cast("timestamp_ntz"), ml=lambda: (c("o_orderdate") + fn.to_millennia(F.lit(1))).cast("timestamp_ntz"),
    da=lambda: (c("o_orderdate") + fn.to_days(F.lit(9))).cast("timestamp_ntz"), mi=lambda: (c("o_orderdate") + fn.to_minutes(F.lit(90))).cast("timestamp_ntz"), se=lambda: (c("o_orderdate") + fn.to_seconds(F.lit(61))).cast("timestamp_ntz"), ms=lambda: (c("o_orderdate") + fn.to_milliseconds(F.lit(1500))).cast("timestamp_ntz"), us=lambda: (c("o_orderdate") + fn.to_microseconds(F.lit(7))).cast("timestamp_ntz"),
    ns=lambda: F.date_format(fn.make_timestamp_ns(F.lit(1_700_000_000_123_456_789)), "yyyy-MM-dd HH:mm"),
)
DATES_SQL = """SELECT o_orderkey, datediff('day', TIMESTAMP '1996-05-05', o_orderdate) AS dd, datesub('month', TIMESTAMP '1996-05-05', o_orderdate) AS ds, weekofyear(o_orderdate) AS wy, dayofweek(o_orderdate) AS dw, dayofmonth(o_orderdate) AS dm, epoch_ns(o_orderdate) AS en, try_strptime('1999-02-03', '%Y-%m-%d') AS ts, try_strptime('nope', '%Y-%m-%d') AS tn,
    o_orderdate + to_years(2) AS y, o_orderdate + to_quarters(3) AS q, o_orderdate + to_decades(1) AS de, o_orderdate + to_centuries(1) AS ce, o_orderdate + to_millennia(1) AS ml, o_orderdate + to_days(9) AS da, o_orderdate + to_minutes(90) AS mi, o_orderdate + to_seconds(61) AS se, o_orderdate + to_milliseconds(1500) AS ms, o_orderdate + to_microseconds(7) AS us,
    strftime(make_timestamp_ns(1700000000123456789), '%Y-%m-%d %H:%M') AS ns FROM orders"""


def _l():
    return F.array(c("n_nationkey"), c("n_regionkey"), F.lit(4), F.lit(None).cast("int"))


L = "[n_nationkey, n_regionkey, 4, NULL]"
VEC, WEC = "CAST([n_nationkey + 1, 2, 3] AS DOUBLE[3])", "CAST([1, n_regionkey, 0.5] AS DOUBLE[3])"


def _v():
    d = "double"
    return F.array((c("n_nationkey") + 1).cast(d), F.lit(2.0), F.lit(3.0)), F.array(F.lit(1.0), c("n_regionkey").cast(d), F.lit(0.5))


LISTS = _select(
    "nation", ["n_nationkey"],
    lv=_json(lambda: fn.list_value(c("n_nationkey"), c("n_regionkey"))), le=lambda: fn.element_at(_l(), F.lit(2)), lh=lambda: fn.list_has(_l(), F.lit(4)), ac=lambda: fn.array_contains(fn.list_value(c("n_nationkey"), c("n_regionkey")), F.lit(7)), li=lambda: fn.list_position(_l(), F.lit(4)).cast("long"), rs=_json(lambda: fn.list_reverse_sort(fn.list_value(c("n_nationkey"), c("n_regionkey"), F.lit(4)))),
    ap=_json(lambda: fn.list_apply(fn.list_value(c("n_nationkey"), c("n_regionkey")), lambda x: x + 1)), ag=lambda: fn.list_aggregate(_l(), "sum").cast("long"), am=lambda: fn.list_aggregate(_l(), "max").cast("long"), al=lambda: fn.array_length(_l()).cast("long"), ts=lambda: fn.array_to_string(fn.list_value(c("n_name"), F.lit("x")), "-"),
    cs=r6(lambda: fn.array_cosine_similarity(*_v())), cd=r6(lambda: fn.array_cosine_distance(*_v())), di=r6(lambda: fn.array_distance(*_v())), ip=r6(lambda: fn.array_inner_product(*_v())), dp=r6(lambda: fn.array_dot_product(*_v())), np=r6(lambda: fn.array_negative_inner_product(*_v())),
    pb=_json(lambda: fn.array_push_back(fn.list_value(c("n_nationkey")), F.lit(9))), pf=_json(lambda: fn.array_push_front(fn.list_value(c("n_nationkey")), F.lit(9))), se=_json(lambda: fn.list_select(fn.list_value(c("n_nationkey"), c("n_regionkey"), F.lit(4)), F.array(F.lit(3), F.lit(1)))), wh=_json(lambda: fn.list_where(fn.list_value(c("n_nationkey"), c("n_regionkey")), F.array(F.lit(True), F.lit(False)))),
    re=_json(lambda: fn.array_resize(fn.list_value(c("n_nationkey")), 2, 0)), ma=lambda: F.element_at(F.map_from_entries(F.array(F.struct(F.lit("k"), c("n_nationkey")))), "k"), me=lambda: F.size(F.map_entries(F.create_map(F.lit("k"), c("n_nationkey")))).cast("long"), sx=lambda: fn.struct_extract(fn.struct_update(F.struct(c("n_name").alias("x")), x=F.lit("new")), "x"), sp=lambda: fn.struct_extract(fn.row(c("n_name").alias("x")), "x"),
)
LISTS_SQL = f"""SELECT n_nationkey, {_j('list_value(n_nationkey, n_regionkey)')} AS lv, list_element({L}, 2) AS le, list_has({L}, 4) AS lh, array_contains([n_nationkey, n_regionkey], 7) AS ac, CAST(list_indexof({L}, 4) AS BIGINT) AS li, {_j('list_reverse_sort([n_nationkey, n_regionkey, 4])')} AS rs, {_j('list_apply([n_nationkey, n_regionkey], lambda x: x + 1)')} AS ap,
    CAST(list_aggr({L}, 'sum') AS BIGINT) AS ag, CAST(list_aggr({L}, 'max') AS BIGINT) AS am, array_length({L}) AS al, array_to_string([n_name, 'x'], '-') AS ts, round(array_cosine_similarity({VEC}, {WEC}), 6) AS cs, round(array_cosine_distance({VEC}, {WEC}), 6) AS cd, round(array_distance({VEC}, {WEC}), 6) AS di, round(array_inner_product({VEC}, {WEC}), 6) AS ip,
    round(array_dot_product({VEC}, {WEC}), 6) AS dp, round(array_negative_inner_product({VEC}, {WEC}), 6) AS np, {_j('array_push_back([n_nationkey], 9)')} AS pb, {_j('array_push_front([n_nationkey], 9)')} AS pf, {_j('array_select([n_nationkey, n_regionkey, 4], [3, 1])')} AS se, {_j('array_where([n_nationkey, n_regionkey], [true, false])')} AS wh, {_j('array_resize([n_nationkey], 2, 0)')} AS re,
    map_from_entries([{{'k': 'k', 'v': n_nationkey}}])['k'] AS ma, len(map_entries(MAP {{'k': n_nationkey}})) AS me, struct_extract(struct_update({{'x': n_name}}, x := 'new'), 'x') AS sx, struct_extract(struct_pack(x := n_name), 'x') AS sp FROM nation"""

DOCS = _select(
    "nation", ["n_nationkey"],
    at=lambda: fn.array_to_json(F.array(c("n_nationkey"), c("n_regionkey"))), rt=lambda: fn.row_to_json(F.struct(c("n_nationkey").alias("a"), c("n_name").alias("b"))), ep=lambda: fn.json_extract_path(F.lit('{"a":[1,"x"]}'), "$.a[1]"), et=lambda: fn.json_extract_path_text(F.lit('{"a":[1,"x"]}'), "$.a[1]"), jt=lambda: fn.json_transform(F.concat(F.lit('{"k":'), c("n_nationkey").cast("string"), F.lit("}")), "k INT")["k"],
    ec=lambda: fn.enum_first(["x", "y", "z"]), el=lambda: fn.enum_last(["x", "y", "z"]), er=_json(lambda: fn.enum_range(["x", "y", "z"])), eb=_json(lambda: fn.enum_range_boundary(["x", "y", "z"], "y", None)),
)
ENUM = "ENUM ('x', 'y', 'z')"
DOCS_SQL = f"""SELECT n_nationkey, CAST(array_to_json([n_nationkey, n_regionkey]) AS VARCHAR) AS at, CAST(row_to_json({{'a': n_nationkey, 'b': n_name}}) AS VARCHAR) AS rt, CAST(json_extract_path('{{"a":[1,"x"]}}', '$.a[1]') AS VARCHAR) AS ep, json_extract_path_text('{{"a":[1,"x"]}}', '$.a[1]') AS et, json_transform('{{"k":' || n_nationkey || '}}', '{{"k":"INTEGER"}}').k AS jt,
    CAST(enum_first(CAST(NULL AS {ENUM})) AS VARCHAR) AS ec, CAST(enum_last(CAST(NULL AS {ENUM})) AS VARCHAR) AS el, {_j(f'enum_range(CAST(NULL AS {ENUM}))')} AS er, {_j(f"enum_range_boundary(CAST('y' AS {ENUM}), CAST(NULL AS {ENUM}))")} AS eb FROM nation"""
JSON_GROUPS = _grouped("nation", "n_regionkey", ga=lambda: F.array_join(F.array_sort(F.from_json(fn.json_group_array(c("n_nationkey")), "array<int>")), ","), go=lambda: F.size(F.map_keys(F.from_json(fn.json_group_object(c("n_name"), c("n_nationkey")), "map<string,int>"))).cast("long"), gs=lambda: fn.json_group_structure(F.concat(F.lit('{"a":'), c("n_nationkey").cast("string"), F.lit("}"))))

ITEMS = {
    "fn_sums": (SUMS, SUMS_SQL),
    "fn_extremes": (extremes, EXTREMES_SQL),
    "fn_histograms": (HISTOGRAMS, HISTOGRAMS_SQL),
    "fn_text_more": (TEXTS, TEXTS_SQL),
    "fn_operators": (SUM, SUM_SQL),
    "fn_date_more": (DATES, DATES_SQL),
    "fn_lists_more": (LISTS, LISTS_SQL),
    "fn_json_more": (DOCS, DOCS_SQL),
    "fn_json_groups_more": (JSON_GROUPS, "SELECT n_regionkey, string_agg(n_nationkey, ',' ORDER BY n_nationkey) AS ga, count(*) AS go, 'OBJECT<a: BIGINT>' AS gs FROM nation GROUP BY n_regionkey"),
}
