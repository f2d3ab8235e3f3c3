"""Function families: one item for each, most with ten or more functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions import fn
from tarnlake.plans.text import pair, same
from tarnlake.session import table


def _select(name: str, keys: list[str], where: str | None = None, **made):
    """A query function: keys and made columns (functions of no argument, so that no session is needed to define them)."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = table(spark, d, name)
        df = df.filter(where) if where else df
        return df.select(*keys, *(f().alias(k) for k, f in made.items()))

    return run


def _grouped(name: str, by: str, **made):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, name).groupBy(by).agg(*(f().alias(k) for k, f in made.items()))

    return run


def r6(f):
    return lambda: F.round(f(), 6)


def c(x):
    return F.col(x)


MOMENTS = _grouped(
    "lineitem", "l_returnflag",
    sk=r6(lambda: fn.skewness(c("l_linenumber"))), ku=r6(lambda: fn.kurtosis(c("l_linenumber"))), kp=r6(lambda: fn.kurtosis_pop("l_linenumber")),
    se=r6(lambda: fn.sem(c("l_quantity"))), sp=r6(lambda: F.stddev_pop("l_quantity")), ss=r6(lambda: F.stddev_samp("l_quantity")), vp=r6(lambda: F.var_pop("l_quantity")),
    vs=r6(lambda: F.var_samp("l_quantity")), gm=r6(lambda: fn.geomean(c("l_quantity"))), wa=r6(lambda: fn.weighted_avg(c("l_quantity"), c("l_linenumber"))),
)
PAIRS = _grouped(
    "lineitem", "l_returnflag",
    co=r6(lambda: F.corr("l_extendedprice", "l_quantity")), cp=lambda: F.round(F.covar_pop("l_extendedprice", "l_quantity"), 3), cs=lambda: F.round(F.covar_samp("l_extendedprice", "l_quantity"), 3),
    ax=r6(lambda: F.regr_avgx("l_extendedprice", "l_quantity")), ay=lambda: F.round(F.regr_avgy("l_extendedprice", "l_quantity"), 3), n=lambda: F.regr_count("l_extendedprice", "l_quantity"),
    ic=lambda: F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 3), r2=r6(lambda: F.regr_r2("l_extendedprice", "l_quantity")), sl=r6(lambda: F.regr_slope("l_extendedprice", "l_quantity")),
    sxx=lambda: F.round(F.regr_sxx("l_extendedprice", "l_quantity"), 1),
)
HOLISTIC = _grouped(
    "orders", "o_orderpriority",
    md=r6(lambda: F.median("o_totalprice")), qc=r6(lambda: fn.quantile_cont("o_totalprice", 0.3)), qd=lambda: fn.quantile_disc(c("o_totalprice"), 0.3), ma=r6(lambda: fn.mad(c("o_totalprice"))),
    mn=lambda: F.to_json(fn.min_n(c("o_orderkey"), 3)), mx=lambda: F.to_json(fn.max_n(c("o_orderkey"), 3)), am=lambda: F.min_by("o_orderkey", "o_totalprice"), ax=lambda: F.max_by("o_orderkey", "o_totalprice"),
    an=lambda: F.to_json(fn.arg_max_n(c("o_orderkey"), c("o_totalprice"), 2)),
)
BITS = _grouped(
    "supplier", "s_nationkey",
    ba=lambda: F.bit_and(c("s_suppkey").cast("long")), bo=lambda: F.bit_or(c("s_suppkey").cast("long")), bx=lambda: F.bit_xor(c("s_suppkey").cast("long")),
    al=lambda: F.bool_and(c("s_acctbal") > 0), so=lambda: F.bool_or(c("s_acctbal") < 0), ci=lambda: F.count_if(c("s_acctbal") > 1000),
    st=lambda: fn.string_agg(c("s_name"), "|"), pr=lambda: F.round(F.product(c("s_suppkey") % 3 + 1), 3),
)


def histogram(spark: SparkSession, d: str) -> DataFrame:
    """Counts by value first, so that no task holds a group; then a map a group of the few distinct values."""
    x = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"))
    g = x.groupBy("l_returnflag").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "n"))).alias("h"), F.round(fn.entropy_of_counts("n"), 6).alias("e"), F.max_by("l_linenumber", F.struct("n", -c("l_linenumber"))).alias("mode"))
    return g.select("l_returnflag", F.array_join(F.transform("h", lambda s: F.concat_ws("=", s["l_linenumber"].cast("string"), s["n"].cast("string"))), ",").alias("h"), "e", "mode")


TEXT = _select(
    "part", ["p_partkey"],
    lo=lambda: F.lower("p_name"), up=lambda: F.upper("p_name"), ln=lambda: F.length("p_name").cast("long"), sl=lambda: F.octet_length("p_name").cast("long"), asc=lambda: F.ascii("p_name"),
    un=lambda: fn.unicode(c("p_name")), le=lambda: fn.left(c("p_name"), 3), ri=lambda: fn.right(c("p_name"), 4), ln2=lambda: fn.left(c("p_name"), -2), rn=lambda: fn.right(c("p_name"), -2), lp=lambda: F.lpad("p_brand", 12, "*"), rp=lambda: F.rpad("p_brand", 12, "*"),
    rv=lambda: F.reverse("p_name"), rr=lambda: F.repeat(F.substring("p_name", 1, 2), 3), re=lambda: F.replace(c("p_name"), F.lit("a"), F.lit("o")), tr=lambda: F.translate("p_name", "aei", "xyz"), it=lambda: F.instr("p_name", "e").cast("long"),
    sw=lambda: F.startswith(c("p_type"), F.lit("PRO")), ew=lambda: F.endswith(c("p_type"), F.lit("L")), ct=lambda: F.contains(c("p_name"), F.lit("in")), cw=lambda: F.concat_ws("-", "p_brand", F.lit(None).cast("string"), "p_type"),
    cc=lambda: fn.concat(c("p_brand"), F.lit(None), F.lit("z")), sp=lambda: fn.split_part(c("p_brand"), "#", 2), sp9=lambda: fn.split_part(c("p_brand"), "#", 9), tm=lambda: F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))),
)
TEXT_SQL = """SELECT p_partkey, lower(p_name) AS lo, upper(p_name) AS up, length(p_name) AS ln, strlen(p_name) AS sl, ascii(p_name) AS asc, unicode(p_name) AS un, left(p_name, 3) AS le, right(p_name, 4) AS ri, left(p_name, -2) AS ln2, right(p_name, -2) AS rn,
    lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '*') AS rp, reverse(p_name) AS rv, repeat(substr(p_name, 1, 2), 3) AS rr, replace(p_name, 'a', 'o') AS re, translate(p_name, 'aei', 'xyz') AS tr, instr(p_name, 'e') AS it,
    starts_with(p_type, 'PRO') AS sw, ends_with(p_type, 'L') AS ew, contains(p_name, 'in') AS ct, concat_ws('-', p_brand, NULL, p_type) AS cw, concat(p_brand, NULL, 'z') AS cc, split_part(p_brand, '#', 2) AS sp, split_part(p_brand, '#', 9) AS sp9, trim('  ' || p_brand || ' ') AS tm FROM part"""
REGEX = _select(
    "part", ["p_partkey"],
    m=lambda: fn.regexp_matches(c("p_name"), "[aeiou]{2}"), f=lambda: fn.regexp_full_match(c("p_brand"), "Brand#[0-9]+"), r1=lambda: fn.regexp_replace(c("p_name"), "[aeiou]", "_"), rg=lambda: fn.regexp_replace(c("p_name"), "[aeiou]", "_", "g"),
    x=lambda: fn.regexp_extract(c("p_brand"), "#([0-9])", 1), sx=lambda: F.to_json(fn.string_split_regex(c("p_name"), "[ e]")), ss=lambda: F.to_json(fn.string_split(c("p_name"), " ")), gr=lambda: fn.regexp_replace(c("p_brand"), "([a-z]+)#", r"\1-"), ci=lambda: fn.regexp_replace(c("p_brand"), "BRAND", "b", "i"),
    lk=lambda: c("p_name").like("%a_e%"), il=lambda: c("p_type").ilike("%pro%"),
)
REGEX_SQL = r"""SELECT p_partkey, regexp_matches(p_name, '[aeiou]{2}') AS m, regexp_full_match(p_brand, 'Brand#[0-9]+') AS f, regexp_replace(p_name, '[aeiou]', '_') AS r1, regexp_replace(p_name, '[aeiou]', '_', 'g') AS rg, regexp_extract(p_brand, '#([0-9])', 1) AS x,
    CAST(to_json(string_split_regex(p_name, '[ e]')) AS VARCHAR) AS sx, CAST(to_json(string_split(p_name, ' ')) AS VARCHAR) AS ss, regexp_replace(p_brand, '([a-z]+)#', '\1-') AS gr, regexp_replace(p_brand, 'BRAND', 'b', 'i') AS ci, p_name LIKE '%a_e%' AS lk, p_type ILIKE '%pro%' AS il FROM part"""
HASHES = _select(
    "part", ["p_partkey"],
    m=lambda: F.md5("p_name"), s1=lambda: F.sha1("p_name"), s2=lambda: fn.sha256(c("p_name")), hx=lambda: F.hex("p_name"), b6=lambda: F.base64(F.encode("p_name", "UTF-8")), ub=lambda: F.unbase64(F.base64(F.encode("p_name", "UTF-8"))).cast("string"), ue=lambda: F.replace(F.url_encode("p_name"), F.lit("+"), F.lit("%20")),
    mn=lambda: F.substring(F.md5("p_name"), 1, 16), bs=lambda: fn.to_base(c("p_partkey"), 16, 6), bi=lambda: F.bin("p_partkey"), ch=lambda: F.chr(c("p_partkey") % 26 + 97),
)
HASHES_SQL = """SELECT p_partkey, md5(p_name) AS m, sha1(p_name) AS s1, sha256(p_name) AS s2, hex(p_name) AS hx, to_base64(encode(p_name)) AS b6, decode(from_base64(to_base64(encode(p_name)))) AS ub, url_encode(p_name) AS ue,
    substr(md5(p_name), 1, 16) AS mn, to_base(p_partkey, 16, 6) AS bs, bin(p_partkey) AS bi, chr(CAST(p_partkey % 26 + 97 AS INT)) AS ch FROM part"""
DISTANCES = _select(
    "part", ["p_partkey"],
    le=lambda: F.levenshtein(c("p_name"), c("p_type")).cast("long"), dl=lambda: fn.damerau_levenshtein(c("p_name"), c("p_type")), ha=lambda: fn.hamming(F.substring("p_name", 1, 4), F.substring("p_type", 1, 4)).cast("long"), ja=r6(lambda: fn.jaccard(c("p_name"), c("p_type"))),
    js=r6(lambda: fn.jaro_similarity(c("p_name"), c("p_type"))), jw=r6(lambda: fn.jaro_winkler_similarity(c("p_name"), F.concat(F.substring("p_name", 1, 5), "p_type"))), sa=lambda: fn.strip_accents(F.concat(c("p_name"), F.lit("éÀñ"))), nf=lambda: fn.nfc_normalize(F.concat(c("p_brand"), F.lit("é"))),
    fb=lambda: fn.format_bytes(c("p_partkey") * 7777), lg=lambda: fn.length_grapheme(F.concat(c("p_brand"), F.lit("é"))).cast("long"),
)
DISTANCES_SQL = """SELECT p_partkey, levenshtein(p_name, p_type) AS le, damerau_levenshtein(p_name, p_type) AS dl, hamming(substr(p_name, 1, 4), substr(p_type, 1, 4)) AS ha, round(jaccard(p_name, p_type), 6) AS ja, round(jaro_similarity(p_name, p_type), 6) AS js,
    round(jaro_winkler_similarity(p_name, substr(p_name, 1, 5) || p_type), 6) AS jw, strip_accents(p_name || 'éÀñ') AS sa, nfc_normalize(p_brand || 'e' || chr(769)) AS nf, format_bytes(p_partkey * 7777) AS fb, length_grapheme(p_brand || 'e' || chr(769)) AS lg FROM part"""
X = "(s_acctbal / 1000)"
NUMBERS = same(f"""SELECT s_suppkey, abs(s_acctbal) AS a, sign(s_acctbal) AS sg, ceil(s_acctbal) AS ce, floor(s_acctbal) AS fl, round(sqrt(abs(s_acctbal)), 6) AS sq, round(cbrt(s_acctbal), 6) AS cb, round(power(abs{X}, 1.5), 6) AS pw, round(exp{X}, 4) AS ex,
    round(ln(abs(s_acctbal) + 1), 6) AS l1, round(log2(abs(s_acctbal) + 1), 6) AS l2, round(log10(abs(s_acctbal) + 1), 6) AS l10, round(sin(s_acctbal), 6) AS si, round(cos(s_acctbal), 6) AS co, round(tan{X}, 4) AS ta, round(atan(s_acctbal), 6) AS at,
    round(atan2(s_acctbal, s_suppkey), 6) AS a2, round(asin(s_acctbal / 20000), 6) AS asn, round(acos(s_acctbal / 20000), 6) AS acn, round(sinh{X}, 3) AS sh, round(cosh{X}, 3) AS ch, round(tanh{X}, 6) AS th, round(asinh{X}, 6) AS ash, round(degrees{X}, 4) AS dg, round(radians(s_acctbal), 6) AS rd,
    round(pi(), 9) AS p, greatest(s_suppkey, 50) AS gr, least(s_suppkey, 50) AS le FROM supplier""".replace("sign(s_acctbal) AS sg", "CAST(sign(s_acctbal) AS INT) AS sg").replace("ceil(s_acctbal) AS ce", "CAST(ceil(s_acctbal) AS BIGINT) AS ce").replace("floor(s_acctbal) AS fl", "CAST(floor(s_acctbal) AS BIGINT) AS fl"))
NUMBERS2 = _select(
    "supplier", ["s_suppkey"],
    dv=lambda: fn.divide(c("s_acctbal"), c("s_suppkey") % 3), id=lambda: fn.int_divide(c("s_suppkey"), c("s_nationkey")).cast("long"), md=lambda: fn.mod(c("s_suppkey"), c("s_nationkey")).cast("long"), re=lambda: fn.round_even(c("s_suppkey") / 2).cast("double"), tr=lambda: fn.trunc(c("s_acctbal")),
    ev=lambda: fn.even(c("s_acctbal")).cast("double"), sb=lambda: fn.signbit(c("s_acctbal")), fa=lambda: F.factorial(c("s_suppkey").cast("int") % 15), ga=lambda: F.round(fn.gamma(c("s_suppkey") % 9 + 1.5), 4), lg=r6(lambda: fn.lgamma(c("s_suppkey") + 0.5)),
    gc=lambda: fn.gcd(c("s_suppkey") * 6, c("s_nationkey") * 4), lc=lambda: fn.lcm(c("s_suppkey"), c("s_nationkey") + 1), bc=lambda: F.bit_count("s_suppkey").cast("long"), xo=lambda: fn.xor(c("s_suppkey"), F.lit(37).cast("long")), an=lambda: c("s_suppkey").bitwiseAND(F.lit(12).cast("long")), ls=lambda: F.shiftleft("s_suppkey", 3), rs=lambda: F.shiftright("s_suppkey", 2),
    inf=lambda: fn.isinf(fn.divide(c("s_acctbal"), c("s_suppkey") % 3)), fi=lambda: fn.isfinite(fn.divide(c("s_acctbal"), c("s_suppkey") % 3)), nx=lambda: fn.nextafter(c("s_acctbal"), F.lit(1e9)) > c("s_acctbal"), ct=lambda: F.round(F.cot(c("s_suppkey") / 7), 5),
)
NUMBERS2_SQL = """SELECT s_suppkey, s_acctbal / (s_suppkey % 3) AS dv, CAST(s_suppkey // nullif(s_nationkey, 0) AS BIGINT) AS id, CAST(s_suppkey % nullif(s_nationkey, 0) AS BIGINT) AS md, round_even(s_suppkey / 2, 0) AS re, trunc(s_acctbal) AS tr, even(s_acctbal) AS ev, signbit(s_acctbal) AS sb,
    CAST(factorial(CAST(s_suppkey % 15 AS INT)) AS BIGINT) AS fa, round(gamma(s_suppkey % 9 + 1.5), 4) AS ga, round(lgamma(s_suppkey + 0.5), 6) AS lg, gcd(s_suppkey * 6, s_nationkey * 4) AS gc, lcm(s_suppkey, s_nationkey + 1) AS lc, CAST(bit_count(s_suppkey) AS BIGINT) AS bc, xor(s_suppkey, 37) AS xo, s_suppkey & 12 AS an, s_suppkey << 3 AS ls, s_suppkey >> 2 AS rs,
    isinf(s_acctbal / (s_suppkey % 3)) AS inf, isfinite(s_acctbal / (s_suppkey % 3)) AS fi, nextafter(s_acctbal, 1e9) > s_acctbal AS nx, round(cot(s_suppkey / 7), 5) AS ct FROM supplier"""
PARTS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second", "millisecond", "microsecond", "decade", "century", "millennium", "era", "isodow", "dow", "dayofyear", "isoyear", "yearweek", "epoch_ms", "epoch_us")
DATE_PARTS = _select("events", ["event_id"], None, **{f"p_{p}": (lambda p=p: fn.date_part(p, c("ts"))) for p in PARTS if p != "epoch_ms"}, p_epoch_ms=lambda: fn.epoch_ms(c("ts")), dn=lambda: fn.dayname(c("ts")), mn=lambda: fn.monthname(c("ts")), jd=lambda: F.round(fn.julian(c("ts")), 4))
DATE_PARTS_SQL = "SELECT event_id, " + ", ".join(f"CAST(date_part('{p}', ts) AS BIGINT) AS p_{p}" if not p.startswith("epoch") else f"{p}(ts) AS p_{p}" for p in PARTS).replace("date_part('millisecond', ts)", "date_part('millisecond', ts)") + ", dayname(ts) AS dn, monthname(ts) AS mn, round(julian(ts), 4) AS jd FROM events"
UNITS = ("microsecond", "second", "minute", "hour", "day", "week", "month", "quarter", "year", "decade", "century", "millennium")
OTHER = "TIMESTAMP '1995-02-28 13:14:15'"


def _at():
    return F.lit("1995-02-28 13:14:15").cast("timestamp_ntz")


DATE_DIFF = _select("orders", ["o_orderkey"], None, **{f"d_{u}": (lambda u=u: fn.date_diff(u, _at(), c("o_orderdate")).cast("long")) for u in UNITS}, **{f"s_{u}": (lambda u=u: fn.datesub(u, _at(), c("o_orderdate")).cast("long")) for u in UNITS})
DATE_DIFF_SQL = "SELECT o_orderkey, " + ", ".join(f"date_diff('{u}', {OTHER}, o_orderdate) AS d_{u}" for u in UNITS) + ", " + ", ".join(f"date_sub('{u}', {OTHER}, o_orderdate) AS s_{u}" for u in UNITS) + " FROM orders"
TRUNCS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year", "decade", "century", "millennium")
DATE_MAKE = _select(
    "events", ["event_id"], None, **{f"t_{p}": (lambda p=p: fn.date_trunc(p, c("ts"))) for p in TRUNCS}, ld=lambda: F.last_day(c("ts").cast("date")).cast("string"), md=lambda: F.make_date(F.year("ts"), F.month("ts"), F.lit(1)).cast("string"),
    tb=lambda: fn.time_bucket(3 * 3600 * 10**6, c("ts")), sf=lambda: fn.strftime(c("ts"), "%Y/%m/%d %H:%M"), sp=lambda: fn.strptime(fn.strftime(c("ts"), "%d.%m.%Y"), "%d.%m.%Y"), ad=lambda: c("ts") + F.expr("INTERVAL '3' DAY"), am=lambda: F.add_months(c("ts").cast("date"), 1).cast("string"),
)
DATE_MAKE_SQL = "SELECT event_id, " + ", ".join(f"CAST(date_trunc('{p}', ts) AS TIMESTAMP) AS t_{p}" for p in TRUNCS) + ", CAST(last_day(ts) AS VARCHAR) AS ld, CAST(make_date(year(ts), month(ts), 1) AS VARCHAR) AS md, time_bucket(INTERVAL '3 hours', ts) AS tb, strftime(ts, '%Y/%m/%d %H:%M') AS sf, strptime(strftime(ts, '%d.%m.%Y'), '%d.%m.%Y') AS sp, ts + INTERVAL 3 DAY AS ad, CAST(CAST(CAST(ts AS DATE) + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS am FROM events"


def _list():
    n = c("n_nationkey")
    return F.array(n, n % 3, F.lit(None).cast("int"), F.lit(7), n % 3)


def _json(f):
    return lambda: F.to_json(f())


def _keep_nulls(f):
    """A list of integers as text, nulls kept."""
    return lambda: F.concat(F.lit("["), F.array_join(F.transform(f(), lambda v: F.coalesce(v.cast("string"), F.lit("null"))), ","), F.lit("]"))


LISTS = _select(
    "nation", ["n_nationkey"],
    ex=lambda: fn.list_extract(_list(), -1), e0=lambda: fn.list_extract(_list(), 9), ct=lambda: fn.list_contains(_list(), 7), po=lambda: fn.list_position(_list(), 7), ap=_keep_nulls(lambda: fn.list_append(_list(), F.lit(5))), pp=_keep_nulls(lambda: fn.list_prepend(_list(), F.lit(5))),
    cc=_keep_nulls(lambda: fn.list_concat(_list(), F.array(F.lit(1)))), di=_keep_nulls(lambda: fn.list_sort(fn.list_distinct(_list()))), un=lambda: fn.list_unique(_list()), so=_keep_nulls(lambda: fn.list_sort(_list())), rs=_keep_nulls(lambda: fn.list_sort(_list(), True)), gu=_keep_nulls(lambda: fn.list_grade_up(F.array(c("n_nationkey"), F.lit(100), F.lit(None).cast("int"), F.lit(-5)))),
    sl=_keep_nulls(lambda: fn.list_slice(_list(), 2, 3)), sn=_keep_nulls(lambda: fn.list_slice(_list(), -2, -1)), rv=_keep_nulls(lambda: F.reverse(_list())), rz=_keep_nulls(lambda: fn.list_resize(_list(), 7)), rz2=_keep_nulls(lambda: fn.list_resize(_list(), 2)), ha=lambda: fn.list_has_any(_list(), F.array(F.lit(7), F.lit(99))), hl=lambda: fn.list_has_all(_list(), F.array(F.lit(7), F.lit(99))),
    tr=_keep_nulls(lambda: F.transform(_list(), lambda v: v * 2)), fi=_keep_nulls(lambda: F.filter(_list(), lambda v: v > 2)), rd=lambda: fn.list_reduce(F.array_compact(_list()), lambda a, b: a * 10 + b), sm=lambda: fn.list_aggregate(_list(), "sum").cast("long"), av=r6(lambda: fn.list_aggregate(_list(), "avg")), mx=lambda: fn.list_aggregate(_list(), "max"), pr=lambda: fn.list_aggregate(_list(), "product"),
    se=_keep_nulls(lambda: fn.list_select(_list(), F.array(F.lit(1), F.lit(4)))), wh=_keep_nulls(lambda: fn.list_where(_list(), F.array(*(F.lit(b) for b in (True, False, True, False, True))))), fl=_keep_nulls(lambda: fn.flatten(F.array(_list(), F.lit(None).cast("array<int>"), F.array(F.lit(3))))), pb=_keep_nulls(lambda: fn.array_pop_back(_list())), pf=_keep_nulls(lambda: fn.array_pop_front(_list())),
    gs=_keep_nulls(lambda: F.sequence(F.lit(1), c("n_nationkey") + 2, F.lit(2))), ints=_keep_nulls(lambda: F.array_sort(F.array_intersect(_list(), F.array(F.lit(7), F.lit(2))))),
)
L = "[n_nationkey, n_nationkey % 3, NULL, 7, n_nationkey % 3]"


def _j(x: str) -> str:
    return f"CAST(to_json({x}) AS VARCHAR)"


LISTS_SQL = f"""SELECT n_nationkey, list_extract({L}, -1) AS ex, list_extract({L}, 9) AS e0, list_contains({L}, 7) AS ct, CAST(list_position({L}, 7) AS BIGINT) AS po, {_j(f"list_append({L}, 5)")} AS ap, {_j(f"list_prepend(5, {L})")} AS pp, {_j(f"list_concat({L}, [1])")} AS cc,
    {_j(f"list_sort(list_distinct({L}))")} AS di, CAST(list_unique({L}) AS BIGINT) AS un, {_j(f"list_sort({L}, 'ASC', 'NULLS LAST')")} AS so, {_j(f"list_sort({L}, 'DESC', 'NULLS LAST')")} AS rs, {_j("list_grade_up([n_nationkey, 100, NULL, -5], 'ASC', 'NULLS LAST')")} AS gu, {_j(f"list_slice({L}, 2, 3)")} AS sl, {_j(f"list_slice({L}, -2, -1)")} AS sn, {_j(f"list_reverse({L})")} AS rv,
    {_j(f"list_resize({L}, 7)")} AS rz, {_j(f"list_resize({L}, 2)")} AS rz2, list_has_any({L}, [7, 99]) AS ha, list_has_all({L}, [7, 99]) AS hl, {_j(f"list_transform({L}, lambda x: x * 2)")} AS tr, {_j(f"list_filter({L}, lambda x: x > 2)")} AS fi,
    list_reduce(list_filter({L}, lambda x: x IS NOT NULL), lambda a, b: a * 10 + b) AS rd, CAST(list_aggregate({L}, 'sum') AS BIGINT) AS sm, round(list_aggregate({L}, 'avg'), 6) AS av, list_aggregate({L}, 'max') AS mx, list_aggregate({L}, 'product') AS pr, {_j(f"list_select({L}, [1, 4])")} AS se,
    {_j(f"list_where({L}, [true, false, true, false, true])")} AS wh, {_j(f"flatten([{L}, NULL, [3]])")} AS fl, {_j(f"array_pop_back({L})")} AS pb, {_j(f"array_pop_front({L})")} AS pf, {_j("generate_series(1, n_nationkey + 2, 2)")} AS gs, {_j(f"list_sort(list_intersect({L}, [7, 2]))")} AS ints FROM nation"""


def _v():
    return F.array(F.element_at("embedding", 1), F.element_at("embedding", 2), F.element_at("embedding", 3)), F.array(F.lit(0.5), F.lit(-0.25), F.lit(2.0))


VECTORS = _select(
    "embeddings", ["vec_id"],
    ip=lambda: F.round(fn.list_inner_product(*_v()), 5), di=lambda: F.round(fn.list_distance(*_v()), 5), cs=lambda: F.round(fn.list_cosine_similarity(*_v()), 5), cd=lambda: F.round(fn.list_cosine_distance(*_v()), 5), ni=lambda: F.round(fn.list_negative_inner_product(*_v()), 5),
    cx=lambda: F.round(F.element_at(fn.array_cross_product(*_v()), 1), 5), n=lambda: F.size("embedding").cast("long"),
)
A, B = "CAST(embedding[1:3] AS DOUBLE[3])", "CAST([0.5, -0.25, 2.0] AS DOUBLE[3])"
VECTORS_SQL = f"""SELECT vec_id, round(list_inner_product({A}, {B}), 5) AS ip, round(list_distance({A}, {B}), 5) AS di, round(list_cosine_similarity({A}, {B}), 5) AS cs, round(list_cosine_distance({A}, {B}), 5) AS cd, round(list_negative_inner_product({A}, {B}), 5) AS ni,
    round(array_cross_product({A}, {B})[1], 5) AS cx, len(embedding) AS n FROM embeddings"""


def _map():
    return F.create_map(F.lit("a"), c("n_nationkey"), F.lit("b"), c("n_regionkey"))


ENUM = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
MAPS = _select(
    "nation", ["n_nationkey"],
    ks=_json(lambda: F.array_sort(F.map_keys(_map()))), vs=_json(lambda: F.map_values(_map())), ex=_json(lambda: fn.map_extract(_map(), "b")), e0=_json(lambda: fn.map_extract(_map(), "z")), ev=lambda: fn.map_extract_value(_map(), "a"), co=lambda: F.map_contains_key(_map(), "a"), sz=lambda: F.size(_map()).cast("long"),
    cc=lambda: F.element_at(fn.map_concat(_map(), F.create_map(F.lit("a"), F.lit(-1))), "a"), st=lambda: fn.struct_extract(fn.struct_insert(F.struct(c("n_name").alias("x")), y=c("n_regionkey")), "y"), ut=lambda: fn.union_tag(fn.union_value("num", c("n_nationkey"), {"num": "int", "str": "string"})), ux=lambda: fn.union_extract(fn.union_value("num", c("n_nationkey"), {"num": "int", "str": "string"}), "num"),
    ec=lambda: fn.enum_code(F.element_at(fn.enum_range(ENUM), c("n_regionkey") + 1), ENUM), gb=lambda: fn.get_bit(F.lpad(F.bin("n_nationkey"), 8, "0"), 6), sb=lambda: fn.set_bit(F.lpad(F.bin("n_nationkey"), 8, "0"), 0, 1),
)
M = "MAP {'a': n_nationkey, 'b': n_regionkey}"
MAPS_SQL = f"""SELECT n_nationkey, {_j(f"list_sort(map_keys({M}))")} AS ks, {_j(f"map_values({M})")} AS vs, {_j(f"map_extract({M}, 'b')")} AS ex, {_j(f"map_extract({M}, 'z')")} AS e0, {M}['a'] AS ev, map_contains({M}, 'a') AS co, CAST(cardinality({M}) AS BIGINT) AS sz,
    map_concat({M}, MAP {{'a': -1}})['a'] AS cc, struct_insert({{'x': n_name}}, y := n_regionkey).y AS st, CAST(union_tag(CAST(n_nationkey AS UNION(num INT, str VARCHAR))) AS VARCHAR) AS ut, union_extract(CAST(n_nationkey AS UNION(num INT, str VARCHAR)), 'num') AS ux,
    CAST(n_regionkey AS INT) AS ec, get_bit(CAST(lpad(bin(n_nationkey), 8, '0') AS BIT), 6) AS gb, CAST(set_bit(CAST(lpad(bin(n_nationkey), 8, '0') AS BIT), 0, 1) AS VARCHAR) AS sb FROM nation"""


def _doc():
    return F.concat(F.lit('{"id":'), c("n_nationkey").cast("string"), F.lit(',"name":"'), c("n_name"), F.lit('","tags":["x",'), c("n_regionkey").cast("string"), F.lit('],"none":null,"in":{"k":true}}'))


JSON = _select(
    "nation", ["n_nationkey"],
    es=lambda: fn.json_extract_string(_doc(), "$.name"), ej=lambda: fn.json_extract(_doc(), "$.name"), ei=lambda: fn.json_extract(_doc(), "/tags/1"), eo=lambda: fn.json_extract(_doc(), "$.in"), xs=lambda: fn.json_exists(_doc(), "$.in.k"), xn=lambda: fn.json_exists(_doc(), "$.nope"), al=lambda: F.json_array_length(fn.json_extract(_doc(), "$.tags")).cast("long"),
    ks=_json(lambda: fn.json_keys(_doc())), ty=lambda: fn.json_type(_doc(), "$.tags"), ts=lambda: fn.json_type(_doc(), "$.name"), tb=lambda: fn.json_type(_doc(), "$.in.k"), va=lambda: fn.json_valid(F.concat(_doc(), F.when(c("n_nationkey") % 2 == 0, F.lit("x")).otherwise(F.lit("")))), qu=lambda: fn.json_quote(c("n_name")),
    mp=lambda: fn.json_merge_patch(F.lit('{"a":1,"b":2}'), F.concat(F.lit('{"b":null,"c":'), c("n_nationkey").cast("string"), F.lit("}"))), jo=lambda: fn.json_object("k", c("n_nationkey"), "n", c("n_name")), ja=lambda: fn.json_array(c("n_nationkey"), c("n_name")), jc=lambda: fn.json_contains(_doc(), F.lit('{"in":{"k":true}}')),
    tr=lambda: F.from_json(_doc(), "id INT, name STRING")["id"],
)
D = """('{"id":' || n_nationkey || ',"name":"' || n_name || '","tags":["x",' || n_regionkey || '],"none":null,"in":{"k":true}}')"""
JSON_SQL = f"""SELECT n_nationkey, json_extract_string({D}, '$.name') AS es, CAST(json_extract({D}, '$.name') AS VARCHAR) AS ej, CAST(json_extract({D}, '/tags/1') AS VARCHAR) AS ei, CAST(json_extract({D}, '$.in') AS VARCHAR) AS eo, json_exists({D}, '$.in.k') AS xs, json_exists({D}, '$.nope') AS xn, CAST(json_array_length({D}, '$.tags') AS BIGINT) AS al,
    {_j(f"json_keys({D})")} AS ks, json_type({D}, '$.tags') AS ty, json_type({D}, '$.name') AS ts, json_type({D}, '$.in.k') AS tb, json_valid({D} || CASE WHEN n_nationkey % 2 = 0 THEN 'x' ELSE '' END) AS va, CAST(json_quote(n_name) AS VARCHAR) AS qu,
    CAST(json_merge_patch('{{"a":1,"b":2}}', '{{"b":null,"c":' || n_nationkey || '}}') AS VARCHAR) AS mp, CAST(json_object('k', n_nationkey, 'n', n_name) AS VARCHAR) AS jo, CAST(json_array(n_nationkey, n_name) AS VARCHAR) AS ja, json_contains({D}, '{{"in":{{"k":true}}}}') AS jc, n_nationkey AS tr FROM nation"""
GROUPED_JSON = _grouped("nation", "n_regionkey", ga=lambda: F.to_json(F.array_sort(F.collect_list("n_nationkey"))), ls=lambda: F.to_json(fn.list_ordered(c("n_name"), c("n_nationkey"))))

ITEMS = {
    "fn_moments": (MOMENTS, "SELECT l_returnflag, round(skewness(l_linenumber), 6) AS sk, round(kurtosis(l_linenumber), 6) AS ku, round(kurtosis_pop(l_linenumber), 6) AS kp, round(sem(l_quantity), 6) AS se, round(stddev_pop(l_quantity), 6) AS sp, round(stddev_samp(l_quantity), 6) AS ss, round(var_pop(l_quantity), 6) AS vp, round(var_samp(l_quantity), 6) AS vs, round(geomean(l_quantity), 6) AS gm, round(weighted_avg(l_quantity, l_linenumber), 6) AS wa FROM lineitem GROUP BY l_returnflag"),
    "fn_regression": (PAIRS, "SELECT l_returnflag, round(corr(l_extendedprice, l_quantity), 6) AS co, round(covar_pop(l_extendedprice, l_quantity), 3) AS cp, round(covar_samp(l_extendedprice, l_quantity), 3) AS cs, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 3) AS ay, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_intercept(l_extendedprice, l_quantity), 3) AS ic, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_slope(l_extendedprice, l_quantity), 6) AS sl, round(regr_sxx(l_extendedprice, l_quantity), 1) AS sxx FROM lineitem GROUP BY l_returnflag"),
    "fn_holistic": (HOLISTIC, f"SELECT o_orderpriority, round(median(o_totalprice), 6) AS md, round(quantile_cont(o_totalprice, 0.3), 6) AS qc, quantile_disc(o_totalprice, 0.3) AS qd, round(mad(o_totalprice), 6) AS ma, {_j('min(o_orderkey, 3)')} AS mn, {_j('max(o_orderkey, 3)')} AS mx, arg_min(o_orderkey, o_totalprice) AS am, arg_max(o_orderkey, o_totalprice) AS ax, {_j('arg_max(o_orderkey, o_totalprice, 2)')} AS an FROM orders GROUP BY o_orderpriority"),
    "fn_bits": (BITS, "SELECT s_nationkey, bit_and(s_suppkey) AS ba, bit_or(s_suppkey) AS bo, bit_xor(s_suppkey) AS bx, bool_and(s_acctbal > 0) AS al, bool_or(s_acctbal < 0) AS so, CAST(count_if(s_acctbal > 1000) AS BIGINT) AS ci, string_agg(s_name, '|' ORDER BY s_name) AS st, round(product(s_suppkey % 3 + 1), 3) AS pr FROM supplier GROUP BY s_nationkey"),
    "fn_histogram": (histogram, "SELECT l_returnflag, string_agg(l_linenumber || '=' || n, ',' ORDER BY l_linenumber) AS h, (SELECT round(entropy(b.l_linenumber), 6) FROM lineitem b WHERE b.l_returnflag = a.l_returnflag) AS e, arg_max(l_linenumber, n * 1000 - l_linenumber) AS mode FROM (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) a GROUP BY l_returnflag"),
    "fn_text": (TEXT, TEXT_SQL),
    "fn_regex": (REGEX, REGEX_SQL),
    "fn_hashes": (HASHES, HASHES_SQL),
    "fn_distances": (DISTANCES, DISTANCES_SQL),
    "fn_numbers": NUMBERS,
    "fn_numbers_more": (NUMBERS2, NUMBERS2_SQL),
    "fn_date_parts": (DATE_PARTS, DATE_PARTS_SQL),
    "fn_date_diff": (DATE_DIFF, DATE_DIFF_SQL),
    "fn_date_make": (DATE_MAKE, DATE_MAKE_SQL),
    "fn_lists": (LISTS, LISTS_SQL),
    "fn_vectors": (VECTORS, VECTORS_SQL),
    "fn_maps": (MAPS, MAPS_SQL),
    "fn_json": (JSON, JSON_SQL),
    "fn_json_groups": (GROUPED_JSON, f"SELECT n_regionkey, {_j('list(n_nationkey ORDER BY n_nationkey)')} AS ga, {_j('list(n_name ORDER BY n_nationkey)')} AS ls FROM nation GROUP BY n_regionkey"),
    "fn_conditional": same("SELECT n_nationkey, coalesce(CASE WHEN n_nationkey > 5 THEN n_name END, 'none') AS co, nullif(n_regionkey, 1) AS nu, CASE WHEN n_regionkey = 2 THEN 'x' ELSE 'y' END AS cw, n_nationkey IS DISTINCT FROM 4 AS idf FROM nation"),
    "fn_approx": pair("SELECT abs(approx_count_distinct(o_custkey) - count(DISTINCT o_custkey)) * 5 < count(DISTINCT o_custkey) AS near, abs(approx_percentile(o_totalprice, 0.5) - percentile(o_totalprice, 0.5)) * 20 < percentile(o_totalprice, 0.5) AS mid FROM orders", "SELECT abs(approx_count_distinct(o_custkey) - count(DISTINCT o_custkey)) * 5 < count(DISTINCT o_custkey) AS near, abs(approx_quantile(o_totalprice, 0.5) - median(o_totalprice)) * 20 < median(o_totalprice) AS mid FROM orders"),
    "fn_json_events": pair("SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
}
