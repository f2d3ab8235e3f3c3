"""Text functions that Spark lacks or defines otherwise. Pandas UDFs, Arrow-batched, only where no expression can do it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALIASES = {
    "strlen": "octet_length", "unicode": "ascii", "ord": "ascii", "prefix": "startswith", "starts_with": "startswith", "suffix": "endswith",
    "ends_with": "endswith", "to_base64": "base64", "from_base64": "unbase64", "sha256": "sha2", "str_split": "split", "gen_random_uuid": "uuid",
}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def sha256(c) -> Column:
    return F.sha2(_c(c), 256)


def unicode(c) -> Column:
    """Code point of the first character; -1 of an empty text."""
    return F.when(F.length(_c(c)) == 0, -1).otherwise(F.conv(F.hex(F.encode(F.substring(_c(c), 1, 1), "UTF-32")), 16, 10).cast("int"))


ord = unicode  # noqa: A001


def concat(*cs) -> Column:
    """Nulls are skipped."""
    return F.concat(*(F.coalesce(_c(c).cast("string"), F.lit("")) for c in cs))


def left(c, n: int) -> Column:
    """The first n characters; with negative n all but the last -n."""
    return F.substr(_c(c), F.lit(1), F.lit(n) if n >= 0 else F.greatest(F.length(_c(c)) + n, F.lit(0)))


def right(c, n: int) -> Column:
    x = _c(c)
    size = F.lit(n) if n >= 0 else F.greatest(F.length(x) + n, F.lit(0))
    return F.when(size >= F.length(x), x).otherwise(F.substr(x, F.length(x) - size + 1, size))


def split_part(c, sep: str, n: int) -> Column:
    """Part n (from 1, negative from the end); empty beyond the parts."""
    parts = F.split(_c(c), _quoted(sep))
    return F.coalesce(F.try_element_at(parts, F.lit(n)), F.when(_c(c).isNotNull(), ""))


def string_split(c, sep: str) -> Column:
    return F.split(_c(c), _quoted(sep))


def string_split_regex(c, pattern: str) -> Column:
    return F.split(_c(c), pattern)


def _quoted(sep: str) -> str:
    return r"\Q" + sep + r"\E"


def regexp_matches(c, pattern: str) -> Column:
    return F.regexp_like(_c(c), F.lit(pattern))


def regexp_full_match(c, pattern: str) -> Column:
    return F.regexp_like(_c(c), F.lit(f"^(?:{pattern})\\z"))


def regexp_replace(c, pattern: str, to: str, flags: str = "") -> Column:
    """The first match only, unless flags hold g; i: any case. Groups in `to` are \\1."""
    import re

    to = re.sub(r"\\(\d)", r"$\1", to)
    flag = "(?i)" if "i" in flags else ""
    if "g" in flags:
        return F.regexp_replace(_c(c), flag + pattern, to)
    return F.regexp_replace(_c(c), f"(?s){flag}(?:{pattern})(?<tail>.*)$", to + "${tail}")


def regexp_extract(c, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(_c(c), pattern, group)


def regexp_escape(c) -> Column:
    return F.regexp_replace(_c(c), r"([^A-Za-z0-9_])", r"\\$1")


def md5_number(c) -> Column:
    """The upper 64 bits of the hash of 128, as a decimal."""
    return F.conv(F.substring(F.md5(_c(c)), 1, 16), 16, 10).cast("decimal(20,0)")


def bit_length(c) -> Column:
    return F.octet_length(_c(c)) * 8


def to_base(n, base: int, least: int = 0) -> Column:
    return F.lpad(F.conv(_c(n).cast("string"), 10, base), least, "0") if least else F.conv(_c(n).cast("string"), 10, base)


def hamming(a, b) -> Column:
    """Places at which texts of equal length differ."""
    x, y = F.split(_c(a), ""), F.split(_c(b), "")
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p != q).cast("int")), F.lit(0), lambda s, v: s + v)


mismatches = hamming


def jaccard(a, b) -> Column:
    """Similarity of the sets of characters."""
    x, y = F.array_distinct(F.split(_c(a), "")), F.array_distinct(F.split(_c(b), ""))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def _pairs(f, kind: str):
    def run(a, b):
        import pandas as pd

        def g(x, y):
            return pd.Series([None if p is None or q is None else f(p, q) for p, q in zip(x, y, strict=True)])

        return F.pandas_udf(g, kind, F.PandasUDFType.SCALAR)(_c(a), _c(b))

    return run


def _damerau(a: str, b: str) -> int:
    """Edits with swaps of neighbours, where what was swapped may be edited again."""
    last: dict[str, int] = {}
    top = len(a) + len(b)
    d = {(-1, -1): top}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = top, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = top, j
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, m, cost = last.get(b[j - 1], 0), match, 1
            if a[i - 1] == b[j - 1]:
                cost, match = 0, j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, hits = [True] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == x:
                free[j] = False
                hits.append(i)
                break
    m = len(hits)
    if not m:
        return 0.0
    other = [y for y, f in zip(b, free, strict=True) if not f]
    swaps = sum(a[i] != y for i, y in zip(hits, other, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def _winkler(a: str, b: str) -> float:
    s = _jaro(a, b)
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return s + same * 0.1 * (1 - s) if s > 0.7 else s


damerau_levenshtein = _pairs(_damerau, "long")
jaro_similarity = _pairs(_jaro, "double")
jaro_winkler_similarity = _pairs(_winkler, "double")


def editdist3(a, b) -> Column:
    return F.levenshtein(_c(a), _c(b))


def _texts(f):
    def run(c):
        def g(x):
            return x.map(f, na_action="ignore")

        return F.pandas_udf(g, "string", F.PandasUDFType.SCALAR)(_c(c))

    return run


def _bare(t: str) -> str:
    import unicodedata

    return unicodedata.normalize("NFC", "".join(ch for ch in unicodedata.normalize("NFD", t) if not unicodedata.combining(ch)))


def _nfc(t: str) -> str:
    import unicodedata

    return unicodedata.normalize("NFC", t)


strip_accents = _texts(_bare)
nfc_normalize = _texts(_nfc)


def bar(x, low: float, high: float, width: int = 80) -> Column:
    """A bar of blocks in eighths, filled up with spaces."""
    eighths = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (_c(x) - low) / (high - low))) * width * 8).cast("int")
    full, part = F.floor(eighths / 8).cast("int"), (eighths % 8).cast("int")
    blocks = F.array(*(F.lit(b) for b in ("", "▏", "▎", "▍", "▌", "▋", "▊", "▉")))
    return F.rpad(F.concat(F.repeat(F.lit("█"), full), F.element_at(blocks, part + 1)), width, " ")


def format_bytes(n, base: int = 1024) -> Column:
    """Bytes with binary (1024) or decimal (1000) units, and one digit after the point, cut off and not rounded at each step."""
    units = ["KiB", "MiB", "GiB", "TiB", "PiB"] if base == 1024 else ["kB", "MB", "GB", "TB", "PB"]
    x = _c(n).cast("long")
    out = F.when(x < base, F.concat(x.cast("string"), F.when(x == 1, " byte").otherwise(" bytes")))
    for k, u in enumerate(units, 1):
        below = F.shiftright(x, 10 * (k - 1)) if base == 1024 else F.floor(x / base ** (k - 1))  # whole units one step smaller
        shown = F.concat(F.floor(below / base).cast("string"), F.lit("."), F.floor((below % base) * 10 / base).cast("string"), F.lit(" " + u))
        out = out.when(x < base ** (k + 1), shown) if k < len(units) else out.otherwise(shown)
    return out


def parse_filename(c, trim: bool = False) -> Column:
    name = F.element_at(F.split(_c(c), r"[/\\]"), -1)
    return F.regexp_replace(name, r"\.[^.]*$", "") if trim else name


def parse_dirname(c) -> Column:
    """The topmost folder; the root of an absolute path."""
    return F.when(_c(c).rlike(r"^[/\\]"), F.substring(_c(c), 1, 1)).when(_c(c).rlike(r"[/\\]"), F.regexp_extract(_c(c), r"^([^/\\]*)[/\\]", 1)).when(_c(c).isNotNull(), "")


def parse_dirpath(c) -> Column:
    return F.when(_c(c).rlike(r"^[/\\][^/\\]*$"), F.substring(_c(c), 1, 1)).otherwise(F.regexp_extract(_c(c), r"^(.*)[/\\][^/\\]*$", 1))


def parse_path(c) -> Column:
    parts = F.filter(F.split(_c(c), r"[/\\]"), lambda p: p != "")
    return F.when(_c(c).rlike(r"^[/\\]"), F.concat(F.array(F.substring(_c(c), 1, 1)), parts)).otherwise(parts)


def length_grapheme(c) -> Column:
    """User-perceived characters."""
    return F.size(F.regexp_extract_all(_c(c), F.lit(r"(\X)"), F.lit(1)))


def left_grapheme(c, n: int) -> Column:
    return F.array_join(F.slice(F.regexp_extract_all(_c(c), F.lit(r"(\X)"), F.lit(1)), 1, n), "")


def right_grapheme(c, n: int) -> Column:
    x = F.regexp_extract_all(_c(c), F.lit(r"(\X)"), F.lit(1))
    return F.array_join(F.slice(x, F.greatest(F.size(x) - n + 1, F.lit(1)), F.lit(n)), "")


def substring_grapheme(c, start: int, n: int) -> Column:
    return F.array_join(F.slice(F.regexp_extract_all(_c(c), F.lit(r"(\X)"), F.lit(1)), start, n), "")


def strpos(c, part) -> Column:
    """The place of a text in another, from 1; 0 where it is not."""
    return F.position(part if isinstance(part, Column) else F.lit(part), _c(c))


instr = strpos


def formatReadableDecimalSize(n) -> Column:  # noqa: N802
    return format_bytes(n, 1000)


def formatReadableSize(n) -> Column:  # noqa: N802
    return format_bytes(n, 1024)


def string_to_array(c, sep: str) -> Column:
    return string_split(c, sep)


def regexp_split_to_table(c, pattern: str) -> Column:
    """A row for each piece."""
    return F.explode(string_split_regex(c, pattern))


def array_slice(c, a: int, b: int) -> Column:
    """Characters (or bytes) a..b, both included, from 1; negative from the end. Lists: list_slice."""
    x = _c(c)
    n = F.length(x)
    start = F.lit(max(a, 1)) if a >= 0 else F.greatest(n + a + 1, F.lit(1))
    end = F.lit(b) if b >= 0 else n + b + 1
    return F.substring(x, start, F.greatest(end - start + 1, F.lit(0)))
