"""JSON functions over texts; paths are JSONPath ($.a.b[0]) or pointers (/a/b/0)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALIASES = {"json_array_length": "json_array_length", "json_keys": "json_object_keys", "row_to_json": "to_json", "array_to_json": "to_json", "ifnull": "coalesce"}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def path_of(p: str) -> str:
    """A JSONPath of a path, a pointer, or a plain key."""
    if p.startswith("$"):
        return p
    if p.startswith("/"):
        return "$" + "".join(f"[{x}]" if x.isdigit() else f".{x}" for x in p[1:].split("/"))
    return f"$.{p}"


def json_extract_string(c, p: str) -> Column:
    """A scalar as its text, an object or list as JSON; null where there is nothing."""
    return F.get_json_object(_c(c), path_of(p))


json_extract_path_text = json_value = json_extract_string


def json_extract(c, p: str) -> Column:
    """JSON text of what is at the path: strings keep their quotes."""
    v = F.try_variant_get(F.try_parse_json(_c(c)), path_of(p), "variant")
    return F.to_json(v)


json_extract_path = json_extract


def json_exists(c, p: str) -> Column:
    return F.try_variant_get(F.try_parse_json(_c(c)), path_of(p), "variant").isNotNull()


def json_type(c, p: str = "$") -> Column:
    """OBJECT, ARRAY, VARCHAR, BIGINT, DOUBLE, BOOLEAN or NULL."""
    v = F.schema_of_variant(F.try_variant_get(F.try_parse_json(_c(c)), path_of(p), "variant"))
    return (
        F.when(v.startswith("OBJECT"), "OBJECT").when(v.startswith("ARRAY"), "ARRAY").when(v == "STRING", "VARCHAR").when(v == "BIGINT", "BIGINT")
        .when(v == "BOOLEAN", "BOOLEAN").when(v == "VOID", "NULL").when(v.isNotNull(), "DOUBLE")
    )


def json_structure(c) -> Column:
    return F.schema_of_variant(F.try_parse_json(_c(c)))


def json_transform(c, schema: str) -> Column:
    return F.from_json(_c(c), schema)


from_json = json_transform


def json_quote(c) -> Column:
    """A text as a JSON string."""
    one = F.to_json(F.struct(_c(c).alias("v")))
    return F.substr(one, F.lit(6), F.length(one) - 6)


def json_object(*pairs) -> Column:
    """From keys and values in turn; keys are plain text."""
    return F.to_json(F.struct(*(_c(v).alias(k) for k, v in zip(pairs[::2], pairs[1::2], strict=True))), {"ignoreNullFields": "false"})


def json_array(*values) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *(F.coalesce(F.to_json(F.array(_c(v))).substr(F.lit(2), F.length(F.to_json(F.array(_c(v)))) - 2), F.lit("null")) for v in values)), F.lit("]"))


def _merge(a, b):
    if not isinstance(b, dict):
        return b
    out = dict(a) if isinstance(a, dict) else {}
    for k, v in b.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = _merge(out.get(k), v)
    return out


def _pandas(f, kind: str):
    def run(*cs):
        import pandas as pd

        def g(*xs):
            return pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*xs, strict=True)])

        return F.pandas_udf(g, kind, F.PandasUDFType.SCALAR)(*map(_c, cs))

    return run


def _patch(a: str, b: str) -> str:
    import json

    return json.dumps(_merge(json.loads(a), json.loads(b)), separators=(",", ":"), ensure_ascii=False)


def _pretty(a: str) -> str:
    import json

    return json.dumps(json.loads(a), indent=4, ensure_ascii=False)


def _contained(a, b) -> bool:
    if isinstance(b, dict):
        if isinstance(a, dict) and all(k in a and _contained(a[k], v) for k, v in b.items()):
            return True
    elif a == b and type(a) is type(b):
        return True
    return isinstance(a, list) and (any(_contained(x, b) for x in a) or isinstance(b, list) and all(any(_contained(x, y) for x in a) for y in b))


def _contains(a: str, b: str) -> bool:
    import json

    return _contained(json.loads(a), json.loads(b))


def _valid(a: str) -> bool:
    """Strictly: Spark's own parser lets text after the value pass."""
    import json

    try:
        json.loads(a, parse_constant=lambda x: 1 / 0)
    except (ValueError, ZeroDivisionError):
        return False
    return True


json_valid = _pandas(_valid, "boolean")
json_merge_patch, json_pretty, json_contains = _pandas(_patch, "string"), _pandas(_pretty, "string"), _pandas(_contains, "boolean")


def json_group_array(c) -> Column:
    return F.to_json(F.collect_list(_c(c)))


def json_group_object(k, v) -> Column:
    return F.to_json(F.map_from_entries(F.collect_list(F.struct(_c(k), _c(v)))))


def if_(c, a, b) -> Column:
    return F.when(c, a).otherwise(b)


KIND = {"STRING": "VARCHAR", "BOOLEAN": "BOOLEAN", "VOID": "NULL"}


def kind_of(v: Column) -> Column:
    """A variant's JSON type: OBJECT, ARRAY, VARCHAR, UBIGINT or BIGINT by sign, DOUBLE, BOOLEAN or NULL."""
    t = F.schema_of_variant(v)
    out = F.when(t.startswith("OBJECT"), "OBJECT").when(t.startswith("ARRAY"), "ARRAY")
    for k, name in KIND.items():
        out = out.when(t == k, name)
    return out.when(t == "BIGINT", F.when(F.try_variant_get(v, "$", "bigint") < 0, "BIGINT").otherwise("UBIGINT")).when(t.isNotNull(), "DOUBLE")


def variant_extract(v, at: str | int) -> Column:
    """A field or (from 1) an element of a variant."""
    return F.try_variant_get(_c(v), f"$.{at}" if isinstance(at, str) else f"$[{at - 1}]", "variant")


def variant_typeof(v) -> Column:
    return kind_of(_c(v))


def json_group_structure(c) -> Column:
    """The one structure that all documents of a group fit."""
    return F.schema_of_variant_agg(F.try_parse_json(_c(c)))


def constant_or_null(value, c) -> Column:
    """value where c is not null."""
    return F.when(_c(c).isNotNull(), value if isinstance(value, Column) else F.lit(value))


def uuid_extract_version(c) -> Column:
    return F.conv(F.substring(F.replace(_c(c).cast("string"), F.lit("-"), F.lit("")), 13, 1), 16, 10).cast("int")


def uuid_extract_timestamp(c) -> Column:
    """When a version 7 uuid was made."""
    return F.timestamp_millis(F.conv(F.substring(F.replace(_c(c).cast("string"), F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("long"))


def uuidv7() -> Column:
    """A uuid that begins with the time, in milliseconds, and is random after it."""
    at, random = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0"), F.expr("uuid()")
    return F.concat(F.substring(at, 1, 8), F.lit("-"), F.substring(at, 9, 4), F.lit("-7"), F.substring(random, 16, 21))


def can_cast_implicitly(c, kind: str) -> Column:
    """Whether the value is kept by a cast to the type and back."""
    x = _c(c)
    return x.try_cast(kind).isNotNull() | x.isNull()
