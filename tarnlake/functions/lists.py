"""List, map, struct and vector functions that Spark lacks or defines otherwise. Lists count from 1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ALIASES = {
    "list_value": "array", "list_pack": "array", "list_contains": "array_contains", "list_has": "array_contains", "array_has": "array_contains",
    "list_append": "array_append", "array_push_back": "array_append", "list_prepend": "array_prepend", "array_push_front": "array_prepend",
    "list_intersect": "array_intersect", "list_has_any": "arrays_overlap", "array_has_any": "arrays_overlap", "list_reverse": "reverse",
    "array_reverse": "reverse", "list_transform": "transform", "list_apply": "transform", "array_apply": "transform", "list_filter": "filter",
    "array_filter": "filter", "list_zip": "arrays_zip", "array_zip": "arrays_zip", "array_to_string": "array_join", "array_value": "array",
    "generate_series": "sequence", "unnest": "explode", "cardinality": "size", "array_length": "size", "map": "create_map", "map_contains": "map_contains_key",
    "struct_pack": "named_struct", "row": "struct", "len": "size",
}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def list_extract(c, i) -> Column:
    """Element i, negative from the end; null beyond the list or at 0."""
    i = F.lit(i) if isinstance(i, int) else _c(i)
    return F.when(i != 0, F.try_element_at(_c(c), F.when(i == 0, F.lit(1)).otherwise(i)))


list_element = array_extract = list_extract


def list_position(c, v) -> Column:
    """Place of the first element that equals v; null without one."""
    v = v if isinstance(v, Column) else F.lit(v)
    return F.nullif(F.array_position(_c(c), v), F.lit(0).cast("long"))


list_indexof = array_position = array_indexof = list_position


def list_concat(*cs) -> Column:
    """Null lists count as empty, unless all are."""
    some = F.coalesce(*(_c(c) for c in cs))
    return F.when(some.isNotNull(), F.concat(*(F.coalesce(_c(c), F.slice(some, 1, 0)) for c in cs)))


def list_distinct(c) -> Column:
    """Distinct elements but null."""
    return F.array_distinct(F.array_compact(_c(c)))


def list_unique(c) -> Column:
    return F.size(list_distinct(c)).cast("long")


def list_has_all(a, b) -> Column:
    return F.size(F.array_except(F.array_compact(_c(b)), _c(a))) == 0


def list_sort(c, descending: bool = False, nulls_first: bool = False) -> Column:
    """Nulls last, unless told otherwise."""
    x = F.sort_array(F.array_compact(_c(c)), not descending)
    nulls = F.filter(_c(c), lambda v: v.isNull())
    return F.concat(nulls, x) if nulls_first else F.concat(x, nulls)


def list_reverse_sort(c) -> Column:
    return list_sort(c, True)


def list_grade_up(c) -> Column:
    """The places of the elements in sorted order (nulls last, ties by place)."""
    tagged = F.transform(_c(c), lambda v, i: F.struct(v.isNull().alias("n"), v.alias("v"), (i + 1).cast("long").alias("i")))
    return F.transform(F.array_sort(tagged), lambda s: s["i"])


def list_slice(c, a: int, b: int) -> Column:
    """Elements a..b, both included; negative from the end."""
    n = F.size(_c(c))
    start = F.lit(a) if a > 0 else F.lit(1) if a == 0 else F.greatest(n + a + 1, F.lit(1))
    end = F.lit(b) if b >= 0 else n + b + 1
    return F.slice(_c(c), start, F.greatest(F.least(end, n) - start + 1, F.lit(0)))


def list_resize(c, n: int, fill=None) -> Column:
    kind = F.lit(fill) if fill is not None else F.lit(None)
    x = F.slice(_c(c), 1, n)
    return F.when(F.size(x) < n, F.concat(x, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(n) - F.size(x), F.lit(1))), lambda _: kind))).otherwise(x)


array_resize = list_resize


def list_select(c, places) -> Column:
    return F.transform(_c(places), lambda i: F.try_element_at(_c(c), i.cast("int")))


array_select = list_select


def list_where(c, mask) -> Column:
    """Elements whose mask is true."""
    return F.transform(F.filter(F.arrays_zip(_c(c).alias("v"), _c(mask).alias("m")), lambda s: s["m"]), lambda s: s["v"])


array_where = list_where


def list_reduce(c, f) -> Column:
    """f over the elements from the left; the first is the start."""
    return F.reduce(F.slice(_c(c), 2, F.greatest(F.size(_c(c)) - 1, F.lit(0))), F.element_at(_c(c), 1), f)


def flatten(c) -> Column:
    """Null lists inside are skipped."""
    return F.flatten(F.filter(_c(c), lambda x: x.isNotNull()))


def list_aggregate(c, what: str) -> Column:
    """sum, min, max, avg, count, product, first, last, any_value, string_agg, bool_and, bool_or of the elements but null."""
    x = F.array_compact(_c(c))
    fold = lambda zero, f: F.when(F.size(x) > 0, F.aggregate(x, zero, f))
    total = lambda: fold(F.lit(0.0), lambda s, v: s + v)
    return {
        "sum": total, "avg": lambda: total() / F.size(x), "mean": lambda: total() / F.size(x), "min": lambda: F.array_min(x), "max": lambda: F.array_max(x),
        "count": lambda: F.size(x).cast("long"), "product": lambda: fold(F.lit(1.0), lambda s, v: s * v), "first": lambda: F.try_element_at(_c(c), F.lit(1)),
        "last": lambda: F.try_element_at(_c(c), F.lit(-1)), "any_value": lambda: F.try_element_at(x, F.lit(1)), "string_agg": lambda: F.when(F.size(x) > 0, F.array_join(x, ",")),
        "bool_and": lambda: F.forall(x, lambda v: v), "bool_or": lambda: F.exists(x, lambda v: v),
    }[what]()


list_aggr = list_aggregate


def array_pop_back(c) -> Column:
    return F.slice(_c(c), 1, F.greatest(F.size(_c(c)) - 1, F.lit(0)))


def array_pop_front(c) -> Column:
    return F.slice(_c(c), 2, F.greatest(F.size(_c(c)) - 1, F.lit(0)))


def range_(a, b, step: int = 1) -> Column:
    """From a up to, not including, b."""
    return F.when(a < b if not isinstance(a, Column) else a < b, F.sequence(F.lit(a) if not isinstance(a, Column) else a, (F.lit(b) if not isinstance(b, Column) else b) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def generate_subscripts(c) -> Column:
    return F.when(F.size(_c(c)) > 0, F.sequence(F.lit(1), F.size(_c(c)))).otherwise(F.array().cast("array<int>"))


def inner_product(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def distance(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v))


def cosine_similarity(a, b) -> Column:
    return inner_product(a, b) / F.sqrt(inner_product(a, a) * inner_product(b, b))


def cosine_distance(a, b) -> Column:
    return 1 - cosine_similarity(a, b)


def negative_inner_product(a, b) -> Column:
    return -inner_product(a, b)


list_inner_product = array_inner_product = array_dot_product = list_dot_product = inner_product
list_distance = array_distance = distance
list_cosine_similarity = array_cosine_similarity = cosine_similarity
list_cosine_distance = array_cosine_distance = cosine_distance
list_negative_inner_product = array_negative_inner_product = array_negative_dot_product = negative_inner_product


def array_cross_product(a, b) -> Column:
    x, y = (lambda i: F.element_at(_c(a), i)), (lambda i: F.element_at(_c(b), i))
    return F.array(x(2) * y(3) - x(3) * y(2), x(3) * y(1) - x(1) * y(3), x(1) * y(2) - x(2) * y(1))


def map_concat(*maps) -> Column:
    """Entries of all maps; of a repeated key the last, whatever the session makes of repeated keys."""

    def two(a: Column, b: Column) -> Column:
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)

    return reduce(two, map(_c, maps))


def map_extract(c, k) -> Column:
    """A list of the key's value, or an empty list."""
    k = k if isinstance(k, Column) else F.lit(k)
    return F.when(F.map_contains_key(_c(c), k), F.array(F.element_at(_c(c), k))).otherwise(F.slice(F.map_values(_c(c)), 1, 0))


def map_extract_value(c, k) -> Column:
    return F.try_element_at(_c(c), k if isinstance(k, Column) else F.lit(k))


def struct_extract(c, name: str) -> Column:
    return _c(c).getField(name)


def struct_insert(c, **values) -> Column:
    x = _c(c)
    for k, v in values.items():
        x = x.withField(k, v if isinstance(v, Column) else F.lit(v))
    return x


struct_update = struct_insert


def union_value(tag: str, value, members: dict[str, str]) -> Column:
    """A tagged union: struct(tag, and a field for each member of which one is set)."""
    return F.struct(F.lit(tag).alias("tag"), *(((value if isinstance(value, Column) else F.lit(value)) if m == tag else F.lit(None)).cast(t).alias(m) for m, t in members.items()))


def union_tag(c) -> Column:
    return _c(c)["tag"]


def union_extract(c, member: str) -> Column:
    return _c(c)[member]


def enum_code(c, values: list[str]) -> Column:
    """The place of an ENUM value, from 0."""
    return F.array_position(F.array(*map(F.lit, values)), _c(c)).cast("int") - 1


def enum_first(values: list[str]) -> Column:
    return F.lit(values[0])


def enum_last(values: list[str]) -> Column:
    return F.lit(values[-1])


def enum_range(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def enum_range_boundary(values: list[str], a: str | None, b: str | None) -> Column:
    return enum_range(values[values.index(a) if a else 0 : values.index(b) + 1 if b else None])


def bitstring(c, n: int) -> Column:
    """Text of 0 and 1, filled up at the left."""
    return F.lpad(_c(c), n, "0")


def get_bit(c, i: int) -> Column:
    return F.substring(_c(c), i + 1, 1).cast("int")


def set_bit(c, i: int, v: int) -> Column:
    return F.overlay(_c(c), F.lit(str(v)), F.lit(i + 1), F.lit(1))


def bit_position(part, c) -> Column:
    return F.instr(_c(c), part) if isinstance(part, str) else F.locate(part, _c(c))


def struct_concat(*structs: tuple) -> Column:
    """One struct of the fields of several, each given as (struct, its field names); later fields must have other names."""
    return F.struct(*(_c(x).getField(n).alias(n) for x, names in structs for n in names))


def struct_position(c, value, names: list[str]) -> Column:
    """The place, from 1, of the first of the named fields that holds the value; null if none does."""
    v = value if isinstance(value, Column) else F.lit(value)
    out = F.lit(None).cast("int")
    for i, n in reversed(list(enumerate(names, 1))):
        out = F.when(_c(c).getField(n).eqNullSafe(v), F.lit(i)).otherwise(out)
    return out


struct_indexof = struct_position


def struct_contains(c, value, names: list[str]) -> Column:
    return struct_position(c, value, names).isNotNull()


struct_has = struct_contains


def remap_struct(c, fields: dict[str, tuple[str | None, object]]) -> Column:
    """A struct with other names and more fields: name -> (field of c or None, what stands in where there is none or a null)."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(*((lit(d) if src is None else F.coalesce(_c(c).getField(src), lit(d))).alias(n) for n, (src, d) in fields.items()))


def sort_key(*columns: tuple) -> Column:
    """One binary-free key that sorts as its columns do, each given as (column, descending, nulls first): compare as structs."""
    parts = []
    for i, (c, descending, first) in enumerate(columns):
        x = _c(c)
        parts.append(F.when(x.isNull(), 0 if first else 2).otherwise(1).alias(f"n{i}"))
        parts.append((-x if descending else x).alias(f"v{i}"))
    return F.struct(*parts)


create_sort_key = sort_key
