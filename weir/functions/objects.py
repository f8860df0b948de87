"""Object functions, over maps with string keys and over structs; keys are taken in ascending order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import Arg, FunctionError, define

add = define("object")


def _names(a: Arg) -> list[str]:
    return sorted(f.name for f in a.type.fields)


def is_struct(a: Arg) -> bool:
    return isinstance(a.type, T.StructType)


def as_map(a: Arg) -> Column:
    """A struct as a map of its fields, which must have one type; other values as they are."""
    if not is_struct(a):
        return a.col
    if len({f.dataType for f in a.type.fields}) > 1:
        raise FunctionError("the fields of the struct have several types")
    return F.when(a.col.isNotNull(), F.create_map(*[x for n in _names(a) for x in (F.lit(n), a.col[n])]))


def _last_wins(entries: Column) -> Column:
    """A map from entries with keys that may repeat."""
    kept = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(F.array_sort(kept, lambda x, y: F.when(x["key"] < y["key"], -1).otherwise(1)))


def _entries(keys: Column, values: Column) -> Column:
    return F.filter(F.zip_with(keys, values, lambda k, v: F.struct(k.cast("string").alias("key"), v.alias("value"))), lambda e: e["key"].isNotNull())


@add(1)
def keys(a: Arg) -> Column:
    if is_struct(a):
        return F.when(a.col.isNotNull(), F.array(*map(F.lit, _names(a))))
    return F.array_sort(F.map_keys(a.col))


@add(1)
def values(a: Arg) -> Column:
    m = as_map(a)
    return F.transform(F.array_sort(F.map_keys(m)), lambda k: m[k])


@add(2)
def object_(keys: Arg, values: Arg) -> Column:
    """From a list of keys and one of values, of the same length."""
    same = F.size(keys.col) == F.size(values.col)
    return F.when(~same, F.raise_error(F.lit("keys and values differ in number"))).when(same, _last_wins(_entries(keys.col, values.col)))


@add(1)
def zip_(pairs: Arg) -> Column:
    """From [key, value] lists; null pairs are left out."""
    good = F.filter(pairs.col, lambda p: p.isNotNull())
    return _last_wins(F.transform(good, lambda p: F.struct(p[0].cast("string").alias("key"), p[1].alias("value"))))


@add(1)
def items(a: Arg) -> Column:
    """[key, value] lists, with the values as strings."""
    m = as_map(a)
    return F.transform(F.array_sort(F.map_keys(m)), lambda k: F.array(k, m[k].cast("string")))


@add(1)
def obj_to_kvpair_array(a: Arg) -> Column:
    """{key, value} objects."""
    m = as_map(a)
    return F.transform(F.array_sort(F.map_keys(m)), lambda k: F.struct(k.alias("key"), m[k].alias("value")))


@add(1, None)
def object_concat(*objects: Arg) -> Column:
    """Later keys win; nulls are left out."""
    parts = [F.coalesce(F.map_entries(as_map(a)), F.array()) for a in objects]
    return _last_wins(F.concat(*parts))


@add(2, None)
def object_construct(*pairs: Arg) -> Column:
    """From keys and values in turn; null keys are left out."""
    if len(pairs) % 2:
        raise FunctionError("object_construct takes keys and values in turn")
    entries = F.array(*[F.struct(k.col.cast("string").alias("key"), v.col.alias("value")) for k, v in zip(pairs[::2], pairs[1::2])])
    return _last_wins(F.filter(entries, lambda e: e["key"].isNotNull()))


def _key_list(a: Arg) -> Column:
    return a.col if isinstance(a.type, T.ArrayType) else F.array(a.col)


@add(2)
def erase(a: Arg, key: Arg) -> Column:
    """Without one key or a list of keys."""
    if is_struct(a):
        names = key.value("a key") if key.is_literal else None
        names = [names] if isinstance(names, str) else names
        return a.col.dropFields(*names) if names else F.map_filter(as_map(a), lambda k, _: ~F.array_contains(_key_list(key), k))
    return F.map_filter(a.col, lambda k, _: ~F.array_contains(_key_list(key), k))


@add(1)
def object_size(a: Arg) -> Column:
    """The number of keys; 0 for null."""
    if is_struct(a):
        return F.when(a.col.isNotNull(), len(a.type.fields)).otherwise(0).cast("long")
    return F.coalesce(F.size(a.col), F.lit(0)).cast("long")


def _picked(value: Column, kind: T.DataType, paths: list[list[str]]) -> Column:
    heads = {}
    for head, *rest in paths:
        heads.setdefault(head, []).append(rest)
    out = []
    for name in sorted(set(heads) & set(kind.names)):
        inner = [r for r in heads[name] if r]
        field = kind[name].dataType
        out.append((_picked(value[name], field, inner) if inner and isinstance(field, T.StructType) and len(inner) == len(heads[name]) else value[name]).alias(name))
    return F.struct(*out)


@add(2, None)
def object_pick(a: Arg, *wanted: Arg) -> Column:
    """Some keys; of a struct also by paths as "a.b"."""
    if is_struct(a):
        names = [n for w in wanted for n in ([w.value("a key")] if isinstance(w.value("a key"), str) else w.literal)]
        return F.when(a.col.isNotNull(), _picked(a.col, a.type, [n.split(".") for n in names]))
    some = reduce(lambda x, y: F.concat(x, y), [_key_list(w) for w in wanted])
    return F.map_filter(a.col, lambda k, _: F.array_contains(some, k))
