"""The aggregate functions. Nulls are left out but by last_row; order is arrival order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.syntax import SqlError

#: name -> builder(argument, its type, arrival order)
AGGREGATES: dict[str, Callable[[Column, T.DataType, Column], Column]] = {}


def register_aggregate(name: str, build: Callable[[Column, T.DataType, Column], Column]) -> None:
    """Adds an aggregate; a taken name is refused."""
    if name.lower() in AGGREGATES:
        raise SqlError(f"an aggregate {name} exists already")
    AGGREGATES[name.lower()] = build


def _numeric(name: str, f) -> None:
    def build(x: Column, kind: T.DataType, seq: Column) -> Column:
        if not isinstance(kind, (T.NumericType, T.NullType)):
            raise SqlError(f"{name} takes numbers")
        return f(x, kind)

    register_aggregate(name, build)


def _bounded(total: Column, kind: T.DataType) -> Column:
    """A sum of the argument's type; small integers stop at their bounds."""
    bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31}.get(type(kind))
    if bits is None:
        return total.cast(kind)
    return F.when(total.isNotNull(), F.greatest(F.lit(-(1 << bits)), F.least(F.lit((1 << bits) - 1), total))).cast(kind)


def _both(a: Column, b: Column) -> Column:
    """The sum of two sums, each of which may be null."""
    return F.coalesce(a + b, a, b)


def _scalar(name: str, f) -> None:
    def build(x: Column, kind: T.DataType, seq: Column) -> Column:
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            raise SqlError(f"{name} takes scalars")
        return f(x)

    register_aggregate(name, build)


def _deduplicate(x: Column, kind: T.DataType, seq: Column) -> Column:
    """Distinct values in the order of their first arrival; null if there are none."""
    pairs = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(seq.alias("s"), x.alias("x")))))
    values = F.array_distinct(F.transform(pairs, lambda p: p["x"]))
    return F.when(F.size(values) > 0, values)


_numeric("avg", lambda x, _: F.avg(x.cast("double")))
_numeric("sum", lambda x, kind: _bounded(F.sum(x), kind))
_numeric("median", lambda x, _: F.median(x.cast("double")))
_numeric("var", lambda x, _: F.var_pop(x.cast("double")))
_numeric("vars", lambda x, _: F.var_samp(x.cast("double")))
_numeric("stddev", lambda x, _: F.stddev_pop(x.cast("double")))
_numeric("stddevs", lambda x, _: F.stddev_samp(x.cast("double")))
_scalar("min", F.min)
_scalar("max", F.max)
register_aggregate("count", lambda x, kind, seq: F.count(x))
register_aggregate("ndv", lambda x, kind, seq: F.count_distinct(x))
register_aggregate("deduplicate", _deduplicate)
register_aggregate("last_row", lambda x, kind, seq: F.max_by(x, seq))

#: Aggregates of rows in two parts: name -> builder(argument, arrival order) of a part's values, builder(both parts' values, type) of the whole.
MERGED: dict[str, tuple[Callable[[Column, Column], list[Column]], Callable[[list[Column], list[Column], T.DataType], Column]]] = {
    "count": (lambda x, seq: [F.count(x)], lambda a, b, kind: a[0] + b[0]),
    "sum": (lambda x, seq: [F.sum(x)], lambda a, b, kind: _bounded(_both(a[0], b[0]), kind)),
    "avg": (lambda x, seq: [F.sum(x.cast("double")), F.count(x)], lambda a, b, kind: F.when(a[1] + b[1] > 0, _both(a[0], b[0]) / (a[1] + b[1]))),
    "min": (lambda x, seq: [F.min(x)], lambda a, b, kind: F.least(a[0], b[0])),
    "max": (lambda x, seq: [F.max(x)], lambda a, b, kind: F.greatest(a[0], b[0])),
    "last_row": (lambda x, seq: [F.max(seq), F.max_by(x, seq)], lambda a, b, kind: F.when(a[0].isNull() | (b[0] > a[0]), b[1]).otherwise(a[1])),
}
