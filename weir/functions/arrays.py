"""List functions. Places count from 0; elements are compared null-safely."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import Arg, define, register

add = define("array")
LIMIT = 100_000


def _places(a: Column, v: Column) -> Column:
    return F.filter(F.transform(a, lambda x, i: F.when(x.eqNullSafe(v), i).otherwise(-1)), lambda i: i >= 0)


def _bounded(n: Column, value: Column) -> Column:
    return F.when(n <= LIMIT, value).otherwise(F.raise_error(F.lit(f"a list of more than {LIMIT} elements")))


register("array_position", lambda a, v: F.coalesce(F.array_min(_places(a.col, v.col)), F.lit(-1)).cast("long"), 2, category="array")
register("array_last_position", lambda a, v: F.coalesce(F.array_max(_places(a.col, v.col)), F.lit(-1)).cast("long"), 2, category="array")
register("array_contains", lambda a, v: F.coalesce(F.exists(a.col, lambda x: x.eqNullSafe(v.col)), F.lit(False)), 2, category="array")
register("array_contains_any", lambda a, b: F.coalesce(F.exists(a.col, lambda x: F.exists(b.col, lambda y: x.eqNullSafe(y))), F.lit(False)), 2, category="array")
register("array_create", lambda *v: F.array(*[x.col for x in v]), 0, None, category="array")
register("array_remove", lambda a, v: F.filter(a.col, lambda x: ~x.eqNullSafe(v.col)), 2, category="array")
register("repeat", lambda v, n: _bounded(n.col, F.array_repeat(v.col, n.col.cast("int"))), 2, category="array")


@add(2)
def element_at(a: Arg, i: Arg) -> Column:
    """Null outside; negative indexes count from the end."""
    index = i.col.cast("int")
    return F.try_element_at(a.col, F.when(index < 0, index).otherwise(index + 1))


@add(2, 3)
def sequence(start: Arg, stop: Arg, step: Arg | None = None) -> Column:
    """Numbers from start to stop; none if the step leads away."""
    a, b = start.col.cast("long"), stop.col.cast("long")
    by = step.col.cast("long") if step else F.when(b >= a, F.lit(1)).otherwise(F.lit(-1)).cast("long")
    empty = F.array().cast("array<long>")
    fits = ((by > 0) & (a <= b)) | ((by < 0) & (a >= b))
    return F.when(by == 0, F.raise_error(F.lit("a step of 0"))).when(~fits, empty).when(fits, _bounded(F.floor((b - a) / by) + 1, F.sequence(a, b, by)))


@add(1, None)
def array_concat(*lists: Arg) -> Column:
    """Null lists are left out; null if all are."""
    all_null = reduce(lambda x, y: x & y, [a.col.isNull() for a in lists])
    return F.when(~all_null, F.flatten(F.array_compact(F.array(*[a.col for a in lists]))))
