"""Arrival order at scale: places and running values over a total order, without one task for all rows.

An ordering column is cut into ranges at sampled rows, as many as the rows ask for. Each
range is worked on by itself, and one value a range is handed on.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

#: Rows of a range, and sampled rows for each bound.
RANGE_ROWS, SAMPLES = 1_000_000, 16
SHARE = 1 << 62


def time_order(ts: str, seq: str) -> Column:
    """One number that ascends with time, and with arrival at one time."""
    return F.unix_micros(F.col(ts).cast("timestamp")).cast("decimal(38,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)") + F.col(seq).cast("decimal(20,0)")


def rank(value: Column, steps: Column, n: int, inclusive: bool = False) -> Column:
    """How many of the ``n`` ascending entries of a literal array are under the value, or with ``inclusive`` not over it, by binary search."""
    if not n:
        return F.lit(0)
    jumps = [1 << k for k in reversed(range(n.bit_length()))]

    def step(at: Column, jump: Column) -> Column:
        bound = F.get(steps, at + jump - 1)  # null beyond the last one
        return F.when(bound <= value if inclusive else bound < value, at + jump).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, jumps)), F.lit(0), step)


def _literal(values: list, kind: str) -> Column:
    """A folded array, however many entries it has."""
    return F.from_json(F.lit(json.dumps([None if x is None else str(x) for x in values])), "array<string>").cast(f"array<{kind}>")


def ranged(df: DataFrame, order: str, rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with __range: its numbers ascend with ``order``. There are two at least, so that one plan holds at every size."""
    total = df.count()
    n = max(2, -(-total // rows))
    share = SHARE if total <= SAMPLES * n else SHARE * SAMPLES * n // total
    some = df.select(F.col(f"`{order}`").alias("o")).where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SHARE)) < share)
    found = sorted(r.o for r in some.collect() if r.o is not None)
    bounds = sorted({found[k * len(found) // n] for k in range(1, n)}) if found else []
    kind = df.schema[order].dataType.simpleString()
    return df.withColumn("__range", rank(F.col(f"`{order}`"), _literal(bounds, kind), len(bounds)))


def _carried(df: DataFrame, value: Column, join: Callable, kind: str) -> tuple[Column, object]:
    """What comes before each range, from one value a range, and the value of all."""
    found = {r[0]: r[1] for r in df.groupBy("__range").agg(value).collect()}
    before, total = [], None
    for k in range(max(found, default=-1) + 1):
        before.append(total)
        now = found.get(k)
        total = now if total is None else total if now is None else join(total, now)
    return F.get(_literal(before, kind), F.col("__range")), total


def arrival_index(df: DataFrame, order: str, rows: int = RANGE_ROWS) -> tuple[DataFrame, int]:
    """``df`` with __index (from 0, by ``order``), and the number of rows."""
    cut = ranged(df, order, rows)
    before, total = _carried(cut, F.count(F.lit(1)), lambda a, b: a + b, "long")
    place = F.row_number().over(Window.partitionBy("__range").orderBy(order)) - 1
    return cut.withColumn("__index", place.cast("long") + F.coalesce(before, F.lit(0))).drop("__range"), total or 0


def max_before(df: DataFrame, value: str, order: str, rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with __before: the greatest ``value`` (a long) of the rows before each, by ``order``."""
    cut = ranged(df, order, rows)
    before, _ = _carried(cut, F.max(value), max, "long")
    inside = F.max(value).over(Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return cut.withColumn("__before", F.greatest(inside, before)).drop("__range")


def numbered(df: DataFrame, sort: list[Column], name: str) -> DataFrame:
    """``df`` with its places (from 0) in an order of several columns: sorted in ranges, written once, and counted."""
    spread = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    placed = written(spread.withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ordered")
    counts, before, total = {r[0]: r[1] for r in placed.groupBy("__part").count().collect()}, [], 0
    for k in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(k, 0)
    return placed.withColumn(name, F.get(_literal(before, "long"), F.col("__part")) + F.col("__place")).drop("__part", "__place")
