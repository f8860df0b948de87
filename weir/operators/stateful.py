"""Per-row functions with state, as window expressions over arrival order.

State is kept for each partition; without PARTITION BY there is one state for the whole
stream, which is worked on in ranges of the order with what each hands on to the next. A row is accepted if the FILTER holds
(and, for functions that ignore nulls, the argument isn't null). Accepted values are
wrapped in a struct, so that IGNORE NULLS skips rows that aren't accepted and no others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.syntax import Call, Literal, Node, SqlError


#: Running aggregates, and how what came before is joined: (aggregate, its merge, (inside, before) -> value).
RUNNING: dict[str, tuple[Callable, Callable, Callable]] = {
    "last": (lambda x: F.last(x, ignorenulls=True), lambda x: F.last(x, ignorenulls=True), F.coalesce),
    "sum": (F.sum, F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "count": (F.count, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "min": (F.min, F.min, F.least),
    "max": (F.max, F.max, F.greatest),
}
RANGE = "__range"


@dataclass
class State:
    """What a builder needs: the rows, partition keys, order, and whether the FILTER holds.

    Without partition keys, rows that are cut into ranges of the order (a column __range)
    are worked on range by range: one value a range (and value of ``more``) is carried
    over, by way of a table with as many rows as there are of these.
    """

    df: DataFrame
    by: list[Column]
    seq: Column
    accept: Column

    @property
    def ranged(self) -> bool:
        return not self.by and RANGE in self.df.columns

    def over(self, kind: str, value: Column, *more: str, before: bool = False) -> Column:
        """A running aggregate over the rows up to this one, or before it, that are alike in the columns ``more``."""
        aggregate, merge, join = RUNNING[kind]
        w = Window.partitionBy(*([F.col(RANGE)] if self.ranged else self.by), *more).orderBy(self.seq)
        inside = aggregate(value).over(w.rowsBetween(Window.unboundedPreceding, -1 if before else 0))
        if not self.ranged:
            return inside
        name, keys = f"__carry{len(self.df.columns)}", [RANGE, *more]
        parts = self.df.where(value.isNotNull()).groupBy(*keys).agg((F.max_by(value, self.seq) if kind == "last" else aggregate(value)).alias("p"))
        spots = self.df.select(*keys).distinct().join(parts, keys, "left")
        carry = spots.select(*keys, merge("p").over(Window.partitionBy(*more).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)).alias(name))
        self.df = self.df.join(carry, keys)
        return join(inside, F.col(name))


def _flag(node: Node, what: str) -> bool:
    if not isinstance(node, Literal) or not isinstance(node.value, bool):
        raise SqlError(f"{what} must be true or false")
    return node.value


def _lag(call: Call, args: list[Column], st: State) -> Column:
    """The n-th accepted value before; a row that isn't accepted sees what the next accepted one would."""
    n = call.args[1].value if len(args) > 1 and isinstance(call.args[1], Literal) else 1 if len(args) < 2 else None
    if type(n) is not int or n < 1:
        raise SqlError("the offset of lag must be a positive number")
    accepted = st.accept & args[0].isNotNull() if len(args) < 3 or _flag(call.args[2], "ignore_null") else st.accept
    # the last n accepted values before this row, the n-th of which is the oldest; nth_value can't count from the end
    kept = F.when(accepted, F.struct(args[0].alias("x")))
    if n == 1:
        return st.over("last", kept, before=True)["x"]
    return _Back(kept, n, st)


def _latest(call: Call, args: list[Column], st: State) -> Column:
    return st.over("last", F.when(st.accept, args[0]))


def _changed(x: Column, accepted: Column, st: State) -> Column:
    before = st.over("last", F.when(accepted, F.struct(x.alias("x"))), before=True)["x"]
    return accepted & ~x.eqNullSafe(before)


def _accepted(call: Call, x: Column, st: State) -> Column:
    return st.accept & x.isNotNull() if _flag(call.args[0], "ignore_null") else st.accept


def _changed_col(call: Call, args: list[Column], st: State) -> Column:
    return F.when(_changed(args[1], _accepted(call, args[1], st), st), args[1])


def _had_changed(call: Call, args: list[Column], st: State) -> Column:
    found = F.lit(False)
    for x in args[1:]:
        found = found | _changed(x, _accepted(call, x, st), st)
    return found


def _running(kind: str, st: State, x: Column, *more: str) -> Column:
    if kind == "avg":
        return st.over("sum", x, *more) / F.nullif(st.over("count", x, *more), F.lit(0))
    return st.over(kind, x, *more)


def _accumulated(kind: str, zero: object):
    def build(call: Call, args: list[Column], st: State) -> Column:
        x = args[0] if kind == "count" else args[0].cast("double")
        if len(args) == 1:
            return F.coalesce(_running(kind, st, F.when(st.accept, x)), F.lit(zero))
        if len(args) == 2:
            raise SqlError(f"{call.name} takes one or three arguments")
        return _Lived(*(F.coalesce(a, F.lit(False)) for a in args[1:]), x, kind, zero, st)

    return build


@dataclass
class _Lived:
    """The life of a state ends after a row that resets it; within a life, it counts from the first row that begins it.

    A window within a window: the life and the opening are columns of their own first.
    """

    begin: Column
    reset: Column
    x: Column
    kind: str
    zero: object
    st: State

    def add(self, name: str) -> DataFrame:
        st = self.st
        life = F.coalesce(st.over("sum", self.reset.cast("int"), before=True), F.lit(0))
        st.df = st.df.withColumn(f"{name}_life", life)
        on = st.over("max", self.begin.cast("int"), f"{name}_life") == 1
        st.df = st.df.withColumn(f"{name}_on", on)
        value = F.when(F.col(f"{name}_on") & st.accept, self.x)
        out = F.coalesce(_running(self.kind, st, value, f"{name}_life"), F.lit(self.zero))
        return st.df.withColumn(name, out).drop(f"{name}_life", f"{name}_on")


@dataclass
class _Back:
    """The n-th accepted value before: rows are numbered by the accepted ones before them."""

    kept: Column
    n: int
    st: State

    def add(self, name: str) -> DataFrame:
        st = self.st
        st.df = st.df.withColumn(f"{name}_kept", self.kept)
        number = F.coalesce(st.over("count", F.col(f"{name}_kept"), before=True), F.lit(0)).cast("long")
        df = st.df.withColumn(f"{name}_n", number)
        # accepted rows have numbers 0, 1, ...; a row with k before it wants the one numbered k - n
        if st.ranged:  # every range gets a copy of the n accepted rows before it
            first = df.groupBy(RANGE).agg(F.min(f"{name}_n").alias("first"))
            wanted = first.select(RANGE, F.explode(F.sequence(F.col("first") - self.n, F.col("first") - 1)).alias(f"{name}_n"))
            accepted = df.where(F.col(f"{name}_kept").isNotNull()).select(f"{name}_n", f"{name}_kept")
            guests = accepted.join(wanted, f"{name}_n").withColumn(f"{name}_guest", F.lit(True))
            df = df.withColumn(f"{name}_guest", F.lit(False)).unionByName(guests, allowMissingColumns=True)
        keys = [F.col(RANGE)] if st.ranged else st.by
        numbered = Window.partitionBy(*keys).orderBy(f"{name}_n").rangeBetween(-self.n, -self.n)
        df = df.withColumn(name, F.first(f"{name}_kept", ignorenulls=True).over(numbered)["x"])
        return (df.where(~F.col(f"{name}_guest")).drop(f"{name}_guest") if st.ranged else df).drop(f"{name}_kept", f"{name}_n")


#: name -> (least and most arguments, builder(call, argument columns, state))
STATEFUL: dict[str, tuple[int, int | None, Callable]] = {
    "lag": (1, 3, _lag),
    "latest": (1, 1, _latest),
    "changed_col": (2, 2, _changed_col),
    "had_changed": (2, None, _had_changed),
    "acc_sum": (1, 3, _accumulated("sum", 0.0)),
    "acc_min": (1, 3, _accumulated("min", 0.0)),
    "acc_max": (1, 3, _accumulated("max", 0.0)),
    "acc_avg": (1, 3, _accumulated("avg", 0.0)),
    "acc_count": (1, 3, _accumulated("count", 0)),
}


@dataclass(frozen=True)
class Fold:
    """A user's function with state: its type, what state starts as, and a step."""

    type: T.DataType
    start: Callable[[], object]
    step: Callable[[object, bool, list], tuple[object, object]]


#: Users' functions by name, for batches and streams alike.
FOLDS: dict[str, Fold] = {}


@dataclass
class _Folded:
    """Rows pass the step in order, key by key; without keys all in one task, as a step may do anything."""

    fold: Fold
    args: list[Column]
    st: State

    def add(self, name: str) -> DataFrame:
        import pandas as pd

        st, fold, n = self.st, self.fold, len(self.args)
        extra = [c.alias(f"__x{i}") for i, c in enumerate(self.args)]
        df = st.df.select("*", *extra, st.accept.alias("__accept"), F.struct(*st.by, F.lit(0)).alias("__key"), F.to_json(F.struct(*st.by, F.lit(0))).alias("__text"))
        columns, schema = st.df.columns, T.StructType([*st.df.schema.fields, T.StructField(name, fold.type)])

        def run(batches):
            key, state = None, None
            for rows in batches:
                made = []
                for record in zip(rows["__text"], rows["__accept"], *(rows[f"__x{i}"] for i in range(n))):
                    if record[0] != key:
                        key, state = record[0], fold.start()
                    state, value = fold.step(state, bool(record[1]), [None if x is None or x != x else x for x in record[2:]])
                    made.append(value)
                out = rows[columns].copy()
                out[name] = pd.Series(made, index=rows.index, dtype=object)
                yield out

        dealt = df.repartition("__text") if st.by else df.coalesce(1)
        return dealt.sortWithinPartitions("__text", st.seq).drop("__key").mapInPandas(run, schema)


def register_fold(name: str, least: int, most: int | None, returns: str, start: Callable[[], object], step: Callable[[object, bool, list], tuple[object, object]]) -> None:
    """Adds a function with state as what it starts from and a step, for batches and streams."""
    fold = Fold(T._parse_datatype_string(returns) if isinstance(returns, str) else returns, start, step)
    register_stateful(name, least, most, lambda call, args, st: _Folded(fold, args, st))
    FOLDS[name.lower()] = fold


def register_stateful(name: str, least: int, most: int | None, build: Callable) -> None:
    """Adds a function with state; a taken name is refused."""
    if name.lower() in STATEFUL:
        raise SqlError(f"a stateful function {name} exists already")
    STATEFUL[name.lower()] = (least, most, build)


def add_stateful(df: DataFrame, name: str, call: Call, args: list[Column], by: list[Column], accept: Column, seq: Column) -> DataFrame:
    """``df`` with the values of one call."""
    least, most, build = STATEFUL[call.name]
    if len(args) < least or most is not None and len(args) > most:
        raise SqlError(f"{call.name} can't take {len(args)} arguments")
    state = State(df, by, seq, accept)
    made = build(call, args, state)
    out = made.add(name) if isinstance(made, (_Lived, _Back, _Folded)) else state.df.withColumn(name, made)
    return out.drop(*[c for c in out.columns if c.startswith("__carry")])
