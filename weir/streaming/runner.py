"""Queries over streams.

Projections, filters and tumbling windows are plain Structured Streaming: expressions are
the batch ones, and windows are grouped under a watermark. Stateful functions, and count,
state and sliding windows, run as ``applyInPandasWithState`` over machines, fed with
argument columns that Spark has computed; full windows then go through the batch plan in
``foreachBatch``, since a window's rows always leave together. State is kept in
checkpoints, so queries restart where they stopped.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import stateful
from ..plans import planner
from ..plans import syntax as s
from . import machines


@dataclass
class StreamingQueryPlan:
    """``rows`` is a streaming frame; ``finish`` turns a micro-batch of it into output rows with hidden columns, and their order."""

    rows: DataFrame
    finish: Callable[[DataFrame], tuple[DataFrame, list]]


def _keyed(df: DataFrame, keys: list, extra: dict) -> tuple[DataFrame, list[str]]:
    names = [f"__key{i}" for i in range(len(keys))]
    return df.select("*", *[k.alias(n) for k, n in zip(keys, names)], *[c.alias(n) for n, c in extra.items()], *([] if keys else [F.lit(0).alias("__key")])), names or ["__key"]


def _stateful(query: planner.Query, df: DataFrame, options: planner.Options) -> StreamingQueryPlan:
    calls = list(dict.fromkeys(query.stateful))
    if query.select.window or query.aggregates:
        raise s.SqlError("over a stream, stateful functions can't be combined with windows and aggregates")
    if len({c.by for c in calls}) > 1 or any(x in calls for c in calls for inner in c.children() for x in planner._walk(inner)):
        raise s.SqlError("over a stream, stateful functions need one PARTITION BY and can't be nested")
    scope = query._scope(df)
    extra, specs, fields, fresh = {}, [], [], []
    for i, call in enumerate(calls):
        literals = [a.value if isinstance(a, s.Literal) else None for a in call.args]
        made, fed = machines.machine(call.name, literals)
        fresh.append(made)
        extra[f"__f{i}"] = scope.condition(call.where) if call.where else F.lit(True)
        extra |= {f"__x{i}_{k}": scope.compile(call.args[k]) for k in fed}
        specs.append((call.name, literals, f"__f{i}", [f"__x{i}_{k}" for k in fed]))
        kind = stateful.FOLDS[call.name].type if call.name in stateful.FOLDS else T.BooleanType() if call.name == "had_changed" else T.LongType() if call.name == "acc_count" else T.DoubleType() if call.name.startswith("acc_") else scope.type_of(scope.compile(call.args[fed[0]]))
        fields.append(T.StructField(f"__s{i}", kind))
    keyed, keys = _keyed(df, [scope.compile(k) for k in calls[0].by], extra)
    columns, seq = df.columns, options.seq
    schema = T.StructType([*df.schema.fields, *fields])

    def run(key, batches, state: GroupState):
        own = machines.restored(fresh, pickle.loads(state.get[0]) if state.exists else None)
        rows = pd.concat(list(batches)).sort_values(seq, kind="stable")
        made = [[] for _ in specs]
        for record in rows.to_dict("records"):
            for out, m, (_, _, accept, args) in zip(made, own, specs):
                out.append(m.step(bool(record[accept]), [None if machines.null(record[a]) else record[a] for a in args]))
        state.update((pickle.dumps(machines.saved(own)),))
        result = rows[columns].copy()
        for f, values in zip(fields, made):
            result[f.name] = pd.Series(values, index=rows.index, dtype=object)
        yield result

    rows = keyed.groupBy(*keys).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.NoTimeout)

    def finish(batch: DataFrame) -> tuple[DataFrame, list]:
        scope = query._scope(batch, {c: F.col(f"__s{i}") for i, c in enumerate(calls)})
        kept = batch.where(scope.condition(query.select.where)) if query.select.where else batch
        return query.projected(query._scope(kept, scope.values), [], seq, True)

    return StreamingQueryPlan(rows, finish)


def _windowed(query: planner.Query, df: DataFrame, options: planner.Options) -> StreamingQueryPlan:
    """Count, state and sliding windows: rows are held until their window is full."""
    w, scope = query.select.window, query._scope(df)
    df = df.where(scope.condition(query.select.where)) if query.select.where else df
    extra = {"__at": F.unix_micros(F.col(options.ts).cast("timestamp"))} if w.kind == "sliding" else {}
    if w.kind == "state":
        extra = {"__o": scope.condition(w.open), "__e": scope.condition(w.emit)}
    keyed, keys = _keyed(df, [scope.compile(k) for k in w.by], extra)
    columns, seq, kind, numbers = df.columns, options.seq, w.kind, w.numbers
    schema = T.StructType([*df.schema.fields, T.StructField("__w", T.LongType()), *[T.StructField(f"__by{i}", keyed.schema[k].dataType) for i, k in enumerate(keys if w.by else [])]])

    def run(key, batches, state: GroupState):
        fresh = {"count": lambda: machines.CountWindow(numbers[0]), "state": machines.StateWindow, "sliding": lambda: machines.SlidingWindow(numbers[0] * 1_000_000, (numbers[1] if len(numbers) > 1 else 0) * 1_000_000)}[kind]
        own = pickle.loads(state.get[0]) if state.exists else fresh()
        rows = pd.concat(list(batches)).sort_values(seq, kind="stable")
        out = []
        values = rows[columns].astype(object).where(rows[columns].notna(), None).values.tolist()
        for row, record in zip(values, rows.to_dict("records")):
            out += own.step_at(row, record["__at"], record[seq]) if kind == "sliding" else own.step(row, bool(record.get("__o", False)), bool(record.get("__e", False)))
        state.update((pickle.dumps(own),))
        if out:
            yield pd.DataFrame([[*r, i, *(key if len(schema) > len(columns) + 1 else ())] for i, r in out], columns=schema.names, dtype=object)

    rows = keyed.groupBy(*keys).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.NoTimeout)
    parts = [n for n in schema.names if n == "__w" or n.startswith("__by")]
    return StreamingQueryPlan(rows, lambda batch: _tail(query, batch, parts, seq))


def _tail(query: planner.Query, df: DataFrame, parts: list[str], seq: str) -> tuple[DataFrame, list]:
    """Aggregation, HAVING, ORDER BY and projection of rows that have their windows."""
    scope = query._scope(df)
    if query.aggregates:
        scope = query._aggregated(df, scope, parts, seq, True)
    if query.select.having:
        scope = query._scope(scope.frame.where(scope.condition(query.select.having)), scope.values)
    return query.projected(scope, parts, "__first" if query.aggregates else seq, True)


def _tumbling(query: planner.Query, df: DataFrame, options: planner.Options, tolerance: str) -> StreamingQueryPlan:
    """Under a watermark, in append mode: a window leaves when the watermark has passed its end."""
    if query.stateful:
        raise s.SqlError("over a stream, stateful functions can't be combined with windows and aggregates")
    scope = query._scope(df)
    df = df.where(scope.condition(query.select.where)) if query.select.where else df
    df = df.withWatermark(options.ts, tolerance).withColumn("__window", F.window(options.ts, f"{query.select.window.numbers[0]} seconds"))
    scope = query._scope(df)
    if not query.aggregates:
        return StreamingQueryPlan(df, lambda batch: query.projected(query._scope(batch), [], options.seq, True))
    grouped = query._aggregated(df, scope, ["__window"], options.seq, True)
    if query.select.having:
        grouped = query._scope(grouped.frame.where(grouped.condition(query.select.having)), grouped.values)
    rows = grouped.frame

    return StreamingQueryPlan(rows, lambda batch: query.projected(query._scope(batch, grouped.values), ["__window"], "__first", True))


def plan_stream(sql: str, df: DataFrame, options: planner.Options = planner.Options(), tolerance: str = "0 seconds") -> StreamingQueryPlan:
    """The streaming form of a query. Aggregates without a window work on each micro-batch."""
    query = planner.plan(sql, [c for c in df.columns if c not in options.hidden])
    if query.select.window and query.select.window.kind == "tumbling":
        return _tumbling(query, df, options, tolerance)
    if query.select.window:
        if query.stateful:
            raise s.SqlError("over a stream, stateful functions can't be combined with windows and aggregates")
        return _windowed(query, df, options)
    if query.stateful:
        return _stateful(query, df, options)
    return StreamingQueryPlan(df, lambda batch: query.ordered(batch, options))


def start_query(sql: str, df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, options: planner.Options = planner.Options(), tolerance: str = "0 seconds", trigger: dict | None = None, ordered: bool = False) -> StreamingQuery:
    """Starts a query; ``sink(rows, batch number)`` gets the output rows of every micro-batch, or with ``ordered`` a frame with hidden columns and its order."""
    planned = plan_stream(sql, df, options, tolerance)

    def give(batch: DataFrame, number: int) -> None:
        rows, sort = planned.finish(batch)
        sink((rows, sort) if ordered else rows.orderBy(*sort).drop(*[c for c in rows.columns if c.startswith("__h")]), number)

    writer = planned.rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(give).trigger(**(trigger or {"availableNow": True})).start()
