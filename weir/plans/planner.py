"""A SELECT over a stream as a logical plan and as a DataFrame.

Order of work: per-row state (which sees every row), WHERE, window, aggregation, HAVING,
ORDER BY, projection. Catalyst does the rest: pruning, pushdown, partial aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import aggregates, ordering, stateful, windows
from ..scratch import written
from . import syntax as s
from .expressions import Scope

RESERVED = ("__", "tumblingwindow", "countwindow", "slidingwindow", "statewindow")


@dataclass(frozen=True)
class Options:
    """How a query runs: its order and time columns, whether an unfinished count window counts, and how the stream ends."""

    seq: str = "__seq"
    ts: str = "__ts"
    hidden: tuple[str, ...] = ("__seq", "__ts", "__order")
    flush_partial: bool = False
    graceful: bool = True
    range_rows: int = ordering.RANGE_ROWS


@dataclass(frozen=True)
class Step:
    """A node of the logical plan."""

    operator: str
    detail: str = ""


def _walk(node: s.Node):
    yield node
    for x in node.children():
        yield from _walk(x)


def _calls(node: s.Node, names) -> list[s.Call]:
    return [x for x in _walk(node) if isinstance(x, s.Call) and x.name in names]


class Query:
    """A checked SELECT over the columns of a stream."""

    def __init__(self, select: s.Select, columns: list[str]):
        self.columns = columns
        self.names: list[str] = []
        self.select = self._expanded(select)
        self._check()

    def _expanded(self, select: s.Select) -> s.Select:
        """Aliases replaced, in later items, WHERE and ORDER BY, and stars by columns."""
        known: dict[str, s.Node] = {}
        low = {c.lower() for c in self.columns}

        def change(node: s.Node) -> s.Node:
            if isinstance(node, s.Name) and not node.source and node.column in known:
                return s.Group(known[node.column])
            return node.map(change)

        items = []
        for item in select.items:
            if isinstance(item.expr, s.Star):
                if item.expr.source and item.expr.source not in (select.source, select.source_alias):
                    raise s.SqlError(f"unknown source {item.expr.source}")
                items += [s.Item(s.Name(c)) for c in self.columns]
                self.names += self.columns
                continue
            if item.alias:
                if item.alias.lower() in low and not (isinstance(item.expr, s.Name) and item.expr.column.lower() == item.alias.lower()):
                    raise s.SqlError(f"the alias {item.alias} is a column of the stream")
                if item.alias.lower().startswith(RESERVED):
                    raise s.SqlError(f"the alias {item.alias} is reserved")
            expr = change(item.expr)
            items.append(s.Item(expr, item.alias))
            self.names.append(item.name)
            if item.alias and item.alias.lower() not in low:
                known[item.alias] = expr
        return replace(select, items=tuple(items), where=change(select.where) if select.where else None, order=tuple((change(e), up) for e, up in select.order))

    def _check(self) -> None:
        q = self.select
        if len(set(self.names)) < len(self.names):
            raise s.SqlError(f"output names repeat: {', '.join(sorted({n for n in self.names if self.names.count(n) > 1}))}")
        outside = [i.expr for i in q.items] + [e for e, _ in q.order] + ([q.having] if q.having else [])
        self.aggregates = list(dict.fromkeys(c for e in outside for c in _calls(e, aggregates.AGGREGATES)))
        everywhere = outside + [x for x in (q.where, *q.keys, *((q.window.open, q.window.emit, *q.window.by) if q.window else ())) if x is not None]
        for place in ([q.where] if q.where else []) + list(q.keys):
            if _calls(place, aggregates.AGGREGATES):
                raise s.SqlError("aggregates have no place in WHERE and GROUP BY")
        for c in self.aggregates:
            if any(_calls(a, aggregates.AGGREGATES) for a in c.args):
                raise s.SqlError(f"aggregates can't be nested: {c}")
            if c.where or c.by:
                raise s.SqlError(f"FILTER and OVER have no place on {c.name}")
        self.stateful = []
        for e in everywhere:
            for c in _calls(e, stateful.STATEFUL):
                if any(_calls(x, aggregates.AGGREGATES) for x in c.children()):
                    raise s.SqlError(f"an aggregate in {c.name}")
                self.stateful.append(c)
        if q.keys and not self.aggregates:
            raise s.SqlError("GROUP BY needs an aggregate")
        if q.having and not (q.window and self.aggregates):
            raise s.SqlError("HAVING needs a window and an aggregate")
        if self.aggregates and any(_calls(e, stateful.STATEFUL) and not _calls(e, aggregates.AGGREGATES) for e, _ in q.order):
            raise s.SqlError("ORDER BY of an aggregation takes no stateful function")

    def steps(self) -> list[Step]:
        """The logical plan, from the source on."""
        q = self.select
        out = [Step("DataSource", q.source)]
        out += [Step("StatefulFunction", str(c)) for c in dict.fromkeys(self.stateful)]
        out += [Step("Filter", str(q.where))] if q.where else []
        if q.window:
            out.append(Step("Window", q.window.kind + (str(q.window.numbers) if q.window.numbers else f"({q.window.open}, {q.window.emit})")))
        if self.aggregates:
            out.append(Step("Aggregation", ", ".join([*map(str, self.aggregates), *(f"key {k}" for k in q.keys)])))
        out += [Step("Having", str(q.having))] if q.having else []
        out += [Step("Order", ", ".join(f"{e} {'ASC' if up else 'DESC'}" for e, up in q.order))] if q.order else []
        return [*out, Step("Project", ", ".join(self.names))]

    def needed(self) -> set[str]:
        """The stream's columns that the query reads."""
        q = self.select
        nodes = [*(i.expr for i in q.items), *(e for e, _ in q.order), *q.keys, *(x for x in (q.where, q.having) if x)]
        if q.window:
            nodes += [x for x in (q.window.open, q.window.emit, *q.window.by) if x]
        used = {x.column.lower() for n in nodes for x in _walk(n) if isinstance(x, s.Name)}
        return {c for c in self.columns if c.lower() in used}

    def apply(self, df: DataFrame, options: Options = Options()) -> DataFrame:
        """The query's rows."""
        if self._is_star(df, options):
            own = set(self.names)
            return df.drop(*[c for c in df.columns if c not in own])
        return self._applied(df, options, False)[0]

    def _is_star(self, df: DataFrame, options: Options) -> bool:
        """Whether nothing is asked for but the stream's columns as they are."""
        q = self.select
        plain = not (q.where or q.window or q.keys or q.having or q.order) and all(isinstance(i.expr, s.Name) and not i.expr.source and i.expr.column == n for i, n in zip(q.items, self.names))
        own = set(self.names)
        return plain and self.names == [c for c in df.columns if c in own]

    def ordered(self, df: DataFrame, options: Options = Options()) -> tuple[DataFrame, list[Column]]:
        """The query's rows with hidden columns, and the order in which they arrive at a sink."""
        return self._applied(df, options, True)

    def _applied(self, df: DataFrame, options: Options, ordered: bool) -> tuple[DataFrame, list[Column]]:
        q, seq, needed = self.select, options.seq, self.needed()
        columns = [c for c in df.columns if c in needed or c in (options.seq, options.ts)]
        df = df if len(columns) == len(df.columns) else df.select(*[f"`{c}`" for c in columns])
        if any(not c.by for c in self.stateful) or q.window and q.window.kind == "state" and not q.window.by:  # one state for all rows
            df = written(ordering.ranged(df, seq, options.range_rows), "ranged")
        scope = self._scope(df)
        for call in self.stateful:
            scope = self._with_state(scope, call, seq)
        df = scope.frame.where(scope.condition(q.where)) if q.where else scope.frame
        parts: list[str] = []
        slides = q.window and q.window.kind == "sliding" and self.aggregates and all(c.name in aggregates.MERGED for c in self.aggregates)
        slides = slides and not any("map<" in scope.type_of(scope.compile(k), k).simpleString() for k in q.keys)  # maps can't be sorted
        if slides:
            parts = ["__w"]
        elif q.window:
            df, parts = self._windowed(df, scope, options)
        scope = self._scope(df, scope.values)
        if self.aggregates:
            scope = self._aggregated(df, scope, parts, seq, ordered, options.ts if slides else None)
        if q.having:
            scope = self._scope(scope.frame.where(scope.condition(q.having)), scope.values)
        return self.projected(scope, parts, "__first" if self.aggregates else seq, ordered)

    def projected(self, scope: Scope, parts: list[str], last: str, ordered: bool) -> tuple[DataFrame, list[Column]]:
        """The query's columns, in its order; or with the columns of the order (of windows, ORDER BY, then arrival) beside them."""
        q, ways = self.select, lambda c, up: c.asc_nulls_last() if up else c.desc_nulls_last()
        order = [(scope.compile(e), up) for e, up in q.order]
        made = [scope.compile(i.expr).alias(n) for i, n in zip(q.items, self.names)]
        if not ordered:
            df = scope.frame.orderBy(*[F.col(p) for p in parts], *[ways(c, up) for c, up in order]) if order else scope.frame
            return df.select(*made), []
        sort = [*[(F.col(p), True) for p in parts], *order, (F.col(f"`{last}`"), True)]
        return scope.frame.select(*made, *[c.alias(f"__h{i}") for i, (c, _) in enumerate(sort)]), [ways(F.col(f"__h{i}"), up) for i, (_, up) in enumerate(sort)]

    def _scope(self, df: DataFrame, values: dict | None = None) -> Scope:
        scope = Scope(df, self.select.source, self.select.source_alias, [c for c in df.columns if not c.startswith("__")])
        scope.values = dict(values or {})
        return scope

    def _with_state(self, scope: Scope, call: s.Call, seq: str) -> Scope:
        if call in scope.values:
            return scope
        for inner in call.children():
            for nested in _calls(inner, stateful.STATEFUL):
                scope = self._with_state(scope, nested, seq)
        name = f"__s{sum(str(c).startswith('__s') for c in scope.frame.columns)}"
        accept = scope.condition(call.where) if call.where else F.lit(True)
        df = stateful.add_stateful(scope.frame, name, call, [scope.compile(a) for a in call.args], [scope.compile(k) for k in call.by], accept, F.col(seq))
        return self._scope(df, scope.values | {call: F.col(name)})

    def _windowed(self, df: DataFrame, scope: Scope, options: Options) -> tuple[DataFrame, list[str]]:
        w = self.select.window
        if w.kind == "tumbling":
            return windows.tumbling(df, options.ts, *w.numbers)
        if w.kind == "count":
            return windows.count(df, options.seq, *w.numbers, flush_partial=options.flush_partial)
        if w.kind == "sliding":
            return windows.sliding(df, options.ts, options.seq, *w.numbers)
        return windows.state(df, options.seq, scope.condition(w.open), scope.condition(w.emit), [scope.compile(k) for k in w.by], options.graceful)

    def _aggregated(self, df: DataFrame, scope: Scope, parts: list[str], seq: str, ordered: bool = False, slides: str | None = None) -> Scope:
        """Groups; a column that is neither a key nor in an aggregate has the value of the group's last row.

        With ``slides``, the time, ``df`` has the rows themselves rather than those of each sliding window.
        """
        q = self.select
        keys = {k: f"__k{i}" for i, k in enumerate(dict.fromkeys(q.keys))}
        values: dict[s.Node, Column] = {}
        asked: list[tuple[str, Column, T.DataType | None, str]] = []  # name, argument, its type, alias
        for i, call in enumerate(self.aggregates):
            if len(call.args) != 1:
                raise s.SqlError(f"{call.name} takes one argument")
            x = F.lit(1) if isinstance(call.args[0], s.Star) and call.name == "count" else scope.compile(call.args[0])
            asked.append((call.name, x, scope.type_of(x, call.args[0] if not isinstance(call.args[0], s.Star) else None), f"__a{i}"))
            values[call] = F.col(f"__a{i}")
        values |= {k: F.col(n) for k, n in keys.items()}
        last = {}

        def gather(node: s.Node) -> None:
            if node in values:
                return
            if node in scope.values or isinstance(node, s.Name):
                last[node] = f"__l{len(last)}" if node not in last else last[node]
                return
            for x in node.children():
                gather(x)

        for e in [*(i.expr for i in q.items), *(e for e, _ in q.order), *([q.having] if q.having else [])]:
            gather(e)
        asked += [("last_row", scope.compile(n), None, c) for n, c in last.items()]
        asked += [("min", F.col(seq), None, "__first")] if ordered else []
        made = [aggregates.AGGREGATES[name](x, kind, F.col(seq)).alias(alias) for name, x, kind, alias in asked]
        if slides:
            back, ahead = (*q.window.numbers, 0)[:2]
            grouped = windows.slid(df, slides, seq, back, ahead, {n: scope.compile(k) for k, n in keys.items()}, asked)
        else:
            grouped = df.groupBy(*parts, *[scope.compile(k).alias(n) for k, n in keys.items()]).agg(*made)
        out = self._scope(grouped)
        out.values = values | {n: F.col(c) for n, c in last.items()}
        return out


def plan(sql: str, columns: list[str]) -> Query:
    """The checked query of a text, over a stream with these columns."""
    return Query(s.parse(sql), columns)


def run(sql: str, df: DataFrame, options: Options = Options()) -> DataFrame:
    """The rows of ``sql`` over a batch of a stream; ``df`` has the order and time columns that the query needs."""
    return plan(sql, [c for c in df.columns if c not in options.hidden]).apply(df, options)
