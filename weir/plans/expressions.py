"""Expressions of the dialect as Spark columns.

Equality is total (two nulls are equal, a null and a value are not), an ordering with a
null is false, AND and OR take null for false, and NOT of a null is an error. Integers of
8 to 32 bits saturate in sums and differences; division gives doubles and raises on 0.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import registry
from . import syntax as s

#: Bounds of the integer types that saturate.
SMALL = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31}
#: Numbers from the narrowest type to the widest, but for decimals; and the operators that make conditions.
WIDTH = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 3, T.LongType: 4, T.FloatType: 5, T.DoubleType: 6}
CONDITIONS = {"AND", "OR", "=", "!=", "<", "<=", ">", ">="}


class Scope:
    """Names that an expression may use, over a frame whose analyzer tells types."""

    def __init__(self, frame: DataFrame, source: str, source_alias: str | None = None, columns: list[str] | None = None):
        self.frame, self.sources = frame, {source.lower(), (source_alias or source).lower()}
        self.columns = list(columns if columns is not None else frame.columns)
        self.values: dict[s.Node, Column] = {}  # expressions that are columns already

    @functools.cached_property
    def _by_name(self) -> dict[str, str]:
        """Column names by themselves, and by their lower-case form, of which the first counts."""
        found = {}
        for c in self.columns:
            found.setdefault(c.lower(), c)
        return found | {c: c for c in self.columns}

    def _column(self, node: s.Name) -> str:
        if node.source and node.source.lower() not in self.sources:
            raise s.SqlError(f"unknown source {node.source}")
        found = self._by_name.get(node.column) or self._by_name.get(node.column.lower())
        if not found:
            raise s.SqlError(f"unknown column {node}")
        return found

    def name(self, node: s.Name) -> Column:
        return F.col(f"`{self._column(node)}`")

    def type_of(self, column: Column, node: s.Node | None = None) -> T.DataType:
        """The type of an expression: from the schema where that is plain, else from the analyzer."""
        known = self.kind(node) if node is not None else None
        return known if known is not None else self.frame.select(column.alias("x")).schema[0].dataType

    @functools.cached_property
    def types(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.frame.schema.fields}

    def kind(self, node: s.Node) -> T.DataType | None:
        """The type of columns, literals, conditions and arithmetic; None where only the analyzer knows."""
        if node in self.values:
            return None
        if isinstance(node, s.Group):
            return self.kind(node.x)
        if isinstance(node, s.Literal):
            return {bool: T.BooleanType(), float: T.DoubleType(), str: T.StringType()}.get(type(node.value), T.LongType() if node.value is None or type(node.value) is int else None)
        if isinstance(node, s.Name):
            return self.types.get(self._column(node))
        if isinstance(node, (s.Between, s.In)) or isinstance(node, s.Unary) and node.op != "-" or isinstance(node, s.Binary) and node.op in CONDITIONS:
            return T.BooleanType()
        if isinstance(node, s.Unary):
            x = self.kind(node.x)
            return x if type(x) in WIDTH else None
        if isinstance(node, s.Binary):
            a, b = self.kind(node.a), self.kind(node.b)
            if type(a) in WIDTH and type(b) in WIDTH:
                return T.DoubleType() if node.op == "/" else max(a, b, key=lambda k: WIDTH[type(k)]) if {type(a), type(b)} != {T.LongType, T.FloatType} else None
        return None

    def compile(self, node: s.Node) -> Column:
        if node in self.values:
            return self.values[node]
        return getattr(self, "_" + type(node).__name__.lower())(node)

    def condition(self, node: s.Node) -> Column:
        """A predicate; one that isn't boolean is refused, and null is false."""
        column = self.compile(node)
        if not isinstance(self.type_of(column, node), (T.BooleanType, T.NullType)):
            raise s.SqlError(f"not a condition: {node}")
        return F.coalesce(column.cast("boolean"), F.lit(False))

    def _literal(self, node):
        return F.lit(None).cast("long") if node.value is None else F.lit(node.value).cast("long") if type(node.value) is int else F.lit(node.value)

    def _name(self, node):
        return self.name(node)

    def _group(self, node):
        return self.compile(node.x)

    def _star(self, node):
        raise s.SqlError("* has no place here")

    def _unary(self, node):
        x = self.compile(node.x)
        if node.op == "-":
            return -x
        return F.when(x.isNull(), F.raise_error(F.lit("NOT of a null")).cast("boolean")).otherwise(~x)

    def _logical(self, node):
        a, b = (F.coalesce(self.compile(x), F.lit(False)) for x in (node.a, node.b))
        return a & b if node.op == "AND" else a | b

    def _sides(self, a: s.Node, b: s.Node) -> tuple[Column, Column, bool]:
        """Both sides in a common type; whether they have one but for text."""
        x, y = self.compile(a), self.compile(b)
        t, u = self.type_of(x, a), self.type_of(y, b)
        if t == u or isinstance(t, T.NumericType) and isinstance(u, T.NumericType):
            return x, y, True
        return x.cast("string"), y.cast("string"), False

    def _equal(self, a: s.Node, b: s.Node) -> Column:
        x, y, same = self._sides(a, b)
        return x.eqNullSafe(y) if same else x.isNull() & y.isNull()

    def _compare(self, op: str, a: s.Node, b: s.Node) -> Column:
        if op == "=":
            return self._equal(a, b)
        if op == "!=":
            return ~self._equal(a, b)
        x, y, _ = self._sides(a, b)
        return F.coalesce({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], F.lit(False))

    def _binary(self, node):
        if node.op in ("AND", "OR"):
            return self._logical(node)
        if node.op in ("=", "!=", "<", "<=", ">", ">="):
            return self._compare(node.op, node.a, node.b)
        x, y = self.compile(node.a), self.compile(node.b)
        t, u = self.type_of(x, node.a), self.type_of(y, node.b)
        if isinstance(t, T.StringType) and isinstance(u, T.StringType) and node.op == "+":
            return F.concat(x, y)
        if not all(isinstance(k, (T.NumericType, T.NullType)) for k in (t, u)):
            raise s.SqlError(f"no numbers: {node}")
        if node.op in "+-" and type(t) in SMALL and type(u) in SMALL:
            wide = max(t, u, key=lambda k: SMALL[type(k)])
            top = 1 << SMALL[type(wide)]
            total = x.cast("long") + y.cast("long") if node.op == "+" else x.cast("long") - y.cast("long")
            return F.when(total.isNotNull(), F.greatest(F.lit(-top), F.least(F.lit(top - 1), total))).cast(wide)
        if node.op == "/":
            return x.cast("double") / y.cast("double")
        return {"+": x + y, "-": x - y, "*": x * y, "%": x % y}[node.op]

    def _between(self, node):
        inside = self._compare("<=", node.low, node.x) & self._compare("<=", node.x, node.high)
        return ~inside if node.negated else inside

    def _in(self, node):
        found = F.lit(False)
        for option in node.options:
            found = found | self._equal(node.x, option)
        return ~found if node.negated else found

    def _case(self, node):
        out = None
        for a, b in node.whens:
            test = self._equal(node.operand, a) if node.operand else F.coalesce(self.compile(a), F.lit(False))
            out = F.when(test, self.compile(b)) if out is None else out.when(test, self.compile(b))
        return out.otherwise(self.compile(node.default)) if node.default else out

    def _field(self, node):
        x = self.compile(node.x)
        kind = self.type_of(x, node.x)
        if not isinstance(kind, T.StructType) or node.name not in kind.names:
            raise s.SqlError(f"no field {node.name} in {node.x}")
        return x.getField(node.name)

    def _index(self, node):
        x = self.compile(node.x)
        if isinstance(self.type_of(x, node.x), T.MapType):
            return F.try_element_at(x, self.compile(node.at))
        if isinstance(node.at, s.Literal) and (not isinstance(node.at.value, int) or node.at.value < 0):
            raise s.SqlError(f"an index must be 0 or more: {node}")
        return x[self.compile(node.at).cast("int")]

    def _call(self, node):
        if node.where or node.by:
            raise s.SqlError(f"FILTER and OVER have no place on {node.name}")
        return registry.build(node.name, [self.arg(a) for a in node.args])

    def arg(self, node: s.Node) -> registry.Arg:
        column = self.compile(node)
        kind = lambda: self.type_of(column, node)
        return registry.Arg(column, kind, node.value) if isinstance(node, s.Literal) else registry.Arg(column, kind)
