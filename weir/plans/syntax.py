"""The SQL dialect: tokens, expressions, one SELECT over one stream."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, fields, replace


class SqlError(ValueError):
    """Text that is not of the dialect, or asks for what it doesn't have."""


class Node:
    """An expression. Equality is structural."""

    def children(self) -> Iterator[Node]:
        for f in fields(self):
            yield from _nodes(getattr(self, f.name))

    def map(self, change) -> Node:
        """A copy with ``change`` applied to the children."""
        return replace(self, **{f.name: _mapped(getattr(self, f.name), change) for f in fields(self)})


def _nodes(x) -> Iterator[Node]:
    if isinstance(x, Node):
        yield x
    elif isinstance(x, tuple):
        for y in x:
            yield from _nodes(y)


def _mapped(x, change):
    if isinstance(x, Node):
        return change(x)
    return tuple(_mapped(y, change) for y in x) if isinstance(x, tuple) else x


@dataclass(frozen=True)
class Literal(Node):
    value: object

    def __str__(self):
        v = self.value
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


@dataclass(frozen=True)
class Name(Node):
    column: str
    source: str | None = None

    def __str__(self):
        return f"{self.source}.{self.column}" if self.source else self.column


@dataclass(frozen=True)
class Star(Node):
    source: str | None = None

    def __str__(self):
        return f"{self.source}.*" if self.source else "*"


@dataclass(frozen=True)
class Unary(Node):
    op: str
    x: Node

    def __str__(self):
        return f"NOT {self.x}" if self.op == "NOT" else f"-{self.x}"


@dataclass(frozen=True)
class Binary(Node):
    op: str
    a: Node
    b: Node

    def __str__(self):
        return f"{self.a} {self.op} {self.b}"


@dataclass(frozen=True)
class Group(Node):
    """Parentheses, which the text of an expression keeps."""

    x: Node

    def __str__(self):
        return f"({self.x})"


@dataclass(frozen=True)
class Between(Node):
    x: Node
    low: Node
    high: Node
    negated: bool

    def __str__(self):
        return f"{self.x} {'NOT ' * self.negated}BETWEEN {self.low} AND {self.high}"


@dataclass(frozen=True)
class In(Node):
    x: Node
    options: tuple[Node, ...]
    negated: bool

    def __str__(self):
        return f"{self.x} {'NOT ' * self.negated}IN ({', '.join(map(str, self.options))})"


@dataclass(frozen=True)
class Case(Node):
    operand: Node | None
    whens: tuple[tuple[Node, Node], ...]
    default: Node | None

    def __str__(self):
        return "CASE " + (f"{self.operand} " if self.operand else "") + " ".join(f"WHEN {a} THEN {b}" for a, b in self.whens) + (f" ELSE {self.default}" if self.default else "") + " END"


@dataclass(frozen=True)
class Field(Node):
    x: Node
    name: str

    def __str__(self):
        return f"{self.x}->{self.name}"


@dataclass(frozen=True)
class Index(Node):
    x: Node
    at: Node

    def __str__(self):
        return f"{self.x}[{self.at}]"


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]
    where: Node | None = None
    by: tuple[Node, ...] = ()

    def __str__(self):
        return f"{self.name}({', '.join(map(str, self.args))})" + (f" FILTER (WHERE {self.where})" if self.where else "") + (f" OVER (PARTITION BY {', '.join(map(str, self.by))})" if self.by else "")


@dataclass(frozen=True)
class Window:
    """tumbling(seconds), count(rows), sliding(back, ahead) or state(open, emit, by)."""

    kind: str
    numbers: tuple[int, ...] = ()
    open: Node | None = None
    emit: Node | None = None
    by: tuple[Node, ...] = ()


@dataclass(frozen=True)
class Item:
    expr: Node
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or (self.expr.column if isinstance(self.expr, Name) else str(self.expr))


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    source: str
    source_alias: str | None = None
    where: Node | None = None
    keys: tuple[Node, ...] = ()
    window: Window | None = None
    having: Node | None = None
    order: tuple[tuple[Node, bool], ...] = field(default=())


WINDOWS = {"tumblingwindow": "tumbling", "countwindow": "count", "slidingwindow": "sliding", "statewindow": "state"}
#: What has no place in the dialect, with what to write instead.
REFUSED = {
    "LIMIT": "LIMIT is not supported", "OFFSET": "OFFSET is not supported", "UNION": "set operations are not supported", "INTERSECT": "set operations are not supported", "EXCEPT": "set operations are not supported",
    "JOIN": "joins are not supported", "INNER": "joins are not supported", "LEFT": "joins are not supported", "RIGHT": "joins are not supported", "FULL": "joins are not supported", "CROSS": "joins are not supported", "WITH": "common table expressions are not supported",
    "LIKE": "LIKE is not supported; use regexp_matches()", "IS": "IS is not supported; use isnull()", "EXISTS": "subqueries are not supported", "FETCH": "FETCH is not supported", "NULLS": "NULLS FIRST and NULLS LAST are not supported",
}
KEYWORDS = {"SELECT", "FROM", "WHERE", "GROUP", "BY", "HAVING", "ORDER", "AS", "AND", "OR", "NOT", "BETWEEN", "IN", "CASE", "WHEN", "THEN", "ELSE", "END", "NULL", "TRUE", "FALSE", "FILTER", "OVER", "PARTITION", "ASC", "DESC", "DISTINCT", *REFUSED}
_TOKEN = re.compile(r"""\s*(?:(--[^\n]*)|(\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+|\d+(?:[eE][+-]?\d+)?)|('(?:[^']|'')*'|"(?:[^"]|"")*")|(`[^`]+`)|([A-Za-z_]\w*)|(->|<>|!=|<=|>=|\|\||[-+*/%=<>(),.\[\];]))""")


def tokens(sql: str) -> list[tuple[str, object]]:
    """(kind, value): number, string, name, word (an upper-case keyword), op, end."""
    out, at, sql = [], 0, sql.rstrip()
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SqlError(f"unexpected text: {sql[at:at + 20]!r}")
        at = m.end()
        comment, number, string, quoted, word, op = m.groups()
        if number:
            whole = number.isdigit() and int(number) < 1 << 63
            out.append(("number", int(number) if whole else float(number)))
        elif string:
            out.append(("string", string[1:-1].replace(string[0] * 2, string[0])))
        elif quoted:
            out.append(("name", quoted[1:-1]))
        elif word:
            out.append(("word", word.upper()) if word.upper() in KEYWORDS else ("name", word))
        elif op and op != ";":
            out.append(("op", op))
    return [*out, ("end", None)]


class Parser:
    """Recursive descent, one method a level of precedence."""

    def __init__(self, sql: str):
        self.tokens, self.at = tokens(sql), 0

    def peek(self, *values: object) -> bool:
        kind, value = self.tokens[self.at]
        return kind in ("word", "op") and value in values

    def take(self, *values: object) -> object:
        """The next token if it is one of these, else nothing."""
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            self.fail(f"expected {value}")

    def fail(self, what: str):
        kind, value = self.tokens[self.at]
        if kind == "word" and value in REFUSED:
            raise SqlError(REFUSED[value])
        raise SqlError(f"{what}, found {'the end' if kind == 'end' else repr(value)}")

    def name(self) -> str:
        kind, value = self.tokens[self.at]
        if kind != "name":
            self.fail("expected a name")
        self.at += 1
        return value

    def listed(self, one) -> tuple:
        out = [one()]
        while self.take(","):
            out.append(one())
        return tuple(out)

    def select(self) -> Select:
        self.need("SELECT")
        if self.peek("DISTINCT"):
            raise SqlError("SELECT DISTINCT is not supported; use deduplicate()")
        items = self.listed(self.item)
        self.need("FROM")
        if self.peek("("):
            raise SqlError("subqueries are not supported")
        source, alias = self.name(), None
        if self.take("AS") or self.tokens[self.at][0] == "name":
            alias = self.name()
        if self.peek(","):
            raise SqlError("several sources are not supported")
        where = self.expr() if self.take("WHERE") else None
        keys, window = self.grouping() if self.take("GROUP") else ((), None)
        having = self.expr() if self.take("HAVING") else None
        order = ()
        if self.take("ORDER"):
            self.need("BY")
            order = self.listed(self.order_item)
        if self.tokens[self.at][0] != "end":
            self.fail("unexpected text after the query")
        return Select(items, source, alias, where, keys, window, having, order)

    def item(self) -> Item:
        if self.take("*"):
            return Item(Star())
        if self.tokens[self.at][0] == "name" and [t[1] for t in self.tokens[self.at + 1 : self.at + 3]] == [".", "*"]:
            source = self.name()
            self.at += 2
            return Item(Star(source))
        expr = self.expr()
        return Item(expr, self.name() if self.take("AS") or self.tokens[self.at][0] == "name" else None)

    def order_item(self) -> tuple[Node, bool]:
        expr = self.expr()
        up = self.take("ASC", "DESC") != "DESC"
        if self.peek("NULLS"):
            self.fail("")
        return expr, up

    def grouping(self) -> tuple[tuple[Node, ...], Window | None]:
        self.need("BY")
        keys, window = [], None
        while True:
            kind, value = self.tokens[self.at]
            if kind == "name" and value.lower() in WINDOWS and self.tokens[self.at + 1] == ("op", "("):
                if window:
                    raise SqlError("at most one window is allowed")
                window = self.window()
            elif kind == "name" and re.fullmatch(r"(session|hopping)_?window", value.lower()):
                raise SqlError(f"{value} is not supported")
            else:
                keys.append(self.expr())
            if not self.take(","):
                return tuple(keys), window

    def window(self) -> Window:
        kind = WINDOWS[self.name().lower()]
        self.need("(")
        args = self.listed(self.expr)
        self.need(")")
        by = ()
        if self.take("OVER"):
            if kind != "state":
                raise SqlError("OVER is allowed on state windows only")
            by = self.partition()
        if kind == "state":
            if len(args) != 2:
                raise SqlError("statewindow takes an open and an emit condition")
            return Window(kind, open=args[0], emit=args[1], by=by)
        values = [a.value if isinstance(a, Literal) else None for a in args]
        if kind != "count":
            if not values or not isinstance(values[0], str) or values[0].lower() != "ss":
                raise SqlError("the time unit must be 'ss'")
            values = values[1:]
        least, most = {"tumbling": (1, 1), "count": (1, 1), "sliding": (1, 2)}[kind]
        if not least <= len(values) <= most or not all(isinstance(v, int) and not isinstance(v, bool) and v >= (i > 0 and kind == "sliding" and 0 or 1 - (i > 0)) for i, v in enumerate(values)):
            raise SqlError(f"a {kind} window takes {'one positive number' if most == 1 else 'one or two numbers'}")
        return Window(kind, tuple(values))

    def partition(self) -> tuple[Node, ...]:
        self.need("(")
        if self.peek(")"):
            raise SqlError("OVER () is not supported")
        if self.peek("ORDER"):
            raise SqlError("ORDER BY in OVER is not supported")
        self.need("PARTITION")
        self.need("BY")
        by = self.listed(self.expr)
        if self.peek("ORDER"):
            raise SqlError("ORDER BY in OVER is not supported")
        if not self.take(")"):
            raise SqlError("only PARTITION BY is supported in OVER")
        return by

    def expr(self) -> Node:
        return self._chain(lambda: self._chain(self._not, "AND"), "OR")

    def _chain(self, inner, *ops: str) -> Node:
        found = inner()
        while op := self.take(*ops):
            found = Binary(op, found, inner())
        return found

    def _not(self) -> Node:
        return Unary("NOT", self._not()) if self.take("NOT") else self._comparison()

    def _comparison(self) -> Node:
        found = self._sum()
        while True:
            if op := self.take("=", "!=", "<>", "<", "<=", ">", ">="):
                found = Binary("!=" if op == "<>" else op, found, self._sum())
                continue
            negated = self.peek("NOT") and self.tokens[self.at + 1][1] in ("BETWEEN", "IN", "LIKE") and bool(self.take("NOT"))
            if self.take("BETWEEN"):
                low = self._sum()
                self.need("AND")
                found = Between(found, low, self._sum(), negated)
            elif self.take("IN"):
                self.need("(")
                if self.peek("SELECT"):
                    raise SqlError("subqueries are not supported")
                options = () if self.peek(")") else self.listed(self.expr)
                self.need(")")
                found = In(found, options, negated)
            elif self.peek("LIKE", "IS"):
                self.fail("")
            else:
                return found

    def _sum(self) -> Node:
        if self.peek("||"):
            raise SqlError("|| is not supported; use concat() or +")
        return self._chain(lambda: self._chain(self._sign, "*", "/", "%"), "+", "-")

    def _sign(self) -> Node:
        if self.take("-"):
            x = self._sign()
            return Literal(-x.value) if isinstance(x, Literal) and isinstance(x.value, (int, float)) and not isinstance(x.value, bool) else Unary("-", x)
        return self._postfix()

    def _postfix(self) -> Node:
        found = self._primary()
        while True:
            if self.take("->"):
                kind, value = self.tokens[self.at]
                if kind not in ("name", "word", "string"):
                    self.fail("expected a field")
                self.at += 1
                found = Field(found, value if kind != "word" else value.lower())
            elif self.take("["):
                found = Index(found, self.expr())
                self.need("]")
            elif self.peek("||"):
                raise SqlError("|| is not supported; use concat() or +")
            else:
                return found

    def _primary(self) -> Node:
        kind, value = self.tokens[self.at]
        if kind in ("number", "string"):
            self.at += 1
            return Literal(value)
        if word := self.take("NULL", "TRUE", "FALSE"):
            return Literal({"NULL": None, "TRUE": True, "FALSE": False}[word])
        if self.take("("):
            if self.peek("SELECT"):
                raise SqlError("subqueries are not supported")
            found = self.expr()
            self.need(")")
            return Group(found)
        if self.take("CASE"):
            return self._case()
        name = self.name()
        if self.take("("):
            return self._call(name)
        if self.take("."):
            return Name(self.name(), name)
        return Name(name)

    def _case(self) -> Case:
        operand = None if self.peek("WHEN") else self.expr()
        whens = []
        while self.take("WHEN"):
            a = self.expr()
            self.need("THEN")
            whens.append((a, self.expr()))
        if not whens:
            self.fail("expected WHEN")
        default = self.expr() if self.take("ELSE") else None
        self.need("END")
        return Case(operand, tuple(whens), default)

    def _call(self, name: str) -> Call:
        if self.peek("DISTINCT"):
            raise SqlError("DISTINCT in a function is not supported")
        args: tuple[Node, ...] = ()
        if self.take("*"):
            args = (Star(),)
        elif not self.peek(")"):
            args = self.listed(self.expr)
        if self.peek("ORDER"):
            raise SqlError("ORDER BY in a function is not supported")
        if self.peek("AS"):
            raise SqlError("CAST ... AS is not supported; use cast(value, 'type')")
        self.need(")")
        where, by = None, ()
        if self.take("FILTER"):
            self.need("(")
            self.need("WHERE")
            where = self.expr()
            self.need(")")
        if self.take("OVER"):
            by = self.partition()
        return Call(name.lower(), args, where, by)


def parse(sql: str) -> Select:
    """One SELECT of the dialect."""
    return Parser(sql).select()
