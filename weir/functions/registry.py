"""Names, aliases and arities of scalar functions, and their column builders.

A builder gets ``Arg`` objects and returns a Column. Unless a builder says otherwise a
null argument gives null, as Spark's own expressions do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import types as T


class FunctionError(ValueError):
    """A call that can't be planned: unknown name, wrong arity or argument."""


_NONE = object()


@dataclass
class Arg:
    """A compiled argument: its column, its type (asked of the analyzer when needed), its value if it is a literal."""

    col: Column
    kind: Callable[[], T.DataType]
    literal: object = _NONE

    @property
    def type(self) -> T.DataType:
        return self.kind()

    @property
    def is_literal(self) -> bool:
        return self.literal is not _NONE

    def value(self, what: str) -> object:
        if not self.is_literal:
            raise FunctionError(f"{what} must be a literal")
        return self.literal


@dataclass
class Function:
    name: str
    build: Callable[..., Column]
    least: int
    most: int | None
    category: str
    aliases: tuple[str, ...] = ()
    doc: str = ""


FUNCTIONS: dict[str, Function] = {}
_BY_NAME: dict[str, Function] = {}


def register(name: str, build: Callable[..., Column], least: int, most: int | None = -1, category: str = "user", aliases: tuple[str, ...] = (), doc: str = "") -> None:
    """Adds a function; names are case-insensitive, and a taken one is refused."""
    found = Function(name.lower(), build, least, least if most == -1 else most, category, tuple(a.lower() for a in aliases), doc)
    for key in (found.name, *found.aliases):
        if key in _BY_NAME:
            raise FunctionError(f"a function {key} exists already")
    FUNCTIONS[found.name] = found
    for key in (found.name, *found.aliases):
        _BY_NAME[key] = found


def find(name: str) -> Function | None:
    return _BY_NAME.get(name.lower())


def build(name: str, args: list[Arg]) -> Column:
    found = find(name)
    if not found:
        raise FunctionError(f"unknown function {name}")
    if len(args) < found.least or found.most is not None and len(args) > found.most:
        raise FunctionError(f"{name} takes {found.least}{'' if found.most == found.least else f' to {found.most}' if found.most else ' or more'} arguments, not {len(args)}")
    return found.build(*args)


def catalog() -> list[dict]:
    """What there is, for introspection."""
    return [{"name": f.name, "aliases": list(f.aliases), "min_args": f.least, "max_args": f.most, "category": f.category, "doc": f.doc} for f in sorted(FUNCTIONS.values(), key=lambda f: f.name)]


def define(category: str):
    """A decorator-maker for one category's module: ``@add(least, most, *aliases)``."""

    def add(least: int, most: int | None = -1, *aliases: str, name: str | None = None):
        def wrap(f):
            register(name or f.__name__.strip("_"), f, least, most, category, aliases, (f.__doc__ or "").strip())
            return f

        return wrap

    return add


from . import arrays, maths, misc, objects, strings, times  # noqa: E402, F401  they register themselves
