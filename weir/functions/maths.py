"""Mathematical functions. Results that aren't numbers are null; infinite ones stay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import Arg, define, register

add = define("math")


def double(a: Arg) -> Column:
    return a.col.cast("double")


def number_or_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def _unary(name: str, f, clean: bool = False) -> None:
    register(name, lambda x: number_or_null(f(double(x))) if clean else f(double(x)), 1, category="math")


for _name in ("acos", "asin", "cos", "sin", "sqrt", "tan"):
    _unary(_name, getattr(F, _name), clean=True)
for _name in ("atan", "cosh", "exp", "sinh", "tanh", "radians", "degrees"):
    _unary(_name, getattr(F, _name))
_unary("floor", lambda x: F.floor(x).cast("double"))
register("ceiling", lambda x: F.ceil(double(x)).cast("double"), 1, category="math", aliases=("ceil",))


def _log(x: Column) -> Column:
    return F.when(x < 0, F.lit(None).cast("double")).when(x == 0, F.lit(float("-inf"))).otherwise(F.ln(x))


_unary("ln", _log)
register("atan2", lambda y, x: F.atan2(double(y), double(x)), 2, category="math")
register("power", lambda a, b: number_or_null(F.pow(double(a), double(b))), 2, category="math", aliases=("pow",))
register("pi", lambda: F.pi(), 0, category="math")
register("rand", lambda: F.rand(), 0, category="math")
register("bitand", lambda a, b: a.col.bitwiseAND(b.col), 2, category="math")
register("bitor", lambda a, b: a.col.bitwiseOR(b.col), 2, category="math")
register("bitxor", lambda a, b: a.col.bitwiseXOR(b.col), 2, category="math")
register("bitnot", lambda a: F.bitwise_not(a.col), 1, category="math")


@add(2)
def mod(a: Arg, b: Arg) -> Column:
    """Remainder of doubles; null for a divisor of 0."""
    return F.when(double(b) != 0, double(a) % double(b))


@add(1)
def abs_(x: Arg) -> Column:
    """Keeps the argument's type."""
    return F.abs(x.col)


@add(1)
def sign(x: Arg) -> Column:
    return F.signum(double(x)).cast("long")


@add(1)
def cot(x: Arg) -> Column:
    """An infinite result is an error."""
    inverse = F.lit(1.0).cast("double") / F.nullif(F.tan(double(x)), F.lit(0.0))
    return F.when(F.tan(double(x)) == 0, F.raise_error(F.lit("cot is infinite")).cast("double")).otherwise(inverse)


@add(1, 2)
def log(a: Arg, b: Arg | None = None) -> Column:
    """log(x) to the base 10, or log(base, x)."""
    if b is None:
        return F.when(double(a) < 0, F.lit(None).cast("double")).when(double(a) == 0, F.lit(float("-inf"))).otherwise(F.log10(double(a)))
    return number_or_null(F.try_divide(_log(double(b)), _log(double(a))))


@add(1, 2)
def round_(x: Arg, places: Arg | None = None) -> Column:
    """Half away from zero."""
    return F.round(double(x), places.col.cast("int") if places else F.lit(0))


@add(3)
def conv(text: Arg, base: Arg, to: Arg) -> Column:
    """Digits of one base in another, as unsigned 64-bit numbers."""
    return F.conv(text.col.cast("string"), int(base.value("a base")), int(to.value("a base")))


def is_integral(t: T.DataType) -> bool:
    return isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
