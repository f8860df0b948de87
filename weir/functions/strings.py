"""String functions. Places count characters from 0."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import Arg, FunctionError, define, register

add = define("string")
_BLANK = r"[\s\p{Z}\x85]"


def _error_if(condition: Column, message: str, otherwise: Column) -> Column:
    return F.when(condition, F.raise_error(F.lit(message)).cast("string")).otherwise(otherwise)


for _name, _f in (("lower", F.lower), ("upper", F.upper), ("reverse", F.reverse)):
    register(_name, lambda s, f=_f: f(s.col), 1, category="string")
register("length", lambda s: F.char_length(s.col).cast("long"), 1, category="string")
register("numbytes", lambda s: F.octet_length(s.col).cast("long"), 1, category="string")
register("endswith", lambda s, x: s.col.endswith(x.col), 2, category="string")
register("startswith", lambda s, x: s.col.startswith(x.col), 2, category="string")
register("indexof", lambda s, x: (F.position(x.col, s.col) - 1).cast("long"), 2, category="string")
register("regexp_matches", lambda s, p: F.regexp_like(s.col, p.col), 2, category="string")
register("regexp_replace", lambda s, p, r: F.regexp_replace(s.col, p.col, r.col), 3, category="string")
register("lpad", lambda s, n: F.concat(F.repeat(F.lit(" "), n.col.cast("int")), s.col), 2, category="string", doc="Prepends n spaces.")
register("rpad", lambda s, n: F.concat(s.col, F.repeat(F.lit(" "), n.col.cast("int"))), 2, category="string", doc="Appends n spaces.")
register("ltrim", lambda s: F.regexp_replace(s.col, f"^{_BLANK}+", ""), 1, category="string")
register("rtrim", lambda s: F.regexp_replace(s.col, f"{_BLANK}+$", ""), 1, category="string")
register("trim", lambda s: F.regexp_replace(s.col, f"^{_BLANK}+|{_BLANK}+$", ""), 1, category="string")


@add(2)
def concat(a: Arg, b: Arg) -> Column:
    """Two strings; a null one is an error."""
    return _error_if(a.col.isNull() | b.col.isNull(), "concat of a null", F.concat(a.col, b.col))


@add(2, 2, "regexp_substr")
def regexp_substring(s: Arg, pattern: Arg) -> Column:
    """The first match, or an empty string."""
    return F.when(s.col.isNotNull() & pattern.col.isNotNull(), F.coalesce(F.regexp_substr(s.col, pattern.col), F.lit("")))


@add(2, 3)
def substring(s: Arg, start: Arg, length: Arg | None = None) -> Column:
    """From a place on; negative numbers are errors."""
    begin = start.col.cast("int")
    if length is None:
        return _error_if(begin < 0, "a negative start", F.substring(s.col, begin + 1, F.lit(2**31 - 1)))
    return _error_if((begin < 0) | (length.col < 0), "a negative start or length", F.substring(s.col, begin + 1, length.col.cast("int")))


@add(3)
def split_value(s: Arg, delimiter: Arg, index: Arg) -> Column:
    """One part of a split; negative indexes count from the end, others outside are errors."""
    parts = F.split(s.col, F.concat(F.lit("\\Q"), delimiter.col, F.lit("\\E")), -1)
    i = index.col.cast("int")
    return F.element_at(parts, F.when(i < 0, i).otherwise(i + 1))


@F.pandas_udf(T.StringType())
def _fixed(values: pd.Series, places: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) or pd.isna(p) else f"{v:.{int(p)}f}" for v, p in zip(values, places)], dtype=object)


#: Group and decimal marks of locales.
MARKS = {"en_us": (",", "."), "en_gb": (",", "."), "zh_cn": (",", "."), "ja_jp": (",", "."), "de_de": (".", ","), "es_es": (".", ","), "it_it": (".", ","), "pt_br": (".", ","), "fr_fr": ("\u202f", ","), "ru_ru": ("\u00a0", ","), "de_ch": ("\u2019", ".")}


@add(2, 3)
def format_(value: Arg, places: Arg, locale: Arg | None = None) -> Column:
    """A number with so many decimals, ties to even on its exact value; with a locale, grouped.

    Built-in formatting rounds the shortest decimal form, so this one is a vectorised UDF.
    """
    plain = _fixed(value.col.cast("double"), places.col.cast("int"))
    if locale is None:
        return plain
    marks = MARKS.get(str(locale.value("a locale")).lower().replace("-", "_"))
    if not marks:
        raise FunctionError(f"unknown locale {locale.literal}")
    whole, rest = F.split_part(plain, F.lit("."), F.lit(1)), F.split_part(plain, F.lit("."), F.lit(2))
    grouped = F.regexp_replace(whole, r"(?<=\d)(?=(?:\d{3})+$)", marks[0])
    return F.when(rest == "", grouped).otherwise(F.concat(grouped, F.lit(marks[1]), rest))
