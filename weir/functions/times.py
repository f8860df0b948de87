"""Time functions, in UTC."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import Arg, FunctionError, define, register

add = define("datetime")

register("now", lambda: F.current_timestamp(), 0, category="datetime", aliases=("current_timestamp",))
register("cur_date", lambda: F.date_format(F.current_timestamp(), "yyyy-MM-dd"), 0, category="datetime", aliases=("current_date",))
register("cur_time", lambda: F.date_format(F.current_timestamp(), "HH:mm:ss.SSSSSS"), 0, category="datetime", aliases=("current_time",))
register("day_of_month", lambda t: F.dayofmonth(t.col).cast("long"), 1, category="datetime", aliases=("day",))
register("day_of_week", lambda t: F.dayofweek(t.col).cast("long"), 1, category="datetime", doc="Sunday is 1.")
register("day_of_year", lambda t: F.dayofyear(t.col).cast("long"), 1, category="datetime")
for _name in ("hour", "minute", "month", "second"):
    register(_name, lambda t, f=getattr(F, _name): f(t.col).cast("long"), 1, category="datetime")
register("microsecond", lambda t: F.pmod(F.unix_micros(t.col.cast("timestamp")), F.lit(1_000_000)), 1, category="datetime")
register("day_name", lambda t: F.date_format(t.col, "EEEE"), 1, category="datetime")
register("month_name", lambda t: F.date_format(t.col, "MMMM"), 1, category="datetime")
register("last_day", lambda t: F.date_format(F.last_day(t.col), "yyyy-MM-dd"), 1, category="datetime")
register("from_unix_time", lambda s: F.timestamp_seconds(s.col), 1, category="datetime")

#: Strftime letters as Spark's date patterns.
LETTERS = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "B": "MMMM", "b": "MMM", "h": "MMM", "A": "EEEE", "a": "EEE",
    "j": "DDD", "I": "hh", "p": "a", "f": "SSSSSSSSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm", "z": "xx", "Z": "'UTC'",
}


def pattern(text: str) -> str:
    """A strftime format as a date pattern."""
    out = []
    for percent, letter, plain in re.findall(r"(%)(3f|6f|9f|.)|([^%]+)", text):
        if not percent:
            out.append("'" + plain.replace("'", "''") + "'")
        elif letter == "%":
            out.append("'%'")
        elif letter in ("3f", "6f", "9f"):
            out.append("S" * int(letter[0]))
        elif letter in LETTERS:
            out.append(LETTERS[letter])
        else:
            raise FunctionError(f"unknown format %{letter}")
    return "".join(out)


@add(2)
def format_time(t: Arg, layout: Arg) -> Column:
    """By a literal strftime format."""
    return F.date_format(t.col, pattern(str(layout.value("the format"))))
