"""Conversions, hashes, JSON and the like."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import Arg, FunctionError, define, register

add = define("misc")
RFC3339 = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"

register("bypass", lambda v: v.col, 1, category="misc")
register("isnull", lambda v: v.col.isNull(), 1, category="misc")
register("coalesce", lambda *v: F.coalesce(*[x.col for x in v]), 1, None, category="misc")
register("md5", lambda s: F.md5(s.col), 1, category="misc")
register("sha1", lambda s: F.sha1(s.col), 1, category="misc")
for _bits in (256, 384, 512):
    register(f"sha{_bits}", lambda s, bits=_bits: F.sha2(s.col, bits), 1, category="misc")
register("crc32", lambda s: F.lower(F.hex(F.crc32(s.col.cast("string")))), 1, category="misc", doc="Hexadecimal, without leading zeros.")
register("newuuid", lambda: F.uuid(), 0, category="misc")
register("tstamp", lambda: F.unix_millis(F.current_timestamp()), 0, category="misc")
register("cardinality", lambda a: F.coalesce(F.size(a.col), F.lit(0)).cast("long") if isinstance(a.type, T.ArrayType) else F.lit(0).cast("long"), 1, category="misc")
register("dec2hex", lambda n: F.concat(F.lit("0x"), F.lower(F.hex(n.col.cast("long")))), 1, category="misc")


@add(1)
def chr_(v: Arg) -> Column:
    """The character of a code point; a string of one character stays."""
    if isinstance(v.type, T.StringType):
        return F.when(F.char_length(v.col) == 1, v.col).when(v.col.isNotNull(), F.raise_error(F.lit("not one character")).cast("string"))
    return F.decode(F.unhex(F.lpad(F.hex(v.col.cast("long")), 8, "0")), "UTF-32")


def _base64_only(method: Arg) -> None:
    if str(method.value("the encoding")).lower() != "base64":
        raise FunctionError(f"unknown encoding {method.literal}")


@add(2)
def encode(s: Arg, method: Arg) -> Column:
    _base64_only(method)
    return F.base64(F.encode(s.col, "UTF-8"))


@add(2)
def decode(s: Arg, method: Arg) -> Column:
    _base64_only(method)
    return F.decode(F.unbase64(s.col), "UTF-8")


@add(2)
def trunc(v: Arg, places: Arg) -> Column:
    """Towards zero at so many decimals (-34 to 34)."""
    scale = F.pow(F.lit(10.0), F.greatest(F.lit(-34), F.least(F.lit(34), places.col)).cast("double"))
    scaled = v.col.cast("double") * scale
    return F.when(scaled >= 0, F.floor(scaled).cast("double")).otherwise(F.ceil(scaled).cast("double")) / scale


@add(1)
def hex2dec(s: Arg) -> Column:
    """A hexadecimal string, with or without 0x; others are errors."""
    digits = F.regexp_replace(s.col, "^0[xX]", "")
    return F.when(digits.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(digits, 16, -10).cast("long")).when(s.col.isNotNull(), F.raise_error(F.lit("not a hexadecimal number")).cast("long"))


@add(1)
def to_json(v: Arg) -> Column:
    """Any value; null is "null", and null fields stay."""
    text = F.to_json(F.array(v.col), {"ignoreNullFields": "false", "timestampFormat": RFC3339})
    return F.substring(text, F.lit(2), F.char_length(text) - 2)


@add(1)
def parse_json(s: Arg) -> Column:
    """A variant; what isn't JSON is an error, and JSON null is null."""
    return F.when(F.trim(s.col) != "null", F.parse_json(s.col))


#: Names of cast targets.
TARGETS = {"bigint": "long", "float": "double", "string": "string", "boolean": "boolean", "timestamp": "timestamp"}


@add(2)
def cast(v: Arg, target: Arg) -> Column:
    """To bigint, float, string, boolean or timestamp."""
    name = str(target.value("the type")).lower()
    if name not in TARGETS:
        raise FunctionError(f"unknown type {target.literal}")
    text = isinstance(v.type, T.StringType)
    if name == "boolean" and text:
        low = F.lower(v.col)
        return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False).when(v.col.isNotNull(), F.raise_error(F.lit("not a boolean")).cast("boolean"))
    if name == "string" and isinstance(v.type, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(v.col, RFC3339)
    if name == "timestamp" and text:
        shaped = v.col.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$")
        return F.when(shaped, v.col.cast("timestamp")).when(v.col.isNotNull(), F.raise_error(F.lit("not an RFC 3339 time")).cast("timestamp"))
    return v.col.cast(TARGETS[name])


@add(2)
def delay(ms: Arg, v: Arg) -> Column:
    """The value; waiting has no place in a plan, but a negative time is an error all the same."""
    return F.when(ms.col < 0, F.raise_error(F.lit("a negative delay"))).otherwise(v.col)
