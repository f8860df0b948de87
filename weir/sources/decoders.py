"""Payload decoders, over a binary or string column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lenient(kind: T.DataType) -> T.DataType:
    """Scalars as strings, so that one value of another type doesn't spoil a record."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _lenient(f.dataType)) for f in kind.fields])
    return T.ArrayType(_lenient(kind.elementType)) if isinstance(kind, T.ArrayType) else T.StringType()


def _typed(x: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.struct(*[_typed(x[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda e: _typed(e, kind.elementType))
    if isinstance(kind, T.BinaryType):
        return F.try_to_binary(x, F.lit("base64"))
    return x if isinstance(kind, T.StringType) else x.try_cast(kind)


def decode_json(df: DataFrame, payload: str, schema: T.StructType) -> DataFrame:
    """A row for each object of an object or array payload: missing keys and values of another type are null, others ignored."""
    text = F.col(payload).cast("string")
    root = F.from_json(F.when(F.ltrim(text).startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), T.ArrayType(_lenient(schema)))
    rows = df.withColumn("__row", F.explode(F.filter(root, lambda x: x.isNotNull())))
    return rows.select(*[c for c in df.columns if c != payload], *[_typed(F.col("__row")[f.name], f.dataType).alias(f.name) for f in schema.fields])


def pass_rows(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows as they are, in the order and types of the schema; missing columns are null."""
    hidden = [c for c in df.columns if c.startswith("__")]
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields], *hidden)


DECODERS = {"json": decode_json}


def register_decoder(name: str, decode) -> None:
    """Adds ``decode(df, payload, schema)``; a taken name is refused."""
    if name in DECODERS:
        raise ValueError(f"a decoder {name} exists already")
    DECODERS[name] = decode


def signal_decoder(messages: dict[int, list[tuple[str, int, int, float, float, bool]]], id_col: str = "can_id"):
    """A decoder of fixed bit fields, as automotive frames have: for each message id, (signal, first bit, bits, scale, offset, signed).

    Bits count from the least one of a little-endian frame of up to 8 bytes; values are
    ``scale * raw + offset`` as doubles. Everything stays in built-in expressions.
    """

    def decode(df: DataFrame, payload: str, schema: T.StructType) -> DataFrame:
        swapped = F.reverse(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.coalesce(F.nullif(F.hex(F.substring(F.col(payload), i, F.lit(1))), F.lit("")), F.lit("00"))))
        raw = F.conv(F.array_join(swapped, ""), 16, -10).cast("long")
        found: dict[str, Column] = {}
        for number, signals in messages.items():
            for name, first, bits, scale, offset, signed in signals:
                value = F.shiftrightunsigned(raw, first) if first else raw
                value = value.bitwiseAND(F.lit((1 << bits) - 1)) if bits < 64 else value
                if signed and bits < 64:
                    value = F.when(value >= (1 << bits - 1), value - (1 << bits)).otherwise(value)
                found[name] = F.when(F.col(id_col) == number, value * F.lit(float(scale)) + F.lit(float(offset))).otherwise(found.get(name, F.lit(None).cast("double")))
        return df.select(*[c for c in df.columns if c != payload], *[found.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in df.columns])

    return decode
