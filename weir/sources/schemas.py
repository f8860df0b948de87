"""Stream schemas: JSON declarations as Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

#: Names of scalar types. There are no unsigned integers in Spark, so each takes the next wider type.
SCALARS = {
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(), "float64": T.DoubleType(), "bool": T.BooleanType(), "boolean": T.BooleanType(), "string": T.StringType(), "bytes": T.BinaryType(), "timestamp": T.TimestampType(), "null": T.NullType(),
}


def data_type(column: dict) -> T.DataType:
    """{"data_type": ..., "element": ..., "fields": ...} as a type; names in any case."""
    name = column["data_type"].lower()
    if name == "list":
        return T.ArrayType(data_type(column["element"]))
    if name == "struct":
        return T.StructType([T.StructField(f["name"], data_type(f)) for f in column["fields"]])
    if name not in SCALARS:
        raise ValueError(f"unknown type {column['data_type']}")
    return SCALARS[name]


def stream_schema(declared: dict) -> T.StructType:
    """{"columns": [...]} as a schema in which everything may be null."""
    return T.StructType([T.StructField(c["name"], data_type(c)) for c in declared["columns"]])


def pruned(schema: T.StructType, used: set[str]) -> T.StructType:
    """The columns that are read, for decoders, as Catalyst doesn't prune what it can't see into."""
    return T.StructType([f for f in schema.fields if f.name in used])
