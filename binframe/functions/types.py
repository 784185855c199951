"""Column types of projections: their Spark types and the casts that give a value exactly that type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unsigned numbers take the next wider signed type.
SPARK: dict[str, T.DataType] = {
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "int64": T.LongType(), "uint64": T.DecimalType(20, 0),
    "bool": T.BooleanType(), "utf8": T.StringType(), "timestamp_us": T.TimestampNTZType(), "binary": T.BinaryType(), "src_ranges": T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])),
}
_BITS = {"int8": 8, "int16": 16, "int32": 32, "uint8": 8, "uint16": 16, "uint32": 32}


def wrap(value: Column, bits: int, signed: bool) -> Column:
    """A number modulo 2**bits, fractions cut off; never an error."""
    low = value.cast("long").bitwiseAND(F.lit((1 << bits) - 1))
    return low.bitwiseXOR(F.lit(1 << bits - 1)) - F.lit(1 << bits - 1) if signed else low


def cast(value: Column, name: str) -> Column:
    """A value as a projection type."""
    if name in _BITS:
        return wrap(value, _BITS[name], name[0] == "i").cast(SPARK[name])
    if name == "timestamp_us":
        return F.timestamp_micros(value.cast("long")).cast("timestamp_ntz")
    if name not in SPARK:
        raise ValueError(f"unknown type {name}")
    return value.cast(SPARK[name])
