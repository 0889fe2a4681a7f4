"""Names of types as Arrow prints them, and what the column profile does with a type."""

from __future__ import annotations

from pyspark.sql import types as T

_NAMES = {
    T.NullType: "null",
    T.ByteType: "int8",
    T.ShortType: "int16",
    T.IntegerType: "int32",
    T.LongType: "int64",
    T.FloatType: "float",
    T.DoubleType: "double",
    T.StringType: "string",
    T.BooleanType: "bool",
    T.BinaryType: "binary",
    T.DateType: "date32[day]",
    T.TimestampNTZType: "timestamp[us]",
    T.TimestampType: "timestamp[us, tz=UTC]",
    T.DayTimeIntervalType: "duration[us]",
}


def arrow_name(kind: T.DataType) -> str:
    """The Arrow name of a Spark type, such as ``int64`` or ``list<element: float>``."""
    if isinstance(kind, T.DecimalType):
        return f"decimal128({kind.precision}, {kind.scale})"
    if isinstance(kind, T.ArrayType):
        return f"list<element: {arrow_name(kind.elementType)}>"
    if isinstance(kind, T.StructType):
        return f"struct<{', '.join(f'{f.name}: {arrow_name(f.dataType)}' for f in kind)}>"
    if isinstance(kind, T.MapType):
        return f"map<{arrow_name(kind.keyType)}, {arrow_name(kind.valueType)}>"
    return next((name for known, name in _NAMES.items() if type(kind) is known), kind.simpleString())


def leaves(kind: T.DataType) -> int:
    """Physical columns: the leaves of a nested type."""
    if isinstance(kind, T.StructType):
        return sum(leaves(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return leaves(kind.elementType)
    if isinstance(kind, T.MapType):
        return leaves(kind.keyType) + leaves(kind.valueType)
    return 1


def is_numeric(kind: T.DataType) -> bool:
    """Profiled by min, max and mean."""
    return isinstance(kind, T.NumericType)


def is_categorical(kind: T.DataType) -> bool:
    """Profiled by cardinality and top values; timestamps, binary and nested types are neither."""
    return isinstance(kind, (T.StringType, T.BooleanType, T.DateType)) or type(kind).__name__ == "TimeType"
