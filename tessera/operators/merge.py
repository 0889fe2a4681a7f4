"""UNION ALL of tables whose schemas agree; only a column of nulls alone may take another's type."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.types import arrow_name


def unified(schemas: Sequence[T.StructType]) -> T.StructType:
    """The common schema, or ValueError. Names and their order must be the same; types, too, but for null."""
    first = schemas[0]
    kinds = [f.dataType for f in first]
    for n, schema in enumerate(schemas[1:], 2):
        if schema.names != first.names:
            raise ValueError(f"Incompatible schemas: input {n} has columns {schema.names}, not {first.names}")
        for i, f in enumerate(schema):
            if isinstance(kinds[i], T.NullType):
                kinds[i] = f.dataType
            elif not isinstance(f.dataType, T.NullType) and f.dataType.jsonValue() != kinds[i].jsonValue():
                raise ValueError(f"Incompatible schemas: column {f.name} is {arrow_name(kinds[i])} and {arrow_name(f.dataType)}")
    return T.StructType([T.StructField(f.name, k, True) for f, k in zip(first, kinds, strict=True)])


def merge(frames: Sequence[DataFrame], source: str | None = None) -> DataFrame:
    """All rows of all frames; ``source`` names a column that gets each frame's place from 0, for the order of the output."""
    if not frames:
        raise ValueError("At least one input file must be provided")
    schema = unified([df.schema for df in frames])
    parts = []
    for i, df in enumerate(frames):
        part = df.select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
        parts.append(part.withColumn(source, F.lit(i)) if source else part)
    return reduce(DataFrame.unionAll, parts)
