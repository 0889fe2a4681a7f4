"""Contiguous ranges of rows: which chunk a row number falls into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import checks


def chunk(ordinal: Column, total: int | None, file_count: int | None = None, record_count: int | None = None) -> Column:
    """The chunk, from 0, of a row number from 0; ``total`` is needed for ``file_count`` alone."""
    if record_count is not None and file_count is None:
        if record_count <= 0:
            raise ValueError("record_count must be positive")
        return F.floor(ordinal / record_count).cast("int")
    checks.files_needed(total, file_count=file_count, record_count=record_count)
    least, extra = divmod(total, file_count)
    border = extra * (least + 1)
    return F.when(ordinal < border, F.floor(ordinal / (least + 1))).otherwise(extra + F.floor((ordinal - border) / least)).cast("int")


def assigned(df: DataFrame, ordinal: str, total: int | None, file_count: int | None = None, record_count: int | None = None, name: str = "chunk") -> DataFrame:
    """Add each row's chunk; no shuffle."""
    return df.withColumn(name, chunk(F.col(ordinal), total, file_count, record_count))
