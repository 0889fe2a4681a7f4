"""First and last rows, in the order of the rows' numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import checks


def quoted(names: Sequence[str]) -> list:
    return [F.col(f"`{n.replace('`', '``')}`") for n in names]


def head(df: DataFrame, n: int = 5, columns: Sequence[str] | None = None, order: str | None = None) -> DataFrame:
    """The first n rows; with ``order``, by that column, which is not returned unless asked for."""
    checks.rows(n)
    names = checks.columns(columns, [c for c in df.columns if c != order])
    if order is not None:
        df = df.orderBy(order)
    return df.limit(n).select(quoted(names))


def tail(df: DataFrame, n: int, columns: Sequence[str] | None, order: str) -> DataFrame:
    """The last n rows by ``order``, in that order: two top-n steps, no sort of all rows."""
    checks.rows(n)
    names = checks.columns(columns, [c for c in df.columns if c != order])
    return df.orderBy(F.col(order).desc()).limit(n).orderBy(order).select(quoted(names))
