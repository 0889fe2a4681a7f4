"""Keyed comparison of two tables: one full outer join classifies every key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import checks
from tessera.functions.types import arrow_name
from tessera.operators.preview import quoted


def _family(kind: T.DataType) -> str:
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return "number"
    return type(kind).__name__


def _at(side: str, name: str) -> Column:
    return F.col(f"`{side}`.`{name.replace('`', '``')}`")


class Diff:
    """``left`` against ``right`` by ``keys``, over ``columns`` (all shared ones that are no keys, if not given).

    Keys and values compare null-safely. Numbers compare across their types and with booleans as 0 and 1; values of
    different kinds (text and number, date and timestamp) are never equal. NaN equals NaN unless ``nan_differs``.
    """

    def __init__(self, left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, types: tuple[dict, dict] | None = None, nan_differs: bool = False):
        self.left, self.right, self.nan_differs = left, right, nan_differs
        self.keys = checks.columns(keys, left.columns)
        checks.columns(keys, right.columns)
        if columns is None:
            columns = [c for c in left.columns if c in right.columns and c not in self.keys]
        else:
            columns = checks.columns(columns, left.columns)
            checks.columns(columns, right.columns)
        self.columns = list(columns)
        self.types = types or tuple({f.name: arrow_name(f.dataType) for f in df.schema} for df in (left, right))

    # -- schema

    def schema_only_left(self) -> list[str]:
        return [c for c in self.left.columns if c not in self.right.columns]

    def schema_only_right(self) -> list[str]:
        return [c for c in self.right.columns if c not in self.left.columns]

    def schema_type_mismatches(self) -> list[tuple[str, str, str]]:
        a, b = self.types
        return [(c, a[c], b[c]) for c in self.left.columns if c in b and a[c] != b[c]]

    def schema_frame(self) -> DataFrame:
        """``section, column, left_type, right_type`` of everything that differs."""
        a, b = self.types
        rows = [("schema_only_left", c, a[c], None) for c in self.schema_only_left()]
        rows += [("schema_only_right", c, None, b[c]) for c in self.schema_only_right()]
        rows += [("schema_type_mismatches", *x) for x in self.schema_type_mismatches()]
        return self.left.sparkSession.createDataFrame(rows, "section string, column string, left_type string, right_type string")

    # -- rows

    def duplicates(self, side: str) -> DataFrame:
        """Keys of one side that stand more than once, and how often."""
        df = {"left": self.left, "right": self.right}[side]
        return df.groupBy(*quoted(self.keys)).agg(F.count(F.lit(1)).alias("count")).where("count > 1")

    def check_keys(self) -> None:
        for side in ("left", "right"):
            if row := self.duplicates(side).orderBy(*quoted(self.keys)).head():
                key = tuple(row[k] for k in self.keys)
                raise ValueError(f"Duplicate key found in {side} input: {key if len(key) > 1 else key[0]}")

    def _comparable(self, side: str, name: str) -> Column:
        kinds = [df.schema[name].dataType for df in (self.left, self.right)]
        value = _at(side, name)
        own = kinds[side == "right"]
        if kinds[0] == kinds[1]:
            return value
        if {_family(k) for k in kinds} == {"number"}:
            return value.cast("int") if isinstance(own, T.BooleanType) else value
        return F.concat(F.lit(f"{_family(own)}:"), value.cast("string"))

    def _differ(self) -> Column:
        out = F.lit(False)
        for c in self.columns:
            a, b = self._comparable("left", c), self._comparable("right", c)
            out = out | ~a.eqNullSafe(b)
            if self.nan_differs and isinstance(self.left.schema[c].dataType, (T.DoubleType, T.FloatType)) and isinstance(self.right.schema[c].dataType, (T.DoubleType, T.FloatType)):
                out = out | F.coalesce(F.isnan(a) & F.isnan(b), F.lit(False))
        return out

    def rows(self) -> DataFrame:
        """``key, left, right, state`` of every key: structs, and only_left, only_right, changed or same.

        Only keys and compared columns are read and shuffled.
        """
        names = list(dict.fromkeys([*self.keys, *self.columns]))
        there = "__there"
        sides = [df.select(quoted(names)).withColumn(there, F.lit(True)).alias(side) for side, df in (("left", self.left), ("right", self.right))]
        on = F.lit(True)
        for k in self.keys:
            on = on & self._comparable("left", k).eqNullSafe(self._comparable("right", k))
        joined = sides[0].join(sides[1], on, "full_outer")
        in_left, in_right = F.col(f"left.{there}").isNotNull(), F.col(f"right.{there}").isNotNull()
        state = F.when(~in_right, "only_left").when(~in_left, "only_right").when(self._differ(), "changed").otherwise("same")

        def key(name: str) -> Column:
            same = self.left.schema[name].dataType == self.right.schema[name].dataType or {_family(df.schema[name].dataType) for df in (self.left, self.right)} == {"number"}
            a, b = _at("left", name), _at("right", name)
            if not same:
                a, b = a.cast("string"), b.cast("string")
            return F.when(in_left, a).otherwise(b).alias(name)

        def values(side: str) -> Column:
            return F.struct(*[_at(side, c).alias(c) for c in self.columns]) if self.columns else F.lit(None).cast("struct<>")

        return joined.select(F.struct(*[key(k) for k in self.keys]).alias("key"), values("left").alias("left"), values("right").alias("right"), state.alias("state"))

    def summary(self) -> DataFrame:
        """One row: ``row_count_delta, only_left_count, only_right_count, changed_count``; for unique keys (:meth:`check_keys`)."""
        return self._counted(self.rows())

    @staticmethod
    def _counted(rows: DataFrame) -> DataFrame:
        counted = [F.count_if(F.col("state") == s).alias(f"{s}_count") for s in ("only_left", "only_right", "changed")]
        found = rows.agg(*counted)
        # With unique keys the delta of rows is that of keys.
        return found.select((F.col("only_left_count") - F.col("only_right_count")).alias("row_count_delta"), "only_left_count", "only_right_count", "changed_count")

    def only(self, side: str, limit: int = 20) -> DataFrame:
        """Keys of one side alone, the smallest ``limit``: an anti join."""
        other = {"left": "right", "right": "left"}[side]
        frames = {"left": self.left, "right": self.right}
        a, b = (frames[s].select(quoted(self.keys)).alias(s) for s in (side, other))
        on = F.lit(True)
        for k in self.keys:
            on = on & self._comparable("left", k).eqNullSafe(self._comparable("right", k))
        return a.join(b, on, "left_anti").orderBy(*quoted(self.keys)).limit(limit)

    def changed(self, limit: int = 20) -> DataFrame:
        """``key, left, right`` of the smallest ``limit`` changed keys."""
        return self.rows().where(F.col("state") == "changed").orderBy("key").limit(limit).select("key", "left", "right")

    def result(self, limit: int = 20, summary_only: bool = False) -> dict:
        """Counters and samples as plain values; repeated keys raise."""
        if limit < 0:
            raise ValueError("limit must be non-negative")
        self.check_keys()
        sections = ["schema_only_left", "schema_only_right", "schema_type_mismatches", "only_left", "only_right", "changed_rows"]
        if summary_only:
            return self.summary().first().asDict() | {s: [] for s in sections}
        # One join serves the counters and the samples; only what differs is kept, and what an executor loses is joined again.
        rows = self.rows().where(F.col("state") != "same").persist(StorageLevel.DISK_ONLY)

        def bare(row) -> object:
            values = tuple(row[k] for k in self.keys)
            return values if len(values) > 1 else values[0]

        def sample(state: str) -> list:
            return rows.where(F.col("state") == state).orderBy("key").limit(limit).collect()

        try:
            out: dict = self._counted(rows).first().asDict()
            only = [[{"key": bare(r["key"])} for r in sample(f"only_{side}")] for side in ("left", "right")]
            changed = [{"key": bare(r["key"]), "left": r["left"].asDict() if r["left"] else {}, "right": r["right"].asDict() if r["right"] else {}} for r in sample("changed")]
        finally:
            rows.unpersist()
        found = [
            [{"column": c} for c in self.schema_only_left()[:limit]],
            [{"column": c} for c in self.schema_only_right()[:limit]],
            [{"column": c, "left_type": a, "right_type": b} for c, a, b in self.schema_type_mismatches()[:limit]],
            *only,
            changed,
        ]
        return out | dict(zip(sections, found, strict=True))
