"""Column profile: counts, extremes and means in one aggregate, value counts in one grouping of all columns together."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.functions import checks
from tessera.functions.types import arrow_name, is_categorical, is_numeric

#: Distinct values beyond which the cardinality is only said to be larger.
CARDINALITY_CAP = 10_000
#: Characters beyond which a value is counted by its digest; only the top values' texts are looked up again.
LONG_TEXT = 64


def _chosen(df: DataFrame, columns: Sequence[str] | None, limit: int, without: Sequence[str] = ()) -> list[T.StructField]:
    if limit < 0:
        raise ValueError("limit must be non-negative")
    names = checks.columns(columns, [c for c in df.columns if c not in without])
    return [df.schema[n] for n in names][:limit]


def _at(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def rendered(field: T.StructField) -> Column:
    """A value as text: booleans capitalised, null the same as an empty text."""
    text = _at(field.name).cast("string")
    if isinstance(field.dataType, T.BooleanType):
        text = F.initcap(text)
    return F.coalesce(text, F.lit(""))


def scalars(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """``ordinal, name, type, count, null_count, min, max, mean``, one row for each field, from one pass.

    NaN is no extreme unless all values are NaN, but it makes the mean NaN. Whole numbers are summed as decimals, so no sum
    overflows.
    """
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        c = _at(f.name)
        aggregates.append(F.count(c).alias(f"count{i}"))
        if is_numeric(f.dataType):
            real = isinstance(f.dataType, (T.DoubleType, T.FloatType))
            finite = F.when(~F.isnan(c), c) if real else c
            total = F.sum(c) if real else F.sum(c.cast("decimal(38,10)" if isinstance(f.dataType, T.DecimalType) else "decimal(38,0)"))
            aggregates += [
                F.coalesce(F.min(finite), F.min(c)).cast("double").alias(f"min{i}"),
                F.coalesce(F.max(finite), F.max(c)).cast("double").alias(f"max{i}"),
                F.coalesce(F.min(finite), F.min(c)).cast("string").alias(f"min_text{i}"),
                F.coalesce(F.max(finite), F.max(c)).cast("string").alias(f"max_text{i}"),
                total.cast("double").alias(f"sum{i}"),
            ]
    rows = []
    for i, f in enumerate(fields):
        number = is_numeric(f.dataType)
        count = F.col(f"count{i}")
        rows.append(
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(f.name).alias("name"),
                F.lit(arrow_name(f.dataType)).alias("type"),
                count.alias("count"),
                (F.col("rows") - count).alias("null_count"),
                (F.col(f"min{i}") if number else F.lit(None).cast("double")).alias("min"),
                (F.col(f"max{i}") if number else F.lit(None).cast("double")).alias("max"),
                (F.when(count > 0, F.col(f"sum{i}") / count) if number else F.lit(None).cast("double")).alias("mean"),
                (F.col(f"min_text{i}") if number else F.lit(None).cast("string")).alias("min_text"),
                (F.col(f"max_text{i}") if number else F.lit(None).cast("string")).alias("max_text"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def value_counts(df: DataFrame, fields: Sequence[T.StructField], order: str | None = None) -> DataFrame:
    """``ordinal, name, value, digest, count, first`` of each distinct text of the fields; ``first`` is its smallest ``order``.

    A long text has no ``value`` but a ``digest``, so that no long text is a key of the shuffle; see :func:`spelled`.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("ordinal"), *_keys(rendered(f))) for i, f in enumerate(fields)])
    number = _at(order) if order else F.lit(None).cast("long")
    long = df.select(number.alias("__n"), F.explode(pairs).alias("__p")).select("__n", "__p.*")
    counted = long.groupBy("ordinal", "value", "digest").agg(F.count(F.lit(1)).alias("count"), F.min("__n").alias("first"))
    names = F.array(*[F.lit(f.name) for f in fields])
    return counted.select("ordinal", F.get(names, F.col("ordinal")).alias("name"), "value", "digest", "count", "first")


def _keys(text: Column) -> list[Column]:
    short = F.length(text) <= LONG_TEXT
    return [F.when(short, text).alias("value"), F.when(~short, F.sha2(text, 256)).alias("digest")]


def spelled(few: DataFrame, df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """``few`` value counts with the texts of those that only have a digest; ``df`` is scanned again if there are any."""
    texts = [f for f in enumerate(fields) if isinstance(f[1].dataType, T.StringType)]
    if not texts:
        return few.drop("digest")
    wanted = few.where("digest is not null").select("ordinal", "digest")
    each = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("ordinal"), rendered(f).alias("text")) for i, f in texts])).alias("p")).select("p.*")
    long = each.where(F.length("text") > LONG_TEXT).withColumn("digest", F.sha2("text", 256)).join(F.broadcast(wanted), ["ordinal", "digest"])
    long = long.groupBy("ordinal", "digest").agg(F.any_value("text").alias("text"))
    return few.join(F.broadcast(long), ["ordinal", "digest"], "left").withColumn("value", F.coalesce("value", "text")).drop("digest", "text")


def top(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent values of each column, ``rank`` from 1: ties by first appearance where known, then by value (long ones last, by digest).

    Each hash part of a column gives its n best first, so that no task sees all values of a column.
    """
    order = [F.col("count").desc(), F.col("first").asc_nulls_last(), F.col("value").asc_nulls_last(), F.col("digest")]
    part = counts.withColumn("__part", F.pmod(F.xxhash64("value", "digest"), F.lit(64)))
    few = part.withColumn("__r", F.row_number().over(Window.partitionBy("ordinal", "__part").orderBy(*order))).where(F.col("__r") <= n)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("ordinal").orderBy(*order))).where(F.col("rank") <= n).drop("__part", "__r")


def stats_numeric(df: DataFrame, columns: Sequence[str] | None = None, limit: int = 50) -> DataFrame:
    """``name, count, null_count, min, max, mean`` of the numeric columns."""
    fields = [f for f in _chosen(df, columns, limit) if is_numeric(f.dataType)]
    return scalars(df, fields).select("name", "count", "null_count", "min", "max", "mean")


def stats_categorical(df: DataFrame, columns: Sequence[str] | None = None, limit: int = 50) -> DataFrame:
    """``name, count, null_count, cardinality`` of the text, boolean and date columns; null counts as an empty text."""
    fields = [f for f in _chosen(df, columns, limit) if is_categorical(f.dataType)]
    distinct = value_counts(df, fields).groupBy("ordinal").agg(F.count(F.lit(1)).alias("cardinality")) if fields else None
    base = scalars(df, fields).select("ordinal", "name", "count", "null_count")
    return base.join(distinct, "ordinal", "left").select("name", "count", "null_count", F.coalesce("cardinality", F.lit(0)).alias("cardinality"))


def stats_top_values(df: DataFrame, columns: Sequence[str] | None = None, top_n: int = 5, order: str | None = None) -> DataFrame:
    """``name, value, count, rank``."""
    fields = [f for f in _chosen(df, columns, len(df.columns), [order] if order else []) if is_categorical(f.dataType)]
    return spelled(top(value_counts(df, fields, order), top_n), df, fields).select("name", "value", "count", "rank")


def stats(df: DataFrame, columns: Sequence[str] | None = None, limit: int = 50, top_n: int = 5, order: str | None = None) -> DataFrame:
    """The whole profile, one row for each column in order: ``name, type, count, null_count, min, max, mean, cardinality, top_values``.

    ``min``, ``max`` and ``cardinality`` are texts, as their kinds differ; a cardinality over 10000 is ``>10000``.
    """
    fields = _chosen(df, columns, limit, [order] if order else [])
    base = scalars(df, fields) if fields else df.sparkSession.createDataFrame([], "ordinal int, name string, type string, count long, null_count long, min double, max double, mean double, min_text string, max_text string")
    kinds = [f for f in fields if is_categorical(f.dataType)]
    if kinds:
        counts = value_counts(df, kinds, order)
        cardinality = counts.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
        lists = spelled(top(counts, top_n), df, kinds).groupBy("name").agg(F.sort_array(F.collect_list(F.struct("rank", "value", "count"))).alias("t"))
        both = cardinality.join(lists, "name")
    else:
        both = df.sparkSession.createDataFrame([], "name string, n long, t array<struct<rank:int,value:string,count:long>>")
    said = F.when(F.col("n") > CARDINALITY_CAP, F.lit(f">{CARDINALITY_CAP}")).otherwise(F.col("n").cast("string"))
    values = F.transform("t", lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count")))
    # An empty table has no value at all, and so a cardinality of 0.
    empty = F.col("name").isin([f.name for f in kinds]) & F.col("n").isNull() if kinds else F.lit(False)
    found = base.join(F.broadcast(both), "name", "left").orderBy("ordinal")
    return found.select("name", "type", "count", "null_count", F.col("min_text").alias("min"), F.col("max_text").alias("max"), "mean", F.when(empty, "0").otherwise(said).alias("cardinality"), values.alias("top_values"))


def count_tables(frames: dict[str, DataFrame]) -> DataFrame:
    """``name, rows`` of each frame."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)
