"""Queries of the operators over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.api import Dataset
from tessera.operators import preview, profile, split
from tessera.operators.diff import Diff
from tessera.operators.merge import merge
from tessera.plans.ordinals import ORDINAL
from tessera.sources import footers

Query = Callable[[SparkSession, str], DataFrame]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> Dataset:
    return Dataset(spark, f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- counts, schema, metadata


@query("SELECT count(*) AS rows FROM lineitem")
def count_lineitem(spark, sf_dir):
    return frame(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("rows"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in TABLES))
def count_all_tables(spark, sf_dir):
    return profile.count_tables({t: frame(spark, sf_dir, t) for t in TABLES})


_ORDERS = [("o_orderkey", "int64"), ("o_custkey", "int64"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp[us]"), ("o_orderpriority", "string")]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', '{t}', true)" for i, (n, t) in enumerate(_ORDERS)) + ") AS t(ordinal, name, type, nullable)")
def schema_orders(spark, sf_dir):
    rows = [(i, f["name"], f["type"], f["nullable"]) for i, f in enumerate(table(spark, sf_dir, "orders").schema_info())]
    return spark.createDataFrame(rows, "ordinal int, name string, type string, nullable boolean")


@query()
def meta_row_groups(spark, sf_dir):
    return footers.row_groups(spark, f"{sf_dir}/lineitem.parquet")


@query("SELECT 'num_columns' AS key, CAST(count(*) AS VARCHAR) AS value FROM information_schema.columns WHERE table_name = 'orders' UNION ALL SELECT 'num_rows', CAST(count(*) AS VARCHAR) FROM orders")
def meta_orders_counts(spark, sf_dir):
    found = table(spark, sf_dir, "orders").metadata()
    return spark.createDataFrame([(k, str(found[k])) for k in ("num_columns", "num_rows")], "key string, value string")


@query("SELECT CAST(sum(n) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM lineitem)")
def meta_row_group_rows(spark, sf_dir):
    return footers.row_groups(spark, f"{sf_dir}/lineitem.parquet").agg(F.sum("rows").alias("rows"))


@query()
def meta_orders(spark, sf_dir):
    found = {k: str(v) for k, v in table(spark, sf_dir, "orders").metadata().items()}
    return spark.createDataFrame(list(found.items()), "key string, value string")


# -- previews


@query("SELECT * FROM orders LIMIT 5")
def head_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").head(5)


@query("SELECT o_totalprice, o_orderkey FROM orders LIMIT 7")
def head_columns(spark, sf_dir):
    return table(spark, sf_dir, "orders").head(7, ["o_totalprice", "o_orderkey"])


@query("SELECT * FROM orders LIMIT 0")
def head_zero(spark, sf_dir):
    return table(spark, sf_dir, "orders").head(0)


@query("SELECT * FROM nation LIMIT 1000")
def head_beyond(spark, sf_dir):
    return table(spark, sf_dir, "nation").head(1000)


@query("SELECT * FROM orders LIMIT 5 OFFSET (SELECT count(*) - 5 FROM orders)")
def tail_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").tail(5)


@query("SELECT value, event_id FROM events LIMIT 9 OFFSET (SELECT count(*) - 9 FROM events)")
def tail_columns(spark, sf_dir):
    return table(spark, sf_dir, "events").tail(9, ["value", "event_id"])


@query("SELECT c_mktsegment, c_custkey FROM customer")
def project_reorder(spark, sf_dir):
    return table(spark, sf_dir, "customer").read_columns(["c_mktsegment", "c_custkey"])


# -- profile


def _numeric_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS name, count({c}) AS count, count(*) - count({c}) AS null_count, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(CAST(avg({c}) AS DOUBLE), 6) AS mean FROM {source}" for c in columns
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("mean", F.round("mean", 6))


@query(_numeric_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"]))
def stats_numeric_customer(spark, sf_dir):
    return _rounded(profile.stats_numeric(frame(spark, sf_dir, "customer")))


@query(_numeric_sql("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def stats_numeric_lineitem(spark, sf_dir):
    return _rounded(profile.stats_numeric(frame(spark, sf_dir, "lineitem")))


@query(_numeric_sql("(SELECT nullif(c_nationkey, 3) AS c_nationkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer)", ["c_nationkey", "c_acctbal"]))
def stats_nulls(spark, sf_dir):
    df = frame(spark, sf_dir, "customer")
    return _rounded(profile.stats_numeric(df.select(F.nullif("c_nationkey", F.lit(3)).alias("c_nationkey"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"))))


@query(
    "SELECT 'n' AS name, CAST(0 AS BIGINT) AS count, count(*) AS null_count, CAST(NULL AS VARCHAR) AS min, CAST(NULL AS VARCHAR) AS max, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS VARCHAR) AS cardinality FROM region"
    " UNION ALL SELECT 's', 0, count(*), NULL, NULL, NULL, '1' FROM region"
)
def stats_all_null(spark, sf_dir):
    df = frame(spark, sf_dir, "region").select(F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("s"))
    return profile.stats(df).drop("type", "top_values")


def _categorical_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS count, count(*) - count({c}) AS null_count, count(DISTINCT coalesce(CAST({c} AS VARCHAR), '')) AS cardinality FROM {source}" for c in columns)


@query(_categorical_sql("orders", ["o_orderstatus", "o_orderpriority"]))
def stats_categorical_orders(spark, sf_dir):
    return profile.stats_categorical(frame(spark, sf_dir, "orders"))


@query(_categorical_sql("(SELECT CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'P' THEN '' ELSE o_orderstatus END AS s FROM orders)", ["s"]))
def stats_null_bucket(spark, sf_dir):
    status = F.col("o_orderstatus")
    df = frame(spark, sf_dir, "orders").select(F.when(status == "F", None).when(status == "P", "").otherwise(status).alias("s"))
    return profile.stats_categorical(df)


def _top_sql(source: str, column: str, text: str, n: int, tie: str) -> str:
    return (
        f"SELECT '{column}' AS name, value, count, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY count DESC, {tie}) AS rank FROM "
        f"(SELECT {text} AS value, count(*) AS count, min(rn) AS first FROM (SELECT *, row_number() OVER () AS rn FROM {source}) GROUP BY 1)) WHERE rank <= {n}"
    )


@query(_top_sql("orders", "o_orderpriority", "o_orderpriority", 3, "value"))
def stats_top_values(spark, sf_dir):
    return profile.stats_top_values(frame(spark, sf_dir, "orders"), ["o_orderpriority"], 3)


@query(_top_sql("events", "event_type", "event_type", 4, "first"))
def stats_top_first_seen(spark, sf_dir):
    return profile.stats_top_values(table(spark, sf_dir, "events").numbered(), ["event_type"], 4, ORDINAL)


@query(_top_sql("(SELECT o_totalprice > 150000 AS b FROM orders)", "b", "CASE WHEN b THEN 'True' ELSE 'False' END", 5, "value"))
def stats_bool_rendering(spark, sf_dir):
    return profile.stats_top_values(frame(spark, sf_dir, "orders").select((F.col("o_totalprice") > 150000).alias("b")))


@query(_top_sql("(SELECT CAST(o_orderdate AS DATE) AS d FROM orders)", "d", "strftime(d, '%Y-%m-%d')", 5, "value"))
def stats_date_values(spark, sf_dir):
    return profile.stats_top_values(frame(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")))


@query("SELECT 'ts' AS name, 'timestamp[us]' AS type, count(ts) AS count, count(*) - count(ts) AS null_count, CAST(NULL AS VARCHAR) AS min, CAST(NULL AS VARCHAR) AS cardinality FROM events")
def stats_timestamp_excluded(spark, sf_dir):
    return profile.stats(frame(spark, sf_dir, "events"), ["ts"]).select("name", "type", "count", "null_count", "min", "cardinality")


@query("SELECT 'l_orderkey' AS name, count(*) AS count FROM lineitem UNION ALL SELECT 'l_partkey', count(*) FROM lineitem UNION ALL SELECT 'l_suppkey', count(*) FROM lineitem")
def stats_limit_columns(spark, sf_dir):
    return profile.stats(frame(spark, sf_dir, "lineitem"), limit=3).select("name", "count")


@query("SELECT 'k' AS name, CASE WHEN count(DISTINCT o_orderkey) > 10000 THEN '>10000' ELSE CAST(count(DISTINCT o_orderkey) AS VARCHAR) END AS cardinality FROM orders")
def stats_cardinality_cap(spark, sf_dir):
    return profile.stats(frame(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("k"))).select("name", "cardinality")


_TOP = (
    "(SELECT '[' || string_agg('{\"value\":\"' || v || '\",\"count\":' || n || '}', ',' ORDER BY n DESC, first) || ']' FROM "
    "(SELECT {0} AS v, count(*) AS n, min(rn) AS first FROM (SELECT {0}, row_number() OVER () AS rn FROM lineitem) GROUP BY 1 ORDER BY n DESC, first LIMIT 5))"
)


def _stats_sql() -> str:
    """One branch for each column of lineitem: numbers, texts, and the rest."""
    parts = []
    for name, kind in [("l_orderkey", "int64"), ("l_partkey", "int64"), ("l_suppkey", "int64"), ("l_linenumber", "int32"), *[(c, "double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]]:
        parts.append(f"SELECT '{name}' AS name, '{kind}' AS type, count({name}) AS count, count(*) - count({name}) AS null_count, CAST(min({name}) AS VARCHAR) AS min, CAST(max({name}) AS VARCHAR) AS max, round(CAST(avg({name}) AS DOUBLE), 6) AS mean, CAST(NULL AS VARCHAR) AS cardinality, CAST(NULL AS VARCHAR) AS top_values FROM lineitem")
    for name in ("l_returnflag", "l_linestatus"):
        parts.append(f"SELECT '{name}', 'string', count({name}), count(*) - count({name}), NULL, NULL, NULL, CAST(count(DISTINCT {name}) AS VARCHAR), {_TOP.replace('{0}', name)} FROM lineitem")
    parts.append("SELECT 'l_shipdate', 'timestamp[us]', count(l_shipdate), count(*) - count(l_shipdate), NULL, NULL, NULL, NULL, NULL FROM lineitem")
    return " UNION ALL ".join(parts)


@query(_stats_sql())
def stats_lineitem(spark, sf_dir):
    return _rounded(table(spark, sf_dir, "lineitem").stats()).withColumn("top_values", F.to_json("top_values"))


# -- diff

_LEFT = "(SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0)"
_RIGHT = "(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 5 <> 0)"


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    df, key = frame(spark, sf_dir, "orders"), F.col("o_orderkey")
    left = df.where(key % 7 != 0).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    right = df.where(key % 5 != 0).select(
        "o_orderkey", "o_custkey", F.when(key % 11 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"), F.when(key % 13 != 0, F.col("o_orderstatus")).alias("o_orderstatus")
    )
    return left, right


def _summary_sql(left: str, right: str, keys: list[str], columns: list[str]) -> str:
    on = " AND ".join(f"l.{k} IS NOT DISTINCT FROM r.{k}" for k in keys)
    changed = " OR ".join(f"l.{c} IS DISTINCT FROM r.{c}" for c in columns) or "false"
    return (
        f"SELECT (SELECT count(*) FROM {left}) - (SELECT count(*) FROM {right}) AS row_count_delta, count(*) FILTER (r.p IS NULL) AS only_left_count, count(*) FILTER (l.p IS NULL) AS only_right_count, "
        f"count(*) FILTER (l.p AND r.p AND ({changed})) AS changed_count FROM (SELECT *, true AS p FROM {left}) l FULL OUTER JOIN (SELECT *, true AS p FROM {right}) r ON {on}"
    )


@query(_summary_sql(_LEFT, _RIGHT, ["o_orderkey"], ["o_custkey", "o_totalprice", "o_orderstatus"]))
def diff_summary(spark, sf_dir):
    return Diff(*_sides(spark, sf_dir), ["o_orderkey"]).summary()


@query(f"SELECT o_orderkey FROM {_LEFT} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_RIGHT}) ORDER BY 1 LIMIT 20")
def diff_only_left(spark, sf_dir):
    return Diff(*_sides(spark, sf_dir), ["o_orderkey"]).only("left")


@query(f"SELECT o_orderkey FROM {_RIGHT} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_LEFT}) ORDER BY 1 LIMIT 20")
def diff_only_right(spark, sf_dir):
    return Diff(*_sides(spark, sf_dir), ["o_orderkey"]).only("right")


@query(
    f"SELECT l.o_orderkey, l.o_totalprice AS left_price, r.o_totalprice AS right_price, l.o_orderstatus AS left_status, r.o_orderstatus AS right_status FROM {_LEFT} l JOIN {_RIGHT} r ON l.o_orderkey = r.o_orderkey "
    "WHERE l.o_totalprice IS DISTINCT FROM r.o_totalprice OR l.o_orderstatus IS DISTINCT FROM r.o_orderstatus ORDER BY 1 LIMIT 20"
)
def diff_changed_rows(spark, sf_dir):
    found = Diff(*_sides(spark, sf_dir), ["o_orderkey"]).changed()
    return found.select(
        "key.o_orderkey", F.col("left.o_totalprice").alias("left_price"), F.col("right.o_totalprice").alias("right_price"), F.col("left.o_orderstatus").alias("left_status"), F.col("right.o_orderstatus").alias("right_status")
    )


@query(_summary_sql(_LEFT, _RIGHT, ["o_orderkey"], ["o_totalprice"]))
def diff_columns_subset(spark, sf_dir):
    return Diff(*_sides(spark, sf_dir), ["o_orderkey"], ["o_totalprice"]).summary()


_LINES = "(SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)"


@query(_summary_sql(_LINES, _LINES.replace("sum(l_quantity)", "sum(l_quantity) + l_linenumber % 2"), ["l_orderkey", "l_linenumber"], ["q"]))
def diff_composite_key(spark, sf_dir):
    lines = frame(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    return Diff(lines, lines.withColumn("q", F.col("q") + F.col("l_linenumber") % 2), ["l_orderkey", "l_linenumber"]).summary()


@query(_summary_sql("(SELECT nullif(n_nationkey, 3) AS k, n_name FROM nation)", "(SELECT nullif(n_nationkey, 3) AS k, upper(n_name) || CASE WHEN n_nationkey = 3 THEN '' ELSE '!' END AS n_name FROM nation)", ["k"], ["n_name"]))
def diff_null_keys(spark, sf_dir):
    df = frame(spark, sf_dir, "nation")
    key = F.nullif("n_nationkey", F.lit(3)).alias("k")
    return Diff(df.select(key, "n_name"), df.select(key, F.concat(F.upper("n_name"), F.when(F.col("n_nationkey") == 3, "").otherwise("!")).alias("n_name")), ["k"]).summary()


@query(_summary_sql("(SELECT n_nationkey AS k, nullif(n_regionkey, 1) AS v FROM nation)", "(SELECT n_nationkey AS k, nullif(n_regionkey, 2) AS v FROM nation)", ["k"], ["v"]))
def diff_null_values(spark, sf_dir):
    df = frame(spark, sf_dir, "nation")
    a, b = (df.select(F.col("n_nationkey").alias("k"), F.nullif("n_regionkey", F.lit(n)).alias("v")) for n in (1, 2))
    return Diff(a, b, ["k"]).summary()


@query("SELECT CAST(0 AS BIGINT) AS row_count_delta, CAST(0 AS BIGINT) AS only_left_count, CAST(0 AS BIGINT) AS only_right_count, CAST(0 AS BIGINT) AS changed_count")
def diff_identical(spark, sf_dir):
    df = frame(spark, sf_dir, "customer")
    return Diff(df, df, ["c_custkey"]).summary()


@query("SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def diff_duplicate_keys(spark, sf_dir):
    df = frame(spark, sf_dir, "lineitem")
    return Diff(df, df, ["l_orderkey", "l_linenumber"]).duplicates("left")


@query("SELECT * FROM (VALUES ('schema_only_left', 'c_name', 'string', NULL), ('schema_only_right', 'extra', NULL, 'int32'), ('schema_type_mismatches', 'c_custkey', 'int64', 'string')) AS t(section, \"column\", left_type, right_type)")
def diff_schema(spark, sf_dir):
    df = frame(spark, sf_dir, "customer")
    left = df.select("c_custkey", "c_nationkey", "c_name")
    return Diff(left, df.select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_nationkey", F.lit(1).alias("extra")), ["c_nationkey"]).schema_frame()


# -- merge, split, convert


@query("SELECT * FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT * FROM customer WHERE c_custkey % 3 = 0")
def merge_two(spark, sf_dir):
    df = frame(spark, sf_dir, "customer")
    return merge([df.where("c_custkey % 2 = 0"), df.where("c_custkey % 3 = 0")])


@query("SELECT * FROM supplier UNION ALL SELECT * FROM supplier UNION ALL SELECT * FROM supplier")
def merge_many(spark, sf_dir):
    return merge([frame(spark, sf_dir, "supplier")] * 3)


@query("SELECT CAST(0 AS INTEGER) AS input, row_number() OVER () - 1 AS row, n_name FROM nation UNION ALL SELECT 1, row_number() OVER () - 1, r_name FROM region")
def merge_order_preserved(spark, sf_dir):
    parts = [table(spark, sf_dir, t).numbered("row").select(F.col(c).alias("n_name"), "row") for t, c in (("nation", "n_name"), ("region", "r_name"))]
    return merge(parts, "input").select("input", "row", "n_name")


@query("SELECT r_regionkey, NULL::DOUBLE AS v FROM region UNION ALL SELECT r_regionkey, CAST(r_regionkey AS DOUBLE) FROM region")
def merge_null_promotion(spark, sf_dir):
    df = frame(spark, sf_dir, "region")
    return merge([df.select("r_regionkey", F.lit(None).alias("v")), df.select("r_regionkey", F.col("r_regionkey").cast("double").alias("v"))])


def _chunks(spark, sf_dir, name: str, file_count: int | None = None, record_count: int | None = None) -> DataFrame:
    data = table(spark, sf_dir, name)
    return split.assigned(data.numbered(), ORDINAL, data.count, file_count, record_count)


@query("SELECT CAST(chunk AS INTEGER) AS chunk, count(*) AS rows, min(o_orderkey) AS first_key FROM (SELECT o_orderkey, ntile(7) OVER (ORDER BY rn) - 1 AS chunk FROM (SELECT o_orderkey, row_number() OVER () AS rn FROM orders)) GROUP BY 1")
def split_file_count(spark, sf_dir):
    return _chunks(spark, sf_dir, "orders", file_count=7).groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"), F.min("o_orderkey").alias("first_key"))


@query("SELECT CAST(rn // 400 AS INTEGER) AS chunk, count(*) AS rows FROM (SELECT row_number() OVER () - 1 AS rn FROM orders) GROUP BY 1")
def split_record_count(spark, sf_dir):
    return _chunks(spark, sf_dir, "orders", record_count=400).groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT count(DISTINCT n) AS sizes, max(n) - min(n) AS spread, sum(n)::BIGINT AS rows FROM (SELECT count(*) AS n FROM (SELECT ntile(11) OVER () AS c FROM customer) GROUP BY c)")
def split_remainder_shape(spark, sf_dir):
    sizes = _chunks(spark, sf_dir, "customer", file_count=11).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.countDistinct("n").alias("sizes"), (F.max("n") - F.min("n")).alias("spread"), F.sum("n").alias("rows"))


@query("SELECT c_custkey, CAST((row_number() OVER () - 1) // 100 AS INTEGER) AS chunk FROM customer")
def split_rows_assignment(spark, sf_dir):
    return _chunks(spark, sf_dir, "customer", record_count=100).select("c_custkey", "chunk")


def _written(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors can reach")
        shared = f"file://{tempfile.gettempdir()}"
    return f"{shared.rstrip('/')}/tessera-{next(tempfile._get_candidate_names())}/{name}"


@query("SELECT * FROM customer")
def convert_parquet_roundtrip(spark, sf_dir):
    path = _written(spark, "customer.parquet")
    table(spark, sf_dir, "customer").convert(path)
    return Dataset(spark, path).frame


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def convert_csv_roundtrip(spark, sf_dir):
    path = _written(spark, "orders.csv")
    table(spark, sf_dir, "orders").convert(path)
    return Dataset(spark, path).frame


@query("SELECT s_name, s_suppkey FROM supplier")
def convert_projection(spark, sf_dir):
    path = _written(spark, "supplier.tsv")
    table(spark, sf_dir, "supplier").convert(path, ["s_name", "s_suppkey"])
    return Dataset(spark, path).frame


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def convert_xlsx_roundtrip(spark, sf_dir):
    path = _written(spark, "nation.xlsx")
    table(spark, sf_dir, "nation").convert(path)
    return Dataset(spark, path).frame


@query("SELECT CAST(c AS INTEGER) AS file, count(*) AS rows, min(p_partkey) AS first_key FROM (SELECT p_partkey, ntile(3) OVER (ORDER BY rn) - 1 AS c FROM (SELECT p_partkey, row_number() OVER () AS rn FROM part)) GROUP BY 1")
def split_files(spark, sf_dir):
    paths, _ = table(spark, sf_dir, "part").split(_written(spark, "part-%03d.parquet"), file_count=3)
    frames = [spark.read.parquet(p).select("p_partkey") for p in paths]
    return merge(frames, "file").groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min("p_partkey").alias("first_key"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole profile of ``lineitem``."""
    return table(spark, sf_dir, "lineitem").stats()


__all__ = ["QUERIES", "SQL", "entry"]
