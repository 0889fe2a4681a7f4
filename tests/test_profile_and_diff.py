"""Column profile and keyed comparison, null and NaN cases included."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import profile, split
from tessera.operators.diff import Diff
from tessera.plans import ordinals


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_numeric(spark):
    df = spark.createDataFrame([(1.0, 2**63 - 1), (float("nan"), 1), (None, None)], "x double, n long")
    x, n = profile.stats_numeric(df).collect()
    assert (x["count"], x.null_count, x.min, x.max) == (2, 1, 1.0, 1.0) and x["mean"] != x["mean"]
    assert n["mean"] == 2.0**62 and n.max == 2.0**63


def test_categorical_and_nulls(spark):
    df = spark.createDataFrame([("a", None), (None, None), ("", None), (None, None)], "s string, e string")
    s, e = profile.stats(df).collect()
    assert (s["count"], s.null_count, s.cardinality) == (2, 2, "2")
    assert [tuple(t) for t in s.top_values] == [("", 3), ("a", 1)] and e.cardinality == "1"


def test_long_values_are_looked_up(spark):
    long = ["x" * 100, "y" * 65, "z" * 64]
    df = ordinals.dense(spark.createDataFrame([(v, v and v[:1]) for v in [long[1], *long * 3, long[0], "short", None]], "v string, w string"))
    v, w = profile.stats(df, top_n=3, order=ordinals.ORDINAL).collect()
    assert [tuple(t) for t in v.top_values] == [(long[1], 4), (long[0], 4), (long[2], 3)] and v.cardinality == "5"
    assert [tuple(t) for t in w.top_values] == [("y", 4), ("x", 4), ("z", 3)]
    assert [(r.value, r["count"]) for r in profile.stats_top_values(df, ["v"], 1, ordinals.ORDINAL).collect()] == [(long[1], 4)]


def test_ties_by_first_appearance(spark):
    df = ordinals.dense(spark.createDataFrame([(v,) for v in "baabc"], "v string"))
    assert [r.value for r in profile.stats_top_values(df, ["v"], 3, ordinals.ORDINAL).orderBy("rank").collect()] == ["b", "a", "c"]


def test_cap_limit_and_empty(spark):
    df = spark.range(10_001).select(F.col("id").cast("string").alias("k"), F.lit(True).alias("b"))
    k, b = profile.stats(df).collect()
    assert k.cardinality == ">10000" and [tuple(t) for t in b.top_values] == [("True", 10_001)]
    assert profile.stats(df, limit=1).count() == 1
    with pytest.raises(ValueError):
        profile.stats(df, limit=-1)
    empty = profile.stats(df.limit(0)).collect()
    assert [r["count"] for r in empty] == [0, 0] and empty[0].cardinality == "0"


def test_profile_reads_once_and_stays_in_the_jvm(spark):
    df = spark.range(10).select("id", F.col("id").cast("string").alias("s"))
    plan = profile.stats(df)._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_diff_counts(spark):
    left = spark.createDataFrame([(1, "alice", 10), (2, "bob", 20)], "id long, name string, score long")
    right = spark.createDataFrame([(2, "bobby", 25), (3, "carol", 30)], "id long, name string, score long")
    found = Diff(left, right, ["id"]).result()
    assert (found["row_count_delta"], found["only_left_count"], found["only_right_count"], found["changed_count"]) == (0, 1, 1, 1)
    assert found["only_left"] == [{"key": 1}] and found["changed_rows"] == [{"key": 2, "left": {"name": "bob", "score": 20}, "right": {"name": "bobby", "score": 25}}]
    assert Diff(left, right, ["id"]).result(summary_only=True)["only_left"] == []
    assert Diff(left, right, ["id", "name"]).result()["only_right"] == [{"key": (2, "bobby")}, {"key": (3, "carol")}]


def test_diff_nulls_nan_and_types(spark):
    left = spark.createDataFrame([(None, 1.0), (1, None), (2, float("nan"))], "k long, v double")
    assert rows(Diff(left, left, ["k"]).summary()) == [(0, 0, 0, 0)]
    assert rows(Diff(left, left, ["k"], nan_differs=True).summary()) == [(0, 0, 0, 1)]
    text = left.select(F.col("k").cast("string").alias("k"), "v")
    assert Diff(left, text, ["k"]).schema_type_mismatches() == [("k", "int64", "string")]
    assert rows(Diff(left.where("k = 1"), text.where("k = '1'"), ["k"]).summary())[0][1:3] == (1, 1)
    wide = left.select(F.col("k").cast("double").alias("k"), "v")
    assert rows(Diff(left, wide, ["k"]).summary()) == [(0, 0, 0, 0)]


def test_diff_odd_names(spark):
    left = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "`a.k` long, `x``y` string, `v.w` double")
    right = left.select("`a.k`", "`x``y`", (F.col("`v.w`") * 2).alias("v.w"))
    found = Diff(left, right, ["a.k", "x`y"]).result()
    assert found["changed_count"] == 2 and found["changed_rows"][0] == {"key": (1, "a"), "left": {"v.w": 1.0}, "right": {"v.w": 2.0}}
    assert Diff(left, right.where("`a.k` = 1"), ["a.k"]).only("left").collect()[0]["a.k"] == 2
    with pytest.raises(ValueError, match="Duplicate key"):
        Diff(left.union(left), right, ["a.k"]).check_keys()


def test_diff_repeated_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "id long, v string")
    with pytest.raises(ValueError, match="Duplicate key found in left input: 1"):
        Diff(df, df.limit(1), ["id"]).result()
    with pytest.raises(ValueError, match="Columns not found"):
        Diff(df, df, ["x"])


@pytest.mark.parametrize("seed", range(3))
def test_diff_against_brute_force(spark, seed):
    draw = random.Random(seed)
    sides = []
    for _ in range(2):
        keys = draw.sample([None, *range(40)], 25)
        sides.append({k: draw.choice([None, 1.0, 2.0, 3.0]) for k in keys})
    left, right = (spark.createDataFrame(list(s.items()), "k long, v double") for s in sides)
    a, b = sides
    want = (0, len(a.keys() - b.keys()), len(b.keys() - a.keys()), sum(a[k] != b[k] for k in a.keys() & b.keys()))
    assert rows(Diff(left, right, ["k"]).summary()) == [want]


@pytest.mark.parametrize("total, count", [(1, 1), (10, 3), (100, 7), (64, 64)])
def test_chunks(spark, total, count):
    found = Counter(r[0] for r in spark.range(total).select(split.chunk(F.col("id"), total, file_count=count)).collect())
    sizes = [found[i] for i in range(count)]
    assert sum(sizes) == total and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)


def test_dense_numbers(spark):
    df = spark.range(0, 1000, 1, 7)
    assert [r.id - r["__ordinal"] for r in ordinals.dense(df).collect()] == [0] * 1000
    assert ordinals.dense(df.limit(0)).count() == 0
