"""What the operators share on the Spark side: lineage cuts in the cluster's shared folder, and dense slots within groups."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SETTING = "spark.checkpoint.dir"
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only local sessions, as in tests, may leave it unset and get a temporary one."""
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that the driver and all executors can reach")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set(_SETTING, found)
    return found.rstrip("/")


def quoted(name: str) -> Column:
    """The column of just this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: a lost executor costs no recomputation of what came before.

    With ``by``, a whole number, rows of each value have a folder of their own, so that a filter on it reads only that.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}"
    _written.append((spark, path))
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete what :func:`cut` wrote; DataFrames that read it are useless afterwards. Runs by itself when Python ends."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended first; the folder is then the cluster's to clean  # noqa: BLE001
            return


atexit.register(release)


def once(udf):
    """The function, evaluated where it stands: a filter on its result does not make Spark evaluate it a second time below."""
    return udf.asNondeterministic()


#: Bits of the filter before a join: 8 MB, whatever the input's size; and of each of its parts, as Spark's bitmaps have them.
FILTER_BITS, PART_BITS = 26, 15


def marked(df: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with a flag: true where ``key`` is in ``keys`` and, while those are far fewer than 67 million, hardly elsewhere.

    A bitmap of hashed keys is broadcast in parts, and spares a join or a shuffle the rows that find no partner. It never
    misses one that does; where it fills up, it only spares less. ``keys`` should be cut. All of it is DataFrame functions.
    """

    def at(column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS))

    low = (1 << PART_BITS) - 1
    parts = keys.select(at(quoted(key)).alias("at")).groupBy(F.shiftright("at", PART_BITS).alias("__part")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(low))).alias("__bits"))
    place = at(quoted(key)).bitwiseAND(F.lit(low)).cast("int")
    byte = F.ascii(F.decode(F.substring(F.col("__bits"), F.shiftright(place, 3) + 1, F.lit(1)), "ISO-8859-1"))
    found = df.withColumn("__part", F.shiftright(at(quoted(key)), PART_BITS)).join(F.broadcast(parts), "__part", "left")
    return found.withColumn(name, F.coalesce(F.getbit(byte, place.bitwiseAND(F.lit(7))) == 1, F.lit(False))).drop("__part", "__bits")


def possible(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``df`` without most of the rows whose ``key`` is not in ``keys``; see :func:`marked`."""
    return marked(df, keys, key, "__possible").where("__possible").drop("__possible")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def slots(df: DataFrame, group: list[str], order: list[str], name: str, rows_per_window: int = 20_000) -> DataFrame:
    """Add ``name``: 0, 1, 2 ... within each group, without gaps.

    A group may hold any share of the rows: it is cut by a hash of ``order`` into windows of about ``rows_per_window``
    rows, each is numbered alone, and each window's start is the sum of the counts before it. ``order`` should tell rows
    apart; rows that agree on it get any order among themselves. ``df`` should be cheap or cut, as it is read twice.
    """
    part = "__part"
    total = df.count()
    pieces = max(1, -(-total // rows_per_window))
    salted = df.withColumn(part, F.pmod(F.xxhash64(*order), F.lit(pieces)).cast("int"))
    counts = salted.groupBy(*group, part).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = Window.partitionBy(*group, part).orderBy(*order)
    numbered = salted.withColumn("__row", F.row_number().over(own))
    keys = [*group, part]
    joined = numbered.join(starts, keys, "left")
    return joined.withColumn(name, (F.col("__start") + F.col("__row") - 1).cast("long")).drop("__row", "__start", part)
