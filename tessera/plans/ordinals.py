"""Row numbers in the order of a scan, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDINAL = "__ordinal"


def dense(df: DataFrame, name: str = ORDINAL) -> DataFrame:
    """Add 0, 1, 2 ... in the order of partitions and of rows in them.

    One pass counts the rows of each partition; a row's number is its partition's start and its place there. The frame
    must give the same partitions when it is read again, as scans of files do.
    """
    tagged = df.withColumns({"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id()})
    counts = sorted((r["__part"], r["count"]) for r in df.select(F.spark_partition_id().alias("__part")).groupBy("__part").count().collect())
    begin, starts = 0, []
    for part, count in counts:
        starts.append((part, begin))
        begin += count
    start = F.element_at(F.create_map(*[F.lit(x) for pair in starts for x in pair]), F.col("__part")) if starts else F.lit(0)
    place = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return tagged.withColumn(name, (start + place).cast("long")).drop("__part", "__place")
