"""Sharding by jump consistent hashing: a key's shard depends on the key and the number of shards alone."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.frames import cut, slots
from tessera.llm.words import mix

#: The step of the generator and the scale of its high bits, as published with the algorithm (fixed values).
STEP = np.uint64(2862933555777941757)
SCALE = float(1 << 31)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to ``shards - 1``, of each 64-bit key. With one shard more, a key stays or goes to the new one."""
    keys = keys.astype(np.uint64)
    found = np.zeros(len(keys), np.int64)
    after = np.zeros(len(keys), np.int64)
    active = np.arange(len(keys))
    while len(active):
        found[active] = after[active]
        keys[active] = keys[active] * STEP + np.uint64(1)
        after[active] = ((found[active] + 1) * (SCALE / ((keys[active] >> np.uint64(33)) + 1.0))).astype(np.int64)
        active = active[after[active] < shards]
    return found


def shard_of(key: Column, shards: int) -> Column:
    """The shard of an integer key; a null key counts as one key of its own."""

    @F.pandas_udf("int")
    def placed(keys: pd.Series, absent: pd.Series) -> pd.Series:
        bits = mix(keys.to_numpy(np.int64).view(np.uint64) ^ np.where(absent.to_numpy(bool), np.uint64(0xA5A5A5A5), np.uint64(0)))
        return pd.Series(jump(bits, shards), dtype="int32")

    return placed(F.coalesce(key.cast("long"), F.lit(0)), key.isNull())


def assign(df: DataFrame, shards: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return ``id, size, text_crc32, law, shard, slot, grown_shard`` for each row; other columns of ``df`` are ignored.

    ``shard`` follows from ``id`` and ``shards`` alone (law ``key``), ``grown_shard`` is the shard with one more.
    ``slot`` counts from 0 without gaps within the shard. ``size`` is the text's UTF-8 bytes plus 8; a null text has none
    and crc32 0. Rows that repeat an id share its shard and have slots of their own; null ids share one shard. No shard
    is gathered by one task: slots are counted window by window, see :func:`tessera.llm.frames.slots`.
    """
    rows = cut(
        df.select(
            F.col(id).alias("__id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
            F.lit("key").alias("law"),
        ).withColumns({"shard": shard_of(F.col("__id"), shards), "grown_shard": shard_of(F.col("__id"), shards + 1)})
    )
    placed = slots(rows, ["shard"], ["__id", "text_crc32", "size"], "slot")
    return placed.select(F.col("__id").alias(id), "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write(df: DataFrame, path: str, shards: int, id: str = "doc_id") -> None:
    """Write ``df`` as Parquet with one folder ``shard=N`` for each shard; all columns are kept.

    A column of ``df`` named ``shard`` would clash and raises ValueError.
    """
    if "shard" in df.columns:
        raise ValueError("the table already has a column named shard")
    df.withColumn("shard", shard_of(F.col(id), shards)).write.partitionBy("shard").parquet(path)
