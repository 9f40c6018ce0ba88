"""Sharding by jump consistent hashing: no ring table; an appended shard takes rows only into itself.

Null keys hash like any other value (all to one shard). Repeated rows and ties get slots of their own.
An empty table gives an empty table. Columns of the input stay as they are, but for those named like a new one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, gapless_rank, restored

STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, after Lamping and Veach."""
    key = keys.astype(np.uint64, copy=True)
    at, to = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    while (going := np.flatnonzero(to < shards)).size:
        at[going] = to[going]
        k = key[going] * STEP + np.uint64(1)
        key[going] = k
        to[going] = np.floor((at[going] + 1) * (float(1 << 31) / ((k >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
    return at


def jump_shard(key: Column, shards: int) -> Column:
    """Shard (0 to shards - 1) of a key column of any type."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("int")
    def shard(h: pd.Series) -> pd.Series:
        return pd.Series(jump(h.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return shard(F.xxhash64(key))


def shard_table(df: DataFrame, key: str, shards: int, grow_to: int | None = None) -> DataFrame:
    """Adds ``shard``, gapless ``slot`` within it, and ``grown_shard`` for ``grow_to`` shards.

    Slots follow chunks by a hash of the row, and within a chunk the key and the other columns (but for maps), so they
    depend on the rows alone. Columns that had these names are replaced."""
    own = F.col(f"`{key}`")
    rows = carried(df, own.alias("_key"), jump_shard(own, shards).alias("_shard"), jump_shard(own, grow_to or shards + 1).alias("_grown"))
    order = [F.col("_key"), *(F.col(f"_row.`{f.name}`") for f in df.schema if f.name != key and "map<" not in f.dataType.simpleString())]
    ranked = gapless_rank(rows, ["_shard"], order, order, "_slot")
    return restored(ranked, df.columns, shard=F.col("_shard"), slot=F.col("_slot"), grown_shard=F.col("_grown"))
