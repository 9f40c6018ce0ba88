"""Helpers shared by the corpus operators: scratch tables, gapless ranks, batch slices."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the session. Only a local session that names none, as in tests, gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="helixmill-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


#: Spark's setting that removes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Written tables that cut lineage: any executor can read them again after another is lost.

    A table is dropped with ``drop`` once later tables no longer need it, and all that are left by ``swept``."""

    #: Folders that are open within the innermost ``swept``.
    within: list[list[Scratch]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
        if Scratch.within:
            Scratch.within[-1].append(self)

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """Writes a table and reads it again. As it stands for its shuffles, their files go at once."""
        where = f"{self.path}/{label}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(where)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *labels: str) -> None:
        jvm = self.spark._jvm
        for label in labels:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{label}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def swept() -> Iterator[None]:
    """Drops the folders of all scratch tables that are begun within, at its end: nothing may read them later."""
    Scratch.within.append([])
    try:
        yield
    finally:
        for scratch in Scratch.within.pop():
            scratch.drop("")


def carried(df: DataFrame, *others: Column | str) -> DataFrame:
    """All columns as one struct ``_row``, so that no name of theirs can clash, and ``others`` beside it."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), *others)


def restored(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of a carried table again; ``new`` ones take the place of those of their name or follow."""
    kept = [(new[c] if c in new else F.col(f"_row.`{c}`")).alias(c) for c in columns]
    return df.select(*kept, *(x.alias(c) for c, x in new.items() if c not in columns))


#: Chunks at least that ``gapless_rank`` deals a table's rows into.
CHUNKS = 256


def gapless_rank(df: DataFrame, keys: list[str], dealt: list[Column], order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... within ``keys``, by chunk and then ``order``.

    Chunks are dealt by a hash of ``dealt``, so ids may be sparse, clustered or null. Counts by (keys, chunk) are summed
    first: no window holds more than one chunk of a key. Only rows that are equal in all of ``dealt`` share a chunk for sure."""
    chunks = max(CHUNKS, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df = df.withColumn("_chunk", F.pmod(F.xxhash64(*dealt), F.lit(chunks)).cast("int"))
    part = [*keys, "_chunk"]
    before = (
        df.groupBy(*part)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("_n")
    )
    within = F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1
    return df.withColumn("_within", within).join(before, part).withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).drop("_chunk", "_within", "_before")


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each slice holds about ``most`` bytes of text (or one long row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place where it can."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> np.ndarray:
    """uint64[n]: the powers of an odd number, for hashes of words by place."""
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)
