"""Connected components on Spark: large-star and small-star rounds on written tables."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, label: str = "components") -> DataFrame:
    """(node, component) of every node of ``edges`` (a long, b long): the smallest node that links reach.

    Each round hangs all larger neighbours of a node, and then all smaller ones, from the smallest; it ends when a
    round changes nothing, after a number of rounds that grows with the logarithm of the longest chain. Minima are summed by node before they meet the edges, so a node with very many links is
    no task of its own (the engine splits such joins)."""
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}0")
    state = None
    for k in itertools.count(1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(low, "a")
        small = joined.where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b"))).distinct()
        following = scratch.keep(small, f"{label}{k}")
        new = following.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{label}{k - 1}")
        now = following
        if new == state or not new[0]:
            break
        state = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
