"""Sides to be broadcast, and components of a graph, for the operators on pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.sources.scratch import stored


#: Rows of a few numbers that may be broadcast: at most some 16 MB.
SMALL_ROWS = 500_000
#: Bytes of a column of any length in such rows.
SMALL_BYTES = 32 << 20


def small_side(df: DataFrame) -> DataFrame:
    """A stored narrow table, to be broadcast if its counted rows are few; else as it is."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def sized_side(df: DataFrame, length: Column) -> DataFrame:
    """As ``small_side``, for a stored table with a column of any ``length``, whose sum is bounded too."""
    n = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(length), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if n.rows <= SMALL_ROWS and n.bytes <= SMALL_BYTES else df


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``edges`` (a, b) reaches.

    Large and small stars in turn: every node hooks its larger neighbours, then its smaller ones, to
    the least node around it, until nothing changes; the rounds grow with the logarithm of the
    longest path. Each round aggregates before it joins, so a hub costs one row a task.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        now = stored(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct())
        was, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if was == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
