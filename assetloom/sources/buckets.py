"""Tables stored in buckets by a key, so that joins on the key need no exchange of them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.sources.scratch import dropped, stored

#: Bytes of a bucket, about, and the least and the greatest number of buckets.
BUCKET_BYTES, LEAST, MOST = 256 << 20, 8, 65_536


def _name(folder: str) -> str:
    return "buckets_" + hashlib.sha256(folder.encode()).hexdigest()[:24]


def buckets_for(df: DataFrame) -> int:
    """For a stored table, whose size is that of its files: a power of two, so that tables of unequal size still meet
    bucket by bucket."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = LEAST
    while n < MOST and n * BUCKET_BYTES < size:
        n *= 2
    return n


def write_buckets(df: DataFrame, folder: str, key: str, *, buckets: int | None = None) -> DataFrame:
    """The table, written below ``folder`` in buckets by the hash of ``key``, sorted within; read back so that joins and
    groups on the key take the buckets as they are. The folder must not hold anything yet. Without ``buckets`` the
    table is stored first, to count its bytes, as what a plan expects may be far off."""
    rows = df if buckets else stored(df)
    n = buckets or buckets_for(rows)
    rows.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", folder).saveAsTable(_name(folder))
    if not buckets:
        dropped(rows)
    return df.sparkSession.table(_name(folder))


def read_buckets(spark: SparkSession, folder: str, key: str, buckets: int) -> DataFrame:
    """A table that another session has written; its key and number of buckets must be as they were."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(folder).schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_name(folder)} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{folder}'")
    return spark.table(_name(folder))


def bucket_sizes(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """(bucket, n): rows of each bucket, to see whether one key holds too many."""
    return df.groupBy(F.pmod(F.hash(key), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"))
