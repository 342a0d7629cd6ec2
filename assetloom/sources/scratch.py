"""Tables written in between, so that loops neither grow their plans nor compute anything twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one in a
    local session; on a cluster, whose machines would each write to their own, ValueError."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def stored(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read back: what follows survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few short columns that may be broadcast: some tens of MB.
SMALL_ROWS = 500_000


def uncounted(df: DataFrame) -> DataFrame:
    """The table as a side of a join of equal keys that is never broadcast: Spark goes by the bytes of files and the number
    of columns, and takes a million computed names for a small table."""
    return df.hint("merge")


def small_side(df: DataFrame) -> DataFrame:
    """The table, stored; to be broadcast if its counted rows are few, else met by a shuffle."""
    df = stored(df)
    return F.broadcast(df) if df.count() <= SMALL_ROWS else uncounted(df)


#: Bytes for each core up to which a table counts as small.
CORE_BYTES = 64 << 20


def evenly(df: DataFrame) -> DataFrame:
    """The table, dealt to all cores if it is small: such a one may be a single piece of a file, and so one task.
    A larger one is in many pieces and stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= cores * CORE_BYTES else df


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            deleted(df.sparkSession, files[0].rsplit("/", 1)[0])


def deleted(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, in whatever store it is; nothing happens if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
