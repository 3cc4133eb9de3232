"""Shared working folders: where jobs write what they read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

PART_BYTES = 512 << 20
MOST_BYTES = 1 << 50


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; in local mode an own folder where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def parts_for(df: DataFrame) -> int:
    """Partitions for an exchange by a key, which adaptive execution does not split.

    One for each PART_BYTES that df is estimated at, and the session's number of
    shuffle partitions at least.  Sources of unknown size count as MOST_BYTES or
    more and get the session's number.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, -(-size // PART_BYTES)) if size < MOST_BYTES else least


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and reads it back; with the table's path.

    The table survives lost executors, and its size on disk lets the planner
    choose a broadcast join only where the table is below its threshold.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table of `stored_at`; it stays until the shared folder is cleared."""
    return stored_at(df, name)[0]


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table of `stored_at` that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
