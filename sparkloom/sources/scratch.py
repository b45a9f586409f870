"""Tables that outlive an executor, in the folder that all executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset a local session gets a temporary folder, anything else an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sparkloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table and read again: made once, and safe when executors go."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, shuffle files go as soon as the query that made them ends, not when the driver happens to collect its garbage; a session's own setting stays.

    For searches of many queries of which each result is written: no later one
    reads an earlier one's shuffles.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name)


def kept_path(df: DataFrame, what: str) -> str:
    """A folder below the shared one for what is made of the files that ``df`` reads: another one as soon as a file, its size or its time changes."""
    spark = df.sparkSession
    conf = spark._jsc.hadoopConfiguration()
    seen = hashlib.sha256()
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        seen.update(f"{name}|{status.getLen()}|{status.getModificationTime()}\n".encode())
    return f"{shared_dir(spark)}/{what}-{seen.hexdigest()[:24]}"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
