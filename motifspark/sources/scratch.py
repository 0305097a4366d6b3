"""Files that a query writes and reads back, and tables stored between steps, in the shared folder of the session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_written: list[str] = []  # paths given out in this session


def new_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder that the session names; only local sessions without one get a temporary folder, deleted at exit."""
    base = spark.conf.get(SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="motifspark-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set(SETTING, base)
    _written.append(f"{base.rstrip('/')}/motifspark-files-{uuid.uuid4().hex}")
    return _written[-1]


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: what is used more than once is computed once and survives lost executors."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_files(spark: SparkSession) -> None:
    """Delete all files and tables written so far by this session; results that still read them become invalid."""
    while _written:
        at = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """A parameter-sized text as one file of that very name, on any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
