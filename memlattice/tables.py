"""Reading the tables, and cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as an outer blank of an id.
BLANKS = " \t\n\r\f\v 　"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; zoneless timestamps are taken as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(ntz) if ntz else df


def key(column: Column | str) -> Column:
    """An id as it is compared: no outer blanks, lower case."""
    return F.lower(F.btrim(column, F.lit(BLANKS)))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, removed when the driver's JVM ends. Only a local session may go without that setting; it gets a
    temporary folder, which is removed at exit. On a cluster a missing setting is an error, as a machine's own
    folder is not seen by other executors."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, base, True)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/memlattice-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString()


def subfolders(spark: SparkSession, path: str, prefix: str = "") -> list[str]:
    """Names below a folder that begin with the prefix; none if the folder isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [n for s in fs.listStatus(at) if (n := s.getPath().getName()).startswith(prefix)] if fs.exists(at) else []


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the shared folder and read again: it survives lost executors and is computed once."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
