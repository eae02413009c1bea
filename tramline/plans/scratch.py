"""Tables written into the folder that driver and executors share, to cut long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Without Hadoop's native library, file: launches a process for each file it makes, data, checksum and mark of success alike, and a
#: process just launched counts with its parent's whole memory. So only data files are made (their pages hold checksums of their own).
FEW_FILES = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
    "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where a local session (tests) has none, a temporary folder is made and set; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    base = base or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tramline-scratch-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/tramline/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """The rows of df, from a Parquet table in the shared folder that survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    # The plan runs this once, so its shuffle files can go with it instead of waiting for the driver's garbage collection.
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.options(**FEW_FILES).parquet(path, compression=codec)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tramline_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame that `written` returned, once nothing reads it."""
    path = getattr(df, "_tramline_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
