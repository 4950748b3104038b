"""Intermediate tables in the shared folder that the cluster names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of our own only where none is named and all runs on one machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/tessera-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; frames that read them can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


_AT_EXIT: set[str] = set()


def scratch_folder(spark: SparkSession) -> str:
    """A new path in the application's folder, which goes when the driver's program ends."""
    folder = _own_folder(spark)
    if folder not in _AT_EXIT:
        _AT_EXIT.add(folder)
        atexit.register(_clear_at_exit, spark, folder)
    return f"{folder}/{uuid.uuid4().hex}"


def _clear_at_exit(spark: SparkSession, folder: str) -> None:
    try:
        clear_scratch(spark)
    except Exception:  # the session has ended: what the driver can't reach itself is the cluster's to clear
        if "://" not in folder or folder.startswith("file://"):
            shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)


#: Written tables need no marker of success, as they are read only after their job; on a mounted folder no file of
#: checksums beside each file either. Without its native library, Hadoop starts a process to set each file's mode.
_PLAIN = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
_PLAIN_MOUNTED = _PLAIN | {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def materialize(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut and lost executors lose nothing.

    The tables of an application stand in one folder, which goes when the driver's program ends. narrow: rows are a few
    numbers each, so that twice as many files as cores are enough, whatever the shuffle's partitions; only for plans whose
    tasks read their rows one by one.
    """
    spark = df.sparkSession
    path = scratch_folder(spark)
    few = df.coalesce(2 * spark.sparkContext.defaultParallelism) if narrow else df
    few.write.options(**(_PLAIN_MOUNTED if path.startswith("file:") else _PLAIN)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
