"""Paths in the folder that driver and executors share, and tables that are written there."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a local master, where driver and executors are one process, may leave it unset: a folder in the session's warehouse is used then.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tidemark-shared"


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and file system of a path."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in this application's part of the shared folder, which goes when the application ends."""
    jpath, files = file_system(spark, f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}")
    top = re.sub("^file:/+", "file:///", files.makeQualified(jpath).toString())  # with its scheme, for readers that are not Hadoop's
    if not files.exists(jpath):
        files.mkdirs(jpath)
        files.deleteOnExit(jpath)
    return f"{top}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and no executor is needed for it."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what stored() wrote for df."""
    if path := getattr(df, "_tidemark_path", None):
        jpath, files = file_system(df.sparkSession, path)
        files.delete(jpath, True)
