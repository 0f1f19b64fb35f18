"""Lineage cuts: intermediate tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a fresh temporary folder where that setting is unset in a local session, an error elsewhere."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that driver and executors share")
    if not folder:
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for one intermediate result; no two calls share one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: later reads don't recompute it and survive lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_with(df: DataFrame, name: str, *measures: Column) -> tuple[DataFrame, dict]:
    """``written``, and aggregates of the rows (each with an alias) that are taken as they are written, without a job of their own."""
    seen = Observation()
    table = written(df.observe(seen, *measures), name)
    return table, seen.get


#: Rows up to which a table of voxels, runs or pieces may be broadcast.
MOST_BROADCAST = 200_000


def tabled(df: DataFrame, name: str, most: int = MOST_BROADCAST) -> DataFrame:
    """``written``, for tables of voxels, runs and what is made of them: with more than ``most`` rows it is never broadcast.

    Spark takes a table to be as small as its files. Coordinates are stored in a bit or two, so millions of rows have a few MB of files and
    fill the driver when they are broadcast; the rows are counted as they are written.
    """
    table, seen = written_with(df, name, F.count("*").alias("n"))
    return table.hint("merge") if (seen["n"] or 0) > most else table


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path in it, for tasks that write or map files themselves."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)
