"""Intermediate tables in the folder that the whole cluster shares, so that a lost executor costs no recomputation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; one of its own only in local mode, where all tasks run on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        where = tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage is cut there, and the shuffle files that led to it go."""
    spark = df.sparkSession
    path = f"{folder(spark)}/stash-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    fs, where = _place(spark, path)
    fs.deleteOnExit(where)  # what isn't dropped before goes with the application
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def drop(df: DataFrame) -> None:
    """Delete a stashed table that nothing needs any more."""
    fs, where = _place(df.sparkSession, df._stashed_at)
    fs.delete(where, True)


def selected(df: DataFrame, *columns: str) -> DataFrame:
    """Some columns of a stashed table, which can still be dropped."""
    out = df.select(*columns)
    out._stashed_at = df._stashed_at
    return out
