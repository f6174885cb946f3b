"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one of our own in a local session and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(_drop_local, found[7:])
    return found.rstrip("/")


def _drop_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/graphloom/{tag}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tidily(df: DataFrame, write) -> None:
    """Run a write whose shuffle files nothing reads afterwards, and delete them at its end instead of at some later collection."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        write()
    finally:
        if before is None:
            conf.unset(_CLEANUP)
        else:
            conf.set(_CLEANUP, before)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, computed once and kept as a table: lineage ends here, and a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    tidily(df, lambda: df.write.parquet(path))
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table of written() that nothing will read again."""
    path = getattr(df, "_graphloom_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
