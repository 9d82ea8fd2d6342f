"""Cutting lineage with written tables in the folder that every executor shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode, where driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="spark-cut-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    checkpoint() would run a map-only plan twice (once to count, once to write); a written table runs it once and survives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def _files(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def finished(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders in `folder` that a job has written to the end (they hold a _SUCCESS mark)."""
    at, fs = _files(spark, folder)
    if not fs.exists(at):
        return []
    paths = [f.getPath() for f in fs.listStatus(at) if f.isDirectory()]
    return [p.getName() for p in paths if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at, fs = _files(spark, path)
        fs.delete(at, True)


def drop(df: DataFrame) -> None:
    """Delete the table behind a DataFrame that materialise() returned, once nothing reads it any more; others are left alone."""
    path = getattr(df, "_cut_path", None)
    if path:
        delete(df.sparkSession, [path])
