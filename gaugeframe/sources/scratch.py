"""Intermediate tables in the folder that all executors share.

``save`` cuts the lineage by writing a parquet table below ``spark.checkpoint.dir`` and reading it again, so a lost
executor never loses an intermediate result. Where a local session (tests, notebooks) names no folder one is made below
the system's temporary folder; a cluster must name its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    named = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError(f"{KEY} must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="gaugeframe-")
    return _own[app]


FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Actions inside give up their shuffle files as soon as they have ended, not when the driver's garbage is collected:
    what they made is written or on the driver, and nothing reads those files again. The session's setting stays."""
    try:
        was = spark.conf.get(FREE)
    except Exception:  # a version of Spark without the setting
        yield
        return
    spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE, was)


class Saved:
    """A written intermediate table; ``drop`` deletes it when no later plan reads it."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{folder(self.spark)}/gaugeframe/{uuid.uuid4().hex}"
        with freed(self.spark):
            df.write.parquet(self.path)
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def save(df: DataFrame) -> DataFrame:
    return Saved(df).df


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables below the shared folder. Results that are still to be read from them are lost."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder(spark)}/gaugeframe")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
