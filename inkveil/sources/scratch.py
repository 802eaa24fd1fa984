"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder below spark.checkpoint.dir; where that is unset, one of our own, on a single machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "/tmp/checkpoints/inkveil"
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def removed_at_end(spark: SparkSession, path: str) -> str:
    """The path, which goes when the driver's Python ends."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()

    def remove() -> None:
        with contextlib.suppress(Exception):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)

    atexit.register(remove)
    return path


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder, for what is read more than once: it is computed once, and a lost executor costs
    nothing of what came before."""
    spark = df.sparkSession
    path = removed_at_end(spark, shared_folder(spark, "t"))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
