"""The driver's tables by name, and tables that are written between rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

NAMES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()
SHARED = "spark.checkpoint.dir"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of ``sf_dir``; the path may be on any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a session on one machine may do without the setting: it gets a new local one."""
    found = spark.conf.get(SHARED, None) or spark.sparkContext.getConf().get(SHARED, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {SHARED} to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(SHARED, found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder: plans of later rounds start from it, whatever executors are lost."""
    spark = df.sparkSession
    path = f"{folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
