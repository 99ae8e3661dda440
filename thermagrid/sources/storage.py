"""The folder that all executors share, and results that are written there and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, inside: str = "scratch") -> str:
    """spark.checkpoint.dir, or a folder inside the warehouse where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isDefined():
            root = context._jsc.sc().getCheckpointDir().get()
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + f"/{inside}"
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(name: str, df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and a lost executor costs nothing before it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
