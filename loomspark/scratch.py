"""Folders for intermediate tables, under the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by a local session that names no shared folder.
LOCAL_SHARED = "file:///tmp/checkpoints"


def scratch(spark: SparkSession, tag: str = "tmp") -> str:
    """A fresh folder URI under spark.checkpoint.dir; on a cluster that setting is needed."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_SHARED
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The table written once and read back: what follows sees one fixed result, however often it is read or a task is repeated."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
