"""Where intermediate files may lie: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; where a local session names none, as in tests, under a temporary folder.

    On a cluster executors would write to disks of their own there, so that is an error.
    """
    held = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or ""
    if not held:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        held = known.get() if known.isDefined() else ""
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        held = "file://" + tempfile.mkdtemp(prefix="varispark-")
        spark.sparkContext.setCheckpointDir(held)
    return f"{held.rstrip('/')}/formats/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to a new path of scratch() and read from there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
