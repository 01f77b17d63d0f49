"""Written intermediate tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, a local one in local mode and an error on a cluster."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith(("local[", "local*")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="acervo-")
    return f"{top}/acervo-{uuid.uuid4().hex}"


def kept(frame: DataFrame) -> DataFrame:
    """The frame, written to a new shared folder and read from there."""
    path = folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
