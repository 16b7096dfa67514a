"""Tables written once in the folder that driver and executors share: lineage ends there, and lost executors don't lose them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a temporary folder for a local master without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='thicket-')}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """frame, written in a new folder and read again; for what several parts of a plan, or several jobs, read."""
    spark = frame.sparkSession
    out = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(out)
    return spark.read.schema(frame.schema).parquet(out)
