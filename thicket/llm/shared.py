"""What the operators share: tables, the folder for intermediate tables, sized broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers each that may be broadcast: 16 MB of ids at most.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is named (local runs)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    # The setting can't change in a running session.
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = f"file://{tempfile.mkdtemp(prefix='thicket-')}"
    return _own[app]


class Scratch:
    """A new folder under the shared one. Tables written there cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def cut(self, frame: DataFrame, name: str) -> DataFrame:
        """Write a table and read it again."""
        out = f"{self.path}/{name}"
        frame.write.mode("overwrite").parquet(out)
        return self.spark.read.schema(frame.schema).parquet(out)

    def drop(self, name: str = "") -> None:
        """Delete a table that nothing reads any more, or the folder."""
        jvm, where = self.spark._jvm, f"{self.path}/{name}" if name else self.path
        target = jvm.org.apache.hadoop.fs.Path(where)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def bounded(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it has so few (narrow) rows; else left to a shuffled join. Counts the frame."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame
