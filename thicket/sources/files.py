"""Perturbation tables in, results out."""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of a perturbation file in order, and their names after loading.
COLUMNS = {"praf": "Raf", "pmek": "Mek", "plcg": "Plcg", "PIP2": "PIP2", "PIP3": "PIP3", "p44/42": "Erk", "pakts473": "Akt", "PKA": "PKA", "PKC": "PKC", "P38": "P38", "pjnk": "Jnk"}


def load_perturbations(spark: SparkSession, files: list[str]) -> DataFrame:
    """(11 measures DOUBLE, stimulus): stimulus1, stimulus2, ... in the order of the files.

    Columns go by the names in each file's header, in any order; other columns are left out, and a
    missing one is a ValueError. A byte order mark and blanks around names do no harm.
    """

    def one(path: str, name: str) -> DataFrame:
        head = spark.read.text(path).head()
        names = [c.strip().strip('"') for c in (head.value if head else "").lstrip("\ufeff").split(",")]
        if absent := [c for c in COLUMNS if c not in names]:
            raise ValueError(f"{path} lacks {', '.join(absent)}")
        schema = ", ".join(f"c{k} double" for k in range(len(names)))
        rows = spark.read.csv(path, header=True, schema=schema, enforceSchema=True)
        return rows.select(*(F.col(f"c{names.index(c)}").alias(out) for c, out in COLUMNS.items()), F.lit(name).alias("stimulus"))

    return reduce(DataFrame.unionByName, (one(f, f"stimulus{k}") for k, f in enumerate(files, 1)))


def write_json(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


def write_csv(frame: DataFrame, path: str) -> None:
    """One file with a header, for small tables."""
    frame.coalesce(1).write.mode("overwrite").csv(path, header=True)


def plain(value):
    """Numpy values as Python ones, at any depth."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, np.ndarray):
        return plain(value.tolist())
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    return value.item() if isinstance(value, np.generic) else value


def write_summary(spark: SparkSession, path: str, summary: dict) -> None:
    """A small summary as one JSON text file, on any file system that Spark writes to."""
    spark.createDataFrame([(json.dumps(plain(summary), indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)
