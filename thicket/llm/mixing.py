"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected to be taken target / size of source times. Documents stand
in order of size; the running sum of those expectations, moved by one random offset for the
source, crosses some integers on its way, and a document is emitted once for each that it crosses.
In order of size, every stretch of sizes is met at the same rate, so the words taken differ from
the target by no more than a few documents' worth.

The running sum is not one long scan: a source is cut into runs (by size, then by hash), runs are
counted, and a document's place is its run's start plus its place in the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from one row a source, with share of all sizes by weight.

    Sources stand by code point, null last, and take the weights in turn. A target stops at `most`
    times its source's size; what is over goes to the others by weight. In the order of size to
    weight, the capped ones come first, so the level of the rest is found without iterating: it is the largest that does not
    exceed its own source's cap.
    """
    # A row a source: these windows see no documents.
    everything = Window.partitionBy()
    ranked = sizes.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("k") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * most).withColumn("total", F.sum("source_size").over(everything))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    level = (F.col("total") - (F.sum("cap").over(by_level) - F.col("cap"))) / (F.sum("weight").over(everything) - (F.sum("weight").over(by_level) - F.col("weight")))
    levels = ranked.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(everything))
    target = F.least(F.col("cap").cast("double"), F.coalesce("level", F.lit(0.0)) * F.col("weight"))
    return levels.select("source", "source_size", target.alias("target"))


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = "mix") -> DataFrame:
    """docs as the struct `row`, with size, source_size, target and copies (0 to `most`).

    A null text has size 0; a null source is a source of its own. The same rows get the same
    copies on every run. Sources of size 0 have target 0 and give nothing. An empty table gives no
    rows. `row` keeps every column of docs, whatever its name.
    """
    key = F.md5(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")))
    sized = docs.select(F.struct("*").alias("row")).select("row", F.col("row.source").alias("source"), words_in(F.col("row.text")).alias("size"))
    # A run is narrow in size; the hash digit keeps one size that very many documents have apart.
    placed = sized.withColumn("width", F.floor(F.sqrt("size"))).withColumn("digit", F.substring(key, 1, 1))
    # A row a run, written: texts are read once for the runs and once for the places.
    scratch = Scratch(docs.sparkSession, "mixing")
    counted = scratch.cut(placed.groupBy("source", "width", "digit").agg(F.count("*").alias("n"), F.sum("size").alias("run_size")), "runs")
    targets = source_targets(counted.groupBy("source").agg(F.sum("run_size").alias("source_size")), weights, most)

    along = Window.partitionBy("source").orderBy("width", "digit")
    runs = counted.withColumn("before", F.sum("n").over(along) - F.col("n")).drop("n", "run_size")
    named = targets.withColumnRenamed("source", "of")
    runs = runs.join(named, runs["source"].eqNullSafe(named["of"])).drop("of")
    runs = runs.toDF("s", "w", "d", "before", "source_size", "target")

    order = Window.partitionBy("source", "width", "digit").orderBy("size", key, F.xxhash64("row.text"))
    ranked = placed.withColumn("place", F.row_number().over(order))
    ranked = ranked.join(runs, ranked["source"].eqNullSafe(runs["s"]) & (F.col("width") == F.col("w")) & (F.col("digit") == F.col("d")))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = F.col("before") + F.col("place")
    crossed = F.floor(place * rate + offset) - F.floor((place - 1) * rate + offset)
    return ranked.select("row", "size", "source_size", "target", F.least(crossed, F.lit(most)).cast("long").alias("copies"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The rows of the mix, with the columns of docs; a document that is taken twice is there twice."""
    taken = copies(docs, weights, most).where("copies > 0")
    return taken.select(F.explode(F.expr("array_repeat(row, int(copies))")).alias("row")).select("row.*")
