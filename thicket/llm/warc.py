"""WARC archives: written with duplicate payloads as revisits, read back by boundary-chain verification.

Writing is Spark's text sink with the blank lines that end a record as line separator, so archives
land on any file system that Spark writes to and survive lost tasks. Reading cuts the files at the
magic line, wherever it stands. Each cut is only a candidate record; its header names the offset
where the next record must start. Pointer jumping from each file's start marks the candidates on
that chain. A magic line inside a payload is never on it: its cut belongs to the record before.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, bounded

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Smaller payloads are stored as they are.
REVISIT_BYTES = 1000


def line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null; control characters can't end a line early."""
    clean = F.regexp_replace(value.cast("string"), r"[\x00-\x1F\x7F]", " ")
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n"))).otherwise("")


#: Repeated payloads (a digest and an id each) that are sent to every task; more are met by a shuffle.
BROADCAST_PAYLOADS = 200_000


def records(pages: DataFrame, scratch: Scratch, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(record): a WARC record without its end for each row of pages (page_id, url, html)."""
    page = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    page = page.withColumn("bytes", F.octet_length("payload")).withColumn("same", F.unhex(F.sha2(F.encode("payload", "utf-8"), 256)))
    repeated = page.where(F.col("bytes") >= revisit_bytes).groupBy("same", "bytes").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")
    page = page.join(bounded(scratch.cut(repeated, "repeated"), BROADCAST_PAYLOADS), ["same", "bytes"], "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    digest = F.concat(F.lit("sha1:"), F.sha1(F.encode("payload", "utf-8")))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("response").cast("string"), F.lit(">")))),
        line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Payload-Digest", digest),
        line("WARC-Payload-Length", F.col("bytes")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, 0).otherwise(F.col("bytes"))),
        F.lit("\r\n"),
    )
    return page.select(F.concat(head, F.when(revisit, "").otherwise(F.col("payload"))).alias("record"))


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write pages (page_id long, url string, html string; null html is an empty payload) as WARC files.

    Of pages with equal payloads of at least revisit_bytes, that with the largest page_id is
    stored and the others refer to it. Rows that repeat that page_id are all stored. Rows with a
    null page_id have no record id. An empty table writes no record.
    """
    scratch = Scratch(spark, "warc-write")
    records(pages, scratch, revisit_bytes).write.mode("overwrite").option("lineSep", END).text(folder)
    scratch.drop()


def header(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1), F.lit(""))


@contextmanager
def fixed_splits(spark: SparkSession) -> Iterator[None]:
    """Scans in here split files alike, though executors come and go: a cut has the same place in each of them."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    if before is None:
        spark.conf.set(name, str(max(2, spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)


def cuts(spark: SparkSession, folder: str) -> DataFrame:
    """The files cut at each magic line, in order: file, block, nth (of the block's cuts), body, length with the magic."""
    read = spark.read.option("lineSep", MAGIC).text(folder)
    cut = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), F.col("value").alias("body"))
    return cut.withColumn("length", F.octet_length("body") + len(MAGIC))


def candidates(spark: SparkSession, folder: str, scratch: Scratch) -> DataFrame:
    """A row for each cut: where it starts, where its header says that the next record starts, and what it holds."""
    cut = cuts(spark, folder)
    # The header ends at the first blank line.
    cut = cut.withColumn("head_bytes", F.instr("body", "\r\n\r\n") + 3).withColumn("head", F.when(F.col("head_bytes") > 3, F.substring_index("body", "\r\n\r\n", 1)).otherwise(""))
    cut = cut.withColumn("head_bytes", F.octet_length("head") + 4)
    size = F.when(header("Content-Length").try_cast("long") >= 0, header("Content-Length").try_cast("long"))
    whole = F.col("length") == F.col("content") + F.col("head_bytes") + F.lit(len(MAGIC) + len(END))
    # Bodies are strings of bytes; substring counts characters, so the payload is taken from the binary.
    payload = F.expr("substring(cast(body as binary), head_bytes + 1, int(content))")
    cut = cut.withColumn("content", size).withColumn("whole", F.coalesce(whole, F.lit(False)))
    kept = cut.select(
        "file", "block", "nth", "length", "head_bytes", "content", "whole",
        header("WARC-Type").alias("record_type"), header("WARC-Record-ID").alias("id"), header("WARC-Refers-To").alias("refers"),
        header("WARC-Payload-Digest").alias("digest"), header("WARC-Payload-Length").try_cast("long").alias("bytes"),
        F.when(F.col("whole"), F.sha1(payload)).alias("sha1"),
    )
    kept = scratch.cut(kept, "cuts")
    # A file's first cut is what stands before the first magic line: nothing. Its magic isn't there.
    blocks = kept.groupBy("file", "block").agg(F.sum("length").alias("size"))
    blocks = blocks.select("file", "block", (F.sum("size").over(Window.partitionBy("file").orderBy("block")) - F.col("size")).alias("base"))
    inside = F.sum("length").over(Window.partitionBy("file", "block").orderBy("nth")) - F.col("length")
    placed = kept.withColumn("inside", inside).join(blocks, ["file", "block"])
    placed = placed.withColumn("start", F.col("base") + F.col("inside") - len(MAGIC))
    placed = placed.withColumn("next", F.col("start") + len(MAGIC) + F.col("head_bytes") + F.col("content") + len(END))
    return scratch.cut(placed.where("start >= 0").drop("base", "inside"), "candidates")


def reachable(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(file, start) of the candidates on the chain that begins at each file's start, by pointer jumping.

    After k rounds a pointer leads 2^k records ahead and the first 2^k records are marked. Within
    runs of records that follow each other without a gap, all pointers are set at once: only a
    run's last pointer is jumped along, so rounds grow with the logarithm of the runs in a file.
    """
    ordered = Window.partitionBy("file").orderBy("start")
    # A candidate opens a run unless the one before it leads right here.
    links = found.select("file", "start", "next").withColumn("opens", ~F.coalesce(F.lag("next").over(ordered) == F.col("start"), F.lit(False)))
    links = links.withColumn("run", F.max(F.when(F.col("opens"), F.col("start"))).over(ordered))
    links = scratch.cut(links, "links")
    # From anywhere in a run the chain goes through the run's end; a pointer to its middle enters there.
    ends = links.groupBy("file", "run").agg(F.max_by("next", "start").alias("next"))
    entry = links.select(F.col("file"), F.col("start").alias("next"), F.col("run").alias("to"))
    hops = scratch.cut(ends.join(entry, ["file", "next"], "left").select("file", "run", F.col("next").alias("at"), "to"), "hops")
    marked = hops.where("run = 0").select("file", "run", F.lit(0).cast("long").alias("at"))
    jump = hops.where("to is not null")
    k = 0
    while jump.limit(1).count():
        gone = marked.join(jump.withColumnRenamed("at", "enter"), ["file", "run"]).select("file", F.col("to").alias("run"), F.col("enter").alias("at"))
        marked = scratch.cut(marked.union(gone).groupBy("file", "run").agg(F.min("at").alias("at")), f"marked-{k}")
        far = jump.select("file", F.col("run").alias("to"), F.col("at").alias("then"), F.col("to").alias("end"))
        jump = scratch.cut(jump.join(far, ["file", "to"]).select("file", "run", F.col("then").alias("at"), F.col("end").alias("to")), f"jump-{k}")
        k += 1
    return links.join(marked, ["file", "run"]).where("start >= at").select("file", "start")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, record_type, refers_to, payload_bytes, payload_digest) of each record in a folder of WARC files.

    Length and SHA-1 of a stored payload are taken from the payload that was read; a revisit's from
    its header. Magic lines in payloads are content. A file without records gives no rows.
    """
    scratch = Scratch(spark, "warc-read")
    ordered = Window.partitionBy("file").orderBy("start")
    with fixed_splits(spark):
        found = candidates(spark, folder, scratch)
        true = reachable(found, scratch).withColumn("real", F.lit(True))
        # Cuts after a record up to the next one on the chain are its own payload.
        owned = found.join(true, ["file", "start"], "left")
        owned = scratch.cut(owned.withColumn("record", F.max(F.when(F.col("real"), F.col("start"))).over(ordered)), "owned")
        parts = owned.where("real is null").select("file", "record").distinct()
        split = owned.join(parts, ["file", "record"], "left_semi").select("file", "block", "nth", "record", "start", "head_bytes", "content")
        pieces = cuts(spark, folder).join(bounded(scratch.cut(split, "split")), ["file", "block", "nth"])
        # One record's own cuts, put together again.
        whole = pieces.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("start", "body", "head_bytes", "content"))).alias("cuts"))
        raw = F.array_join(F.transform("cuts", lambda x: x["body"]), MAGIC).cast("binary")
        first = F.col("cuts")[0]
        whole = whole.select("file", F.col("record").alias("start"), raw.alias("raw"), first["head_bytes"].alias("h"), first["content"].alias("c"))
        whole = scratch.cut(whole.select("file", "start", F.sha1(F.expr("substring(raw, h + 1, int(c))")).alias("joined")), "whole")
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    out = owned.where("real").join(whole, ["file", "start"], "left")
    stored = F.col("record_type") == "response"
    return out.select(
        page(F.col("id")).alias("page_id"),
        F.when(stored, F.col("content")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(stored, F.coalesce("joined", "sha1")).otherwise(F.regexp_replace("digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        page(F.col("refers")).alias("refers_to"),
    )


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages into the shared folder and read the archives back."""
    folder = Scratch(spark, "warc").path
    write_archives(spark, pages, folder)
    return read_archives(spark, folder)
