"""Conversation turn reassembly: turns that arrive out of order, late and repeatedly leave once each, in order.

Arrivals are grouped by hash buckets, and a bucket is one group of applyInPandasWithState: its
state is two zstd-compressed columnar tables, one of conversations and one of turns that wait. One
tick row for each bucket in every batch brings the batch's number, so that a bucket without
arrivals also closes what has been quiet. A batch is merged in array operations: repeats of kept
turns are dropped (the first one wins), and the gapless run from where a conversation stands is
released.

A conversation may be of any length. It is cut into pages of so many turn numbers, pages are what
buckets hold, and a page is of bounded size. Pages of one conversation must agree on when it is
quiet: where a conversation has more than one page, each batch with arrivals for it also brings an
activity row to each of its pages met so far. A later page releases from its own start; the page
table says afterwards since which batch all pages before it were whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch

ARRIVAL, ACTIVITY, TICK = 0, 1, 2
#: Rows that a bucket gets in all batches, about; fewer buckets than LEAST_BUCKETS don't fill a small cluster.
BUCKET_ROWS = 4096
LEAST_BUCKETS = 16


@dataclass(frozen=True)
class Flow:
    """batches: how many there are (at most 62); quiet: successive ones without arrivals that close a conversation; page: turn numbers a page."""

    batches: int = 10
    quiet: int = 2
    page: int = 1024


ROWS = "bucket int, kind int, conv long, page long, first long, off int, role string, text string, mask long, batch int"
EVENTS = "event string, conv long, page long, first long, turn long, batch int, role string, text string, kept long, top long, breaks long, done int, head string, tail string, waiting array<int>"
PAGES = pa.schema([("conv", pa.int64()), ("page", pa.int64()), ("first", pa.int64()), ("last", pa.int32()), ("closed", pa.int32()), ("done", pa.int32()), ("breaks", pa.int64()), ("role", pa.string()), ("head", pa.string())])
TURNS = pa.schema([("conv", pa.int64()), ("page", pa.int64()), ("off", pa.int32()), ("role", pa.string()), ("text", pa.string())])


def pack(columns: dict[str, np.ndarray], schema: pa.Schema) -> bytes:
    table = pa.table([pa.array(columns[f.name], f.type, from_pandas=True) for f in schema], schema)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(packed: bytes | None, schema: pa.Schema) -> dict[str, np.ndarray]:
    table = pa.ipc.open_stream(packed).read_all() if packed else schema.empty_table()
    return {f.name: table.column(f.name).to_numpy() for f in schema}


def numbered(conv: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each row, the same for the same page, and each number's conversation and page, in order."""
    order = np.lexsort((page, conv))
    conv, page = conv[order], page[order]
    new = np.ones(len(order), bool)
    new[1:] = (conv[1:] != conv[:-1]) | (page[1:] != page[:-1])
    ids = np.empty(len(order), np.int64)
    ids[order] = np.cumsum(new) - 1
    return ids, conv[new], page[new]


def closed_by(mask: np.ndarray, batch: int, quiet: int) -> np.ndarray:
    """The batch that closed a conversation with arrivals in the mask's batches, before the given one, or -1."""
    closed, since, opened = np.full(len(mask), -1), np.zeros(len(mask), np.int64), np.zeros(len(mask), bool)
    for k in range(batch):
        here = (mask >> k & 1).astype(bool)
        since = np.where(here, 0, since + opened)
        opened |= here
        closed = np.where((closed < 0) & (since == quiet), k, closed)
    return closed


def merged(how: Flow, pages: dict, turns: dict, rows: dict, batch: int) -> tuple[dict, dict, list[dict]]:
    """A bucket's tables after one batch, and its events as columns. rows: arrivals (one a turn) and activity."""
    came, told = (np.flatnonzero(rows["kind"] == kind) for kind in (ARRIVAL, ACTIVITY))
    new = {c: rows[c][came] for c in ("conv", "page", "first", "off", "role", "text")}
    ids, conv, page = numbered(*(np.concatenate([pages[c], new[c], rows[c][told], turns[c]]) for c in ("conv", "page")))
    old, mine, active, held = np.split(ids, np.cumsum([len(pages["conv"]), len(came), len(told)]))
    n = len(conv)

    def placed(name: str, fill, kind) -> np.ndarray:
        out = np.full(n, fill, kind)
        out[old] = pages[name]
        return out

    first, known = np.zeros(n, np.int64), np.zeros(n, bool)
    first[mine], first[active] = new["first"], rows["first"][told]
    first[old], known[old] = pages["first"], True
    last, closed, done, breaks = placed("last", -1, np.int64), placed("closed", -1, np.int64), placed("done", 0, np.int64), placed("breaks", 0, np.int64)
    role, head = placed("role", None, object), placed("head", None, object)
    begun = ~known[active]
    closed[active[begun]] = closed_by(rows["mask"][told][begun], batch, how.quiet)
    stirred = np.zeros(n, bool)
    stirred[mine] = stirred[active] = True
    last[stirred & (closed < 0)] = batch
    events = []

    def tell(event: str, of: np.ndarray, **columns) -> None:
        if len(of):
            events.append({"event": np.full(len(of), event), "conv": conv[of], "page": page[of], "first": first[of], "batch": np.full(len(of), batch)} | columns)

    def numbers(of: np.ndarray, off: np.ndarray) -> np.ndarray:
        return first[of] + (page[of] >> 1) * how.page + off

    late = closed[mine] >= 0
    tell("reject", mine[late], turn=numbers(mine[late], new["off"][late]), role=new["role"][late], text=new["text"][late])
    code = held * how.page + turns["off"]
    fresh = ~late & (new["off"] >= done[mine]) & ~np.isin(mine * how.page + new["off"], code)
    code = np.concatenate([code, (mine * how.page + new["off"])[fresh]])
    order = np.argsort(code, kind="stable")
    of, off = np.divmod(code[order], how.page)
    roles, texts = (np.concatenate([turns[c], new[c][fresh]])[order] for c in ("role", "text"))
    starts = np.ones(len(of), bool)
    starts[1:] = of[1:] != of[:-1]
    at = np.arange(len(of))
    rank = at - np.maximum.accumulate(np.where(starts, at, 0)) if len(of) else at

    # What stands without a gap behind what has left.
    run = off - done[of] == rank
    follows = np.zeros(len(of), bool)
    follows[1:] = ~starts[1:] & (off[1:] == off[:-1] + 1) & (roles[1:] == roles[:-1])
    goes_on = starts & run & (done[of] > 0)
    follows[goes_on] = roles[goes_on] == role[of[goes_on]]
    done += np.bincount(of[run], minlength=n)
    breaks += np.bincount(of[run & follows], minlength=n)
    role[of[run]] = roles[run]  # the last one of a page stays
    begins = off == 0
    head[of[begins]] = roles[begins]
    tell("release", of[run], turn=numbers(of[run], off[run]), role=roles[run], text=texts[run])

    of, off, roles, texts, follows = (x[~run] for x in (of, off, roles, texts, follows))
    ends = (closed < 0) & ((batch - last >= how.quiet) | (batch >= how.batches))
    gone = np.flatnonzero(ends)
    if len(gone):
        waits = np.bincount(of, minlength=n)
        edge = np.concatenate([[0], np.cumsum(waits)])
        top = done - 1
        np.maximum.at(top, of, off)
        tail = np.where(done == how.page, role, None)
        final = off == how.page - 1
        tail[of[final]] = roles[final]
        total = breaks + np.bincount(of[follows], minlength=n)
        waiting = np.empty(len(gone), object)
        for k, g in enumerate(gone):
            waiting[k] = off[edge[g] : edge[g + 1]].astype(np.int32)
        tell("close", gone, kept=(done + waits)[gone], top=numbers(gone, top[gone]), breaks=total[gone], done=done[gone], head=head[gone], tail=tail[gone], waiting=waiting)
        closed[gone] = batch
        stay = ~ends[of]
        of, off, roles, texts = (x[stay] for x in (of, off, roles, texts))
    shut = closed >= 0
    role[shut] = head[shut] = None
    kept = {"conv": conv, "page": page, "first": first, "last": last, "closed": closed, "done": done, "breaks": breaks, "role": role, "head": head}
    return kept, {"conv": conv[of], "page": page[of], "off": off, "role": roles, "text": texts}, events


NAMES = [part.split()[0] for part in EVENTS.split(", ")]


def bucket_batch(how: Flow, key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """What applyInPandasWithState runs: a bucket's rows of one batch, in pieces."""
    whole = pd.concat(list(frames), ignore_index=True)
    rows = {c: whole[c].to_numpy() for c in whole.columns}
    pages, turns = state.get if state.exists else (None, None)
    # A start may find several batches waiting, as after a lost driver.
    pages, turns = unpack(pages, PAGES), unpack(turns, TURNS)
    for batch in np.unique(rows["batch"]).tolist():
        pages, turns, events = merged(how, pages, turns, {c: x[rows["batch"] == batch] for c, x in rows.items()}, batch)
        for columns in events:
            n = len(columns["conv"])
            yield pd.DataFrame({c: columns.get(c, np.full(n, None, object)) for c in NAMES})
    state.update((pack(pages, PAGES), pack(turns, TURNS)))


def placed_rows(arrivals: DataFrame, how: Flow, buckets: int) -> DataFrame:
    """Rows for the stream: arrivals, each turn's smallest payload in a batch; activity rows; ticks."""
    null = F.col("conv_id").isNull()
    far = F.col("turn") - F.col("first")
    # The lowest bit of a page's number tells conversation null from 0.
    page = F.floor(far / how.page).cast("long") * 2 + null.cast("long")
    keyed = arrivals.where("turn is not null").withColumns({"conv": F.coalesce(F.col("conv_id").cast("long"), F.lit(0)), "page": page, "off": (far % how.page).cast("int"), "role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    payload = F.concat("role", F.lit("|"), "text")
    least = F.min(F.struct(payload.alias("payload"), F.length("role").alias("cut"))).alias("least")
    turns = keyed.groupBy("batch", "conv", "page", "first", "off").agg(least)
    turns = turns.selectExpr("0 AS kind", "conv", "page", "first", "off", "substring(least.payload, 1, least.cut) AS role", "substring(least.payload, least.cut + 2) AS text", "0L AS mask", "batch")

    narrow = keyed.select("conv", F.col("page").bitwiseAND(1).alias("nul"), "first", "page", "batch")
    tall = narrow.where("page > 1").select("conv", "nul").distinct()
    narrow = narrow.join(tall, ["conv", "nul"], "left_semi").groupBy("conv", "nul", "first", "page").agg(F.bit_or(F.expr("shiftleft(1L, batch)")).alias("seen"))
    whole = narrow.groupBy("conv", "nul").agg(F.bit_or("seen").alias("ever"))
    each = narrow.join(whole, ["conv", "nul"]).withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(how.batches - 1))))
    # Pages met by then, in batches with arrivals for the conversation.
    each = each.withColumn("until", F.expr("shiftleft(2L, batch) - 1")).where("seen & until <> 0 AND shiftright(ever, batch) & 1 = 1")
    activity = each.selectExpr("1 AS kind", "conv", "page", "first", "0 AS off", "'' AS role", "'' AS text", "ever & until AS mask", "batch")

    spark = arrivals.sparkSession
    ticks = spark.range(buckets * (how.batches + 1)).selectExpr(f"int(id % {buckets}) AS bucket", f"{TICK} AS kind", "0L AS conv", "0L AS page", "0L AS first", "0 AS off", "'' AS role", "'' AS text", "0L AS mask", f"int(id div {buckets}) AS batch")
    rows = turns.union(activity).withColumn("bucket", F.pmod(F.xxhash64("conv", "page"), F.lit(buckets)).cast("int"))
    return rows.select(ticks.columns).union(ticks).selectExpr(*(f"CAST({name} AS {kind}) AS {name}" for name, kind in (part.split() for part in ROWS.split(", "))))


def streamed(spark: SparkSession, rows: DataFrame, how: Flow, scratch: Scratch) -> DataFrame:
    """The pages' events. Batches are fed in order to one stateful query, which is started anew for each on one checkpoint."""
    rows.write.partitionBy("batch").parquet(f"{scratch.path}/staged")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(scratch.path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(f"{scratch.path}/fed"))
    for k in range(how.batches + 1):
        files.rename(path(f"{scratch.path}/staged/batch={k}"), path(f"{scratch.path}/fed/batch={k}"))
        fed = spark.readStream.schema(ROWS).parquet(f"{scratch.path}/fed")
        events = fed.groupBy("bucket").applyInPandasWithState(partial(bucket_batch, how), EVENTS, "pages binary, turns binary", "append", "NoTimeout")
        query = events.writeStream.format("parquet").option("path", f"{scratch.path}/events").option("checkpointLocation", f"{scratch.path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    scratch.drop("fed")
    scratch.drop("checkpoint")
    return spark.read.schema(EVENTS).parquet(f"{scratch.path}/events")


CLOSED = "conv long, page long, batch int, digest string, n_missing long, n_breaks long"


def summaries(how: Flow):
    """One row for each conversation from its pages' closing rows, which follow each other in order of page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now = None

        def end() -> None:
            if now:
                conv, page, batch, first, sha, kept, top, breaks, _, _ = now
                out.append((conv, page & 1, batch, sha[0].hexdigest(), top - first + 1 - kept, breaks))

        def batch_out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names=[p.split()[0] for p in CLOSED.split(", ")])
            out.clear()
            return made

        for batch in batches:
            for r in batch.to_pylist():
                if now is None or (now[0], now[1] & 1) != (r["conv"], r["page"] & 1):
                    end()
                    now = [r["conv"], r["page"], r["batch"], r["first"], [hashlib.sha256(), ""], 0, 0, 0, None, None]
                start = r["first"] + (r["page"] >> 1) * how.page
                gone = 0 if r["whole_before"] is None else r["done"]
                left = [*range(gone, r["done"]), *(r["waiting"] if r["waiting"] is not None else [])]
                if left:
                    now[4][0].update((now[4][1] + ",".join(str(start + x) for x in left)).encode())
                    now[4][1] = ","
                now[5] += r["kept"]
                now[6] = max(now[6], r["top"]) if now[8] is not None else r["top"]
                now[7] += r["breaks"] + (now[8] == r["page"] - 2 and r["head"] is not None and r["head"] == now[9])
                now[8], now[9] = r["page"], r["tail"]
            yield batch_out()
        end()
        yield batch_out()

    return run


def reassembled(spark: SparkSession, arrivals: DataFrame, rows: int, how: Flow = Flow()) -> DataFrame:
    """(event, conv_id, turn, batch, role, text, digest, n_missing, n_breaks) of arrivals (conv_id, turn, first long, role, text string, batch int); rows: about how many.

    event: `release` (a turn leaves, once, in the first batch in which all from `first` up to it are
    kept), `reject` (an arrival after its conversation closed), `close` (turn -1; digest: sha256 of
    the kept turns' numbers that never left, comma-joined; n_missing, n_breaks: numbers between
    first and the largest kept turn that aren't kept, and kept turns with the role of the kept turn
    before). batch is the event's. A conversation closes in the last of `quiet` successive batches
    without arrivals for it, or at the end (number `batches`).

    In a batch a turn's smallest payload (role, `|`, text, by bytes) counts, later ones of a kept
    turn are dropped. Rows without turn are dropped; a null role or text is empty; rows without
    conv_id are one conversation, null. Other columns are ignored. No rows: no events.
    """
    scratch = Scratch(spark, "conversations")
    buckets = max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))
    events = streamed(spark, placed_rows(arrivals.select("conv_id", "turn", "first", "role", "text", "batch"), how, buckets), how, scratch)
    of: list[str | Column] = ["conv", F.col("page").bitwiseAND(1).alias("nul")]
    plain = events.where("event <> 'close'").select("event", *of, "page", "first", "turn", "batch", "role", "text")
    closes = events.where("event = 'close'").drop("event", "turn", "role", "text")
    if events.where("page > 1").limit(1).count():
        # Since when all pages before one are whole: a row a page here.
        ends = events.where(f"event = 'release' AND turn = first + (shiftright(page, 1) + 1) * {how.page} - 1").select(*of, F.shiftright("page", 1).alias("place"), "batch")
        along = Window.partitionBy("conv", "nul").orderBy("place")
        chain = ends.withColumns({"k": F.row_number().over(along) - 1, "since": F.max("batch").over(along.rowsBetween(Window.unboundedPreceding, 0))})
        opens = scratch.cut(chain.where("k = place").select("conv", ((F.col("place") + 1) * 2 + F.col("nul")).alias("page"), "since"), "opens")
        begun = plain.where("event = 'reject' OR page < 2")
        later = plain.where("event = 'release' AND page >= 2").join(opens, ["conv", "page"]).withColumn("batch", F.greatest("batch", "since"))
        plain = begun.union(later.select(begun.columns))
        whole = F.when(F.col("page") < 2, -1).otherwise(F.col("since"))
        closes = closes.join(opens, ["conv", "page"], "left").withColumn("whole_before", whole).drop("since")
        closes = closes.withColumn("nul", F.col("page").bitwiseAND(1)).repartition("conv", "nul").sortWithinPartitions("conv", "nul", "page").drop("nul")
    else:
        closes = closes.withColumn("whole_before", F.lit(-1))
    closed = closes.mapInArrow(summaries(how), CLOSED).select(F.lit("close").alias("event"), "conv", F.col("page").alias("nul"), F.lit(-1).cast("long").alias("turn"), "batch", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "digest", "n_missing", "n_breaks")
    empty = F.lit(None).cast("long")
    plain = plain.select("event", "conv", "nul", "turn", "batch", "role", "text", F.lit(None).cast("string").alias("digest"), empty.alias("n_missing"), empty.alias("n_breaks"))
    out = plain.union(closed).withColumn("conv_id", F.when(F.col("nul") == 0, F.col("conv")))
    return out.select("event", "conv_id", "turn", "batch", "role", "text", "digest", "n_missing", "n_breaks")


def dealt(conversations: DataFrame, how: Flow = Flow()) -> DataFrame:
    """Arrivals from a table of turns: each row in a batch by its hash, some again as the user's in another batch, with its conversation's smallest turn.

    h is the number of the first eight hex digits of sha256 of `conv_id:turn` (a null conv_id: empty).
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.col("turn").cast("string")), 256), 1, 8), 16, 10).cast("long")
    rows = conversations.where("turn is not null").select("conv_id", "turn", "role", "text", h.alias("h"))
    first = conversations.groupBy(F.col("conv_id").alias("of")).agg(F.min("turn").alias("first"))
    rows = rows.join(first, rows["conv_id"].eqNullSafe(first["of"]))
    own = F.struct((F.col("h") % how.batches).cast("int").alias("batch"), F.col("role").alias("role"))
    again = F.struct(((F.col("h") + 5) % how.batches).cast("int").alias("batch"), F.lit("user").alias("role"))
    twice = F.explode(F.when(F.col("h") % 7 < 2, F.array(own, again)).otherwise(F.array(own)))
    return rows.select("conv_id", "turn", "first", "text", twice.alias("as")).select("conv_id", "turn", "first", "as.role", "text", "as.batch")
