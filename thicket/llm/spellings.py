"""Grouping spelling variants: words one edit apart, found by Aho-Corasick over halves of words.

One edit leaves one half of a word whole, at the start or at the end of its variant. Automaton
shards hold both halves of every word; all words are scanned, and a hit counts where a first half
stands at the start, or a second half at the end, of a word whose length allows it. The distance is
then verified through tables of the held words' other halves with one place blotted or left out, so
a half that very many words share isn't compared with all of them.

A shard holds the words of some keys (a side and the three letters at that end, which every half
there has in full) and scans just the words with those keys: nothing else could hit. A key with more words than
a block is cut into blocks, and each pair of blocks is a shard of its own.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, bounded
from .words import batch_of

RUN = re.compile("[a-zÀ-ÿ]+")
#: A misspelling is made in a run whose hash this divides.
SPOILT = 31
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A word's form is so many times as frequent as the word.
FORM_RATIO = 10
KEY = 3
#: Words that a shard's automaton holds; distinct words that a counting task holds.
BLOCK_WORDS, HELD_WORDS = 20_000, 300_000


def spoilt(doc_id: int | None, run: str) -> str:
    """The run as the table's noise has it: without one code point if its hash says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % SPOILT:
        return run
    place = h % len(run)
    return run[:place] + run[place + 1 :]


def as_is(doc_id: int | None, run: str) -> str:
    return run


def word_counts(docs: DataFrame, change: Callable[[int | None, str], str] = as_is, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): lower-cased (A-Z) runs of letters in docs (doc_id long, text string), changed, of some length and number of occurrences.

    A null text has no words. Rows are counted as they stand, repeated ones too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = batch_of(["word", "n"], [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())])
            found.clear()
            return made

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                # Bytes are lower-cased, so that only A-Z are.
                own = Counter(RUN.findall(text.as_buffer().to_pybytes().lower().decode())) if text.is_valid else {}
                for word, n in own.items():
                    if len(word) >= least_length:
                        word = change(doc, word)
                        if len(word) >= least_length:
                            found[word] += n
                if len(found) > HELD_WORDS:
                    yield out()
        yield out()

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


FIRST, SECOND = 0, 1
BOTH, HELD, SCANNED = 0, 1, 2


def less(word: str, at: int, stop: int) -> list[str]:
    """The different words that leaving out one place of [at, stop) gives."""
    return [word[:i] + word[i + 1 :] for i in range(at, stop) if i == at or word[i] != word[i - 1]]


def blotted(word: str, at: int, stop: int) -> list[str]:
    return [f"{word[:i]}\0{word[i + 1 :]}" for i in range(at, stop)]


class Shard:
    """An automaton of halves, and what verifies its hits. Held words and scanned ones are told by side."""

    def __init__(self, held: list[tuple[int, str, int]]):
        self.n: tuple[dict, dict] = {}, {}
        self.blots: tuple[dict, dict] = defaultdict(list), defaultdict(list)
        self.shorter: tuple[dict, dict] = defaultdict(list), defaultdict(list)
        lengths: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for side, word, n in held:
            half = len(word) // 2
            # The side says which half is whole; the other one has the edit.
            whole, edited = (word[:half], (half, len(word))) if side == FIRST else (word[half:], (0, half))
            lengths[whole][side] |= 1 << len(word)
            self.n[side][word] = n
            for key in blotted(word, *edited):
                self.blots[side][key].append(word)
            for key in less(word, *edited):
                self.shorter[side][key].append(word)
        self.automaton = ahocorasick.Automaton()
        for half, of in lengths.items():
            self.automaton.add_word(half, (len(half), *of))
        if lengths:
            self.automaton.make_automaton()

    def near(self, side: int, word: str) -> list[str]:
        """Held words one edit apart, with the side's half whole. A pair with the first half whole isn't told by the second one again."""
        size, out = len(word), []
        for end, (length, *of) in self.automaton.iter(word) if len(self.automaton) else ():
            if end != (length if side == FIRST else size) - 1 or not of[side] >> (size - 1) & 7:
                continue
            for other in (size - 1, size, size + 1):
                half = other // 2
                if not of[side] >> other & 1 or length != (half if side == FIRST else other - half):
                    continue
                if other == size:
                    edited = (half, size) if side == FIRST else (0, half)
                    found = [w for key in blotted(word, *edited) for w in self.blots[side].get(key, ()) if w != word]
                elif other < size:
                    edited = (half, size) if side == FIRST else (0, half + 1)
                    found = [w for w in less(word, *edited) if w in self.n[side]]
                else:
                    found = self.shorter[side].get(word, ())
                out += found if side == FIRST else [w for w in found if w[:half] != word[:half]]
        return out


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, n_near, form_n, form) of each scanned row: how many held words are near, and the most frequent of them."""
    shard, now, held = None, None, []
    names = ["word", "n", "n_near", "form_n", "form"]

    def told(rows: list[tuple[int, str, int]]) -> pa.RecordBatch:
        columns: list[list] = [[], [], [], [], []]
        for side, word, n in rows:
            near = shard.near(side, word)
            best = min(((-shard.n[side][w], w) for w in near), default=(None, None))
            for column, value in zip(columns, (word, n, len(near), best[0] and -best[0], best[1]), strict=True):
                column.append(value)
        return batch_of(names, [pa.array(c, pa.string() if name in ("word", "form") else pa.int64()) for name, c in zip(names, columns, strict=True)])

    def built() -> pa.RecordBatch:
        nonlocal shard
        shard = Shard([row[1:] for row in held])
        return told([row[1:] for row in held if row[0] == BOTH])

    for batch in batches:
        scans = []
        for unit, kind, side, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if unit != now:
                if scans:
                    yield told(scans)
                    scans = []
                if held:
                    yield built()
                now, held, shard = unit, [], None
            if kind != SCANNED:
                held.append((kind, side, word, n))
                continue
            # Held rows of a unit come first.
            if held:
                yield built()
                held = []
            scans.append((side, word, n))
        if scans:
            yield told(scans)
    if held:
        yield built()


def near_words(words: DataFrame, scratch: Scratch, block: int = BLOCK_WORDS) -> DataFrame:
    """(word, n, n_near, form_n, form) of each of words (word, n): near words and the most frequent of them (ties: the smallest)."""
    ends = F.array(F.struct(F.lit(FIRST).alias("side"), F.left("word", F.lit(KEY)).alias("end")), F.struct(F.lit(SECOND).alias("side"), F.right("word", F.lit(KEY)).alias("end")))
    keyed = words.select("word", "n", F.explode(ends).alias("key")).select("word", "n", "key.side", "key.end")
    # A row a key: at most the alphabet to the third power, twice.
    counts = keyed.groupBy("side", "end").agg(F.count("*").alias("size"))
    shards = max(1, -(-2 * words.count() // block))
    placed = keyed.join(bounded(scratch.cut(counts, "keys")), ["side", "end"]).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    small = F.concat(F.lit("s"), F.pmod(F.xxhash64("side", "end"), F.lit(shards)).cast("string"))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    name = lambda a, b: F.concat_ws(":", F.lit("b"), F.col("side").cast("string"), "end", a.cast("string"), b.cast("string"))
    row = lambda unit, kind: F.struct(unit.alias("unit"), kind.cast("int").alias("kind"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != own)
    many = F.flatten(F.array(F.array(row(name(own, own), F.lit(BOTH))), F.transform(others, lambda x: row(name(own, x), F.lit(HELD))), F.transform(others, lambda x: row(name(x, own), F.lit(SCANNED)))))
    dealt = placed.select("side", "word", "n", F.explode(F.when(F.col("blocks") == 1, F.array(row(small, F.lit(BOTH)))).otherwise(many)).alias("as")).select("as.unit", "as.kind", "side", "word", "n")
    found = dealt.repartition("unit").sortWithinPartitions("unit", "kind").mapInArrow(scanned, "word string, n long, n_near long, form_n long, form string")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))).alias("best")
    out = found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best)
    return out.select("word", "n", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def variants(spark: SparkSession, words: DataFrame, ratio: int = FORM_RATIO, block: int = BLOCK_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each of words (word string, n long; a word once).

    Near words are one inserted, deleted or replaced code point apart. form: the near word of
    largest n (ties: the smallest in code-point order) if its n is at least `ratio` times the word's;
    root: where forms lead to, the word itself if it has none. No words: no rows. n grows along
    forms by the ratio, so there are no rings, and a few rounds of joins follow all chains.
    """
    scratch = Scratch(spark, "spellings")
    near = near_words(scratch.cut(words, "words"), scratch, block)
    fits = F.col("form_n") >= ratio * F.col("n")
    near = scratch.cut(near.select("word", F.when(fits, F.col("form")).alias("form"), "n", "n_near", F.when(fits, F.col("form_n")).alias("form_n")), "near")
    roots = scratch.cut(near.where("form is not null").select("word", F.col("form").alias("root")), "roots-0")
    k = 0
    while True:
        onward = roots.join(roots.toDF("at", "on"), F.col("root") == F.col("at"), "left")
        k += 1
        roots = scratch.cut(onward.select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), f"roots-{k}")
        if not roots.where("moved").limit(1).count():
            break
        roots = roots.drop("moved")
    out = near.join(roots.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
