"""Toxicity by compression distance.

zstandard trains one dictionary on toxic texts and one on ordinary texts. A window is a word with
the blanks around it; how long it is compressed with either dictionary tells how much it sounds
like either label. Both dictionaries stand behind a common base (trained on ordinary text), so
that what all texts share makes no difference:

  toxic     is trained on the toxic texts' windows that the base hardly shortens;
  ordinary  is trained on the ordinary texts' windows that the toxic one makes shorter than the
            ordinary one so far, in a few rounds over other texts.

Thresholds are calibrated on labelled texts that the dictionaries haven't seen: for each window
length, ordinary length and gain, how much oftener toxic texts have it (a log ratio), and from
which ratio on a window is evidence. A text's evidence is the sum over all its windows, and a
monotone curve makes it a probability.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .attach import attach
from .words import SPACED, Words, blocks, split, text_bytes

THRESHOLD = 0.7
SCORE = "score double, windows long"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Blanks after a window: zstandard looks for no matches in the last bytes of what it compresses.
TAIL = 32
#: Window lengths, ordinary lengths and gains that are told apart; what is over counts as the last.
LENGTHS, GAINS = 32, 17
#: Windows that a task keeps the evidence of.
KNOWN = 1 << 20


@dataclass(frozen=True)
class Training:
    """Bounds of the labelled sample, in texts of either label (whole ones), and how dictionaries are trained. Scoring has no bounds.

    novel: the share of a window's bytes that the base must leave for the toxic dictionary to be
    trained on it. segment and gram are the parameters of zstandard's trainer.
    """

    toxic_texts: int = 3000
    ordinary_texts: int = 5000
    dictionary_bytes: int = 64_000
    rounds: int = 4
    novel: float = 0.8
    segment: int = 16
    gram: int = 6
    level: int = 6


def trained(samples: list[bytes], how: Training, room: int | None = None) -> bytes:
    """A dictionary's content; samples that are too few to train on are the dictionary."""
    room = min(how.dictionary_bytes, how.dictionary_bytes if room is None else room)
    try:
        return zstandard.train_dictionary(room, samples, k=how.segment, d=how.gram).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[max(0, sum(map(len, samples)) - room) :]


def compressor(content: bytes, how: Training) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(level=how.level)
    return zstandard.ZstdCompressor(level=how.level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)


@dataclass
class Windows:
    """The words of some texts, each distinct one once: where it stands (with a blank on either side) and how long that is."""

    data: np.ndarray
    start: np.ndarray
    length: np.ndarray
    #: For each word of the texts: its place among the distinct ones, and its text.
    which: np.ndarray
    text: np.ndarray
    texts: int

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Windows:
        words, end = words_of(data, offsets)
        _, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        return cls(LOWER[data], words.starts[first], end[first] - words.starts[first], which, words.owner(), len(offsets) - 1)

    @classmethod
    def of_texts(cls, texts: list[bytes]) -> Windows:
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        return cls.of(np.frombuffer(b"".join(texts), np.uint8), offsets)

    def sizes(self, *compressors: zstandard.ZstdCompressor) -> list[np.ndarray]:
        return [x[self.which] for x in sizes(self.data, self.start, self.length, compressors)]

    def samples(self, keep: np.ndarray) -> list[bytes]:
        """For each text that has any, the kept words in a row."""
        keep = np.flatnonzero(keep)
        start, end = self.start[self.which[keep]], (self.start + self.length)[self.which[keep]]
        words = [b" " + self.data[a:b].tobytes() + b" " for a, b in zip(start, end, strict=True)]
        edges = np.flatnonzero(np.diff(self.text[keep])) + 1
        joined = [b"".join(words[a:b]) for a, b in zip([0, *edges], [*edges, len(words)], strict=True) if b > a]
        return [x * -(-16 // len(x)) for x in joined]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """The words of a block, and where each ends."""
    words = split(data, offsets, SPACED)
    inside = SPACED.word[data]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:][offsets[1:] > 0] - 1
    last[edges] = inside[edges]
    return words, np.flatnonzero(last) + 1


def sizes(data: np.ndarray, start: np.ndarray, length: np.ndarray, compressors) -> list[np.ndarray]:
    """Each word, with blanks around it, compressed by each compressor: the number of bytes."""
    if not len(start):
        return [np.zeros(0, np.int64) for _ in compressors]
    room = length + 1 + TAIL
    at = np.cumsum(room) - room
    nth = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    padded = np.full(int(room.sum()), 0x20, np.uint8)
    padded[np.repeat(at + 1, length) + nth] = data[np.repeat(start, length) + nth]
    windows = zstandard.BufferWithSegments(padded.tobytes(), np.stack([at, room], axis=1).astype(np.uint64).tobytes())
    return [np.fromiter(map(len, c.multi_compress_to_buffer(windows, threads=0)), np.int64, len(start)) for c in compressors]


@dataclass
class Model:
    base: bytes
    ordinary: bytes
    toxic: bytes
    how: Training
    #: Compressed size of blanks alone.
    blank: int = 0
    #: Evidence of a window by its kind, and what is below the window threshold as 0.
    worth: np.ndarray = field(default_factory=lambda: np.zeros(LENGTHS * LENGTHS * GAINS))
    #: A text's evidence, ascending, and the probability from there on.
    steps: np.ndarray = field(default_factory=lambda: np.zeros(1))
    chance: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        """(ordinary, toxic). Both dictionaries end at one distance from the text, whatever their sizes."""
        room = max(len(self.ordinary), len(self.toxic))
        return [compressor(self.base + own.rjust(room, b"\0"), self.how) for own in (self.ordinary, self.toxic)]

    def kinds(self, length: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        size = np.minimum(length + 2, LENGTHS - 1)
        return (size * LENGTHS + np.clip(ordinary - self.blank, 0, LENGTHS - 1)) * GAINS + np.clip(ordinary - toxic, -1, GAINS - 2) + 1

    def kinds_of(self, windows: Windows, pair: list) -> np.ndarray:
        return self.kinds(windows.length, *sizes(windows.data, windows.start, windows.length, pair))[windows.which]

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return self.chance[np.maximum(np.searchsorted(self.steps, np.round(evidence, 1), "right") - 1, 0)]


class Scorer:
    """A model in a task. The evidence of words seen lately is kept, so that only new words are compressed."""

    def __init__(self, model: Model):
        self.model, self.pair = model, model.compressors()
        self.words, self.worth = np.zeros(0, np.uint64), np.zeros(0)

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text of a block, the sum of its windows' evidence, and how many windows there are."""
        words, end = words_of(data, offsets)
        found, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.words, found), max(0, len(self.words) - 1))
        known = self.words[at] == found if len(self.words) else np.zeros(len(found), bool)
        worth = np.zeros(len(found))
        worth[known] = self.worth[at[known]]
        new = np.flatnonzero(~known)
        start, length = words.starts[first[new]], end[first[new]] - words.starts[first[new]]
        worth[new] = self.model.worth[self.model.kinds(length, *sizes(LOWER[data], start, length, self.pair))]
        if len(self.words) + len(new) > KNOWN:
            self.words, self.worth = found, worth
        else:
            place = np.searchsorted(self.words, found[new])
            self.words, self.worth = np.insert(self.words, place, found[new]), np.insert(self.worth, place, worth[new])
        return np.bincount(words.owner(), worth[which], len(offsets) - 1), words.counts

    def __call__(self, column: pa.Array) -> dict[str, list]:
        data, offsets = text_bytes(column)
        score, windows = [], []
        for at, end in blocks(offsets):
            evidence, count = self.evidence(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
            score += self.model.probability(evidence).tolist()
            windows += count.tolist()
        return {"score": score, "windows": windows}


def without_copies(texts: list[bytes]) -> list[bytes]:
    """Distinct texts, of near copies the first: those of whose runs of three words more than half were there before go."""
    seen: set[int] = set()
    out = []
    for text in sorted(set(texts)):
        words = text.split()
        runs = {zlib.crc32(b" ".join(words[k : k + 3])) for k in range(len(words) - 2)}
        if len(runs & seen) * 2 <= len(runs):
            out.append(text)
        seen |= runs
    return out


def dictionaries(toxic: list[bytes], ordinary: list[bytes], how: Training) -> Model:
    """A model without thresholds. Each round that hardens the ordinary dictionary takes other texts."""
    parts = [ordinary[k :: how.rounds] for k in range(how.rounds)]
    # What the base holds of few texts must be what they share, not these texts.
    model = Model(trained([t[k : k + 128] for t in parts[0] for k in range(0, len(t), 128)], how, sum(map(len, parts[0])) // 16), b"", b"", how)
    base = compressor(model.base, how)
    model.blank = int(sizes(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64), [base])[0][0])
    own = Windows.of_texts(toxic)
    (left,) = own.sizes(base)
    novel = left - model.blank >= how.novel * (own.length + 2)[own.which]
    # Toxic texts of which the base knows every word: all their windows.
    model.toxic = trained(own.samples(novel if novel.any() else np.ones(len(novel), bool)), how)
    for part in parts:
        own = Windows.of_texts(part)
        usual, short = own.sizes(*model.compressors())
        samples = own.samples(usual > short)
        model.ordinary = (trained(samples, how) if samples else b"") + model.ordinary
    return model


def log_ratio(toxic: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """How much oftener toxic texts have each kind of window; none for those that the toxic dictionary doesn't shorten."""
    kinds = LENGTHS * LENGTHS * GAINS
    out = np.log((np.bincount(toxic, minlength=kinds) + 1) / (len(toxic) + 1)) - np.log((np.bincount(ordinary, minlength=kinds) + 1) / (len(ordinary) + 1))
    return np.where(np.arange(kinds) % GAINS > 1, out, 0.0)


def monotone(evidence: np.ndarray, label: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the best non-decreasing curve (pool adjacent violators), with each step's share drawn a little towards the whole's.

    weights: how many labelled texts each one stands for.
    """
    if not len(evidence):
        return np.zeros(1), np.zeros(1)
    x, inverse = np.unique(evidence, return_inverse=True)
    weights = weights * (len(weights) / weights.sum())
    weight, hits = np.bincount(inverse, weights), np.bincount(inverse, weights * label)
    pools: list[list[float]] = []
    for at, w, h in zip(x, weight, hits, strict=True):
        pools.append([at, w, h])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            _, w2, h2 = pools.pop()
            pools[-1][1] += w2
            pools[-1][2] += h2
    base = (weights * label).mean()
    chance = np.array([(h + base) / (w + 1) for _, w, h in pools])
    return np.array([at for at, _, _ in pools]), np.maximum.accumulate(np.clip(chance, 0, 1))


def fit(toxic: list[bytes], ordinary: list[bytes], how: Training = Training(), counts: tuple[int, int] | None = None) -> Model:
    """Half of the texts make the dictionaries, a quarter the windows' evidence, a quarter the curve.

    counts: how many toxic and ordinary texts the two samples stand for, if more than they hold.
    """
    many = counts or (len(toxic), len(ordinary))
    weight = [many[0] / max(1, len(toxic)), many[1] / max(1, len(ordinary))]
    toxic, ordinary = without_copies(toxic), list(ordinary)
    # Sorted texts that look alike stand together; dealt out in turn, each part has some of them.
    model = dictionaries(toxic[::2], ordinary[::2], how)
    pair = model.compressors()
    seen = [Windows.of_texts(texts[1::4]) for texts in (toxic, ordinary)]
    last = [Windows.of_texts(texts[3::4]) for texts in (toxic, ordinary)]
    ratio = log_ratio(*(model.kinds_of(w, pair) for w in seen))
    kinds = [model.kinds_of(w, pair) for w in last]
    label = np.repeat([1.0, 0.0], [w.texts for w in last])
    weights = np.repeat(weight, [w.texts for w in last])
    best = None
    # The window threshold is that with the best curve: the likelihood of the labels.
    for least in np.arange(1.0, 6.0, 0.5):
        worth = np.where(ratio >= least, ratio, 0.0)
        evidence = np.round(np.concatenate([np.bincount(w.text, worth[k], w.texts) for w, k in zip(last, kinds, strict=True)]), 1)
        steps, chance = monotone(evidence, label, weights)
        told = np.clip(chance[np.searchsorted(steps, evidence, "right") - 1], 1e-6, 1 - 1e-6) if len(evidence) else np.zeros(0)
        fits = float((weights * np.where(label == 1, np.log(told), np.log(1 - told))).sum())
        if best is None or fits > best:
            best, model.worth, model.steps, model.chance = fits, worth, steps, chance
    return model


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> Model:
    """A model from labelled rows that aren't held out; the sample is the same on every run. A document with labels of both kinds is toxic."""
    known = labels.select("doc_id", "toxic").where((remainder(F.col("doc_id")) != 1) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))

    def some(toxic: int, most: int) -> list[bytes]:
        ids = known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        # At most so many rows, by the limit.
        rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").where("text is not null")
        return [r["text"].encode() for r in rows.orderBy(F.xxhash64("doc_id", "text"), "text").limit(most).select("text").collect()]

    # Rows with a text of either label, two numbers.
    counts = {r["toxic"]: r["count"] for r in docs.select("doc_id").join(known, "doc_id").groupBy("toxic").count().collect()}
    return fit(some(1, how.toxic_texts), some(0, how.ordinary_texts), how, (counts.get(1, 0), counts.get(0, 0)))


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, carry: list[str], how: Training = Training()) -> DataFrame:
    """(row, found): the carried columns of each document, its score (0 to 1) and how many windows it has.

    Only the text makes the score. A null or empty text has no windows and gets the score of a
    text without evidence. Labels without a text, rows without labels and null labels teach
    nothing; without any labels every score is 0. Repeated rows get equal scores. An empty table
    gives no rows.
    """
    sent = spark.sparkContext.broadcast(train(docs, labels, how))
    return attach(docs, carry, lambda: Scorer(sent.value), SCORE)


def without_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those whose score reaches the threshold."""
    return toxicity(spark, docs, labels, docs.columns).where(F.col("found.score") < threshold).select("row.*")
