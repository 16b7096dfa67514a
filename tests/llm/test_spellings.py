"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from thicket.llm import spellings
from thicket.llm.shared import Scratch

DOCS = "doc_id long, text string"


def apart(a, b):
    """Whether one insertion, deletion or replacement makes b of a."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_counts(rows):
    found = Counter()
    for doc, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def plain(words, ratio=10):
    near = {w: [u for u in words if apart(w, u)] for w in words}
    form = {}
    for w, us in near.items():
        best = min(us, key=lambda u: (-words[u], u), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def made(rng, n, stem="abc"):
    """Words that have much in common: shared ends, doubled letters, one edit apart or two."""
    words = set()
    while len(words) < n:
        word = "".join(rng.choices(stem, k=rng.choice([7, 7, 8, 9, 10])))
        words.add(word)
        i = rng.randrange(len(word))
        words |= {w for w in (word[:i] + word[i + 1 :], word[:i] + "é" + word[i:], word[:i] + "x" + word[i + 1 :]) if len(w) >= 7}
    return {w: rng.choice([2, 3, 20, 30, 200, 5000]) for w in sorted(words)}


@pytest.mark.parametrize("block", [20_000, 40])
def test_variants_equal_all_pairs(spark, block):
    """Small blocks split the keys that most words share."""
    words = made(random.Random(block), 500)
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    got = {tuple(r) for r in spellings.variants(spark, frame, block=block).collect()}
    assert got == plain(words)
    assert any(r[1] and r[2] != r[1] for r in got)


def test_each_pair_is_told_once(spark):
    words = made(random.Random(3), 150, "ab")
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: r.n_near for r in spellings.near_words(frame, Scratch(spark, "t")).collect()}
    assert got == {w: sum(apart(w, u) for u in words) for w in words}


def test_words_are_counted_as_they_stand(spark):
    rng = random.Random(4)
    pool = [*made(rng, 60), "ÀÉtendue", "àétendue", "Straßenbahn", "×÷×÷×÷×÷", "short", "SHOUTING", "shouting"]
    rows = [(k, rng.choice(["", " "]).join(rng.choices([*pool, "\n", "1", "_", "Ā"], k=rng.randrange(50)))) for k in range(80)]
    rows += [(None, "shouting letters"), (None, None), (5, ""), (6, "shouting " * 3000), rows[3], rows[3], (7, "x" * 50_000)]
    frame = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS word", "2 AS n").repartition(3)
    counted = spellings.word_counts(frame, spellings.spoilt)
    want = plain_counts(rows)
    assert {r.word: r.n for r in counted.collect()} == want and len(want) > 20
    assert {tuple(r) for r in spellings.variants(spark, counted).collect()} == plain(want)
    assert {r.word for r in spellings.word_counts(frame).collect()} != set(want)


def test_no_words(spark):
    empty = spark.createDataFrame([], DOCS)
    assert spellings.variants(spark, spellings.word_counts(empty)).count() == 0
