"""Fingerprints against plain sums over paragraphs, and the edits of neighbours."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from thicket.llm import fingerprints
from thicket.llm.fingerprints import Sums, edited_rows, likeness, likeness_of, sums

TEXT = st.text(alphabet="ab é\n\r", max_size=60)


def of(*texts):
    return sums(pa.array(list(texts), pa.large_string()))


def same(a, b):
    return (a.exact == b.exact).all() and ((a.lanes - b.lanes) % (1 << fingerprints.LANE_BITS) == 0).all()


def plain(text):
    """Sums by paragraph, a gram at a time."""
    exact, lanes = [0] * 4, [0] * fingerprints.LANES
    for part in (text or "").encode().split(b"\n"):
        for k, x in enumerate(np.frombuffer(hashlib.blake2b(part, digest_size=32).digest(), "<u8").tolist()):
            exact[k] = (exact[k] + x) % (1 << 64)
        for gram in [part[k : k + 8] for k in range(len(part) - 7)] or [part] * bool(part):
            h = int(fingerprints.mix(np.array([int.from_bytes(gram, "little") + 1], np.uint64))[0])
            lanes[h % fingerprints.LANES] += 1 - 2 * (h >> 40 & 1)
    return exact, lanes


@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_sums_are_those_of_paragraphs(texts):
    got = of(*texts)
    for k, text in enumerate(texts):
        exact, lanes = plain(text)
        assert got.exact[k].tolist() == exact and got.lanes[k].tolist() == lanes
    back = Sums.read(got.written())
    assert same(back, got) and np.allclose(likeness(back, got), 1)


@given(st.lists(TEXT.filter(lambda t: "\n" not in t), min_size=1, max_size=8), st.randoms())
@settings(max_examples=100, deadline=None)
def test_order_does_not_matter_and_paragraphs_come_and_go(parts, rng):
    turned = parts[:]
    rng.shuffle(turned)
    assert of("\n".join(parts)).written() == of("\n".join(turned)).written()
    assert same(of("\n".join(parts)) + of("new\nlines"), of("\n".join([*parts, "new", "lines"])))
    assert same(of("\n".join([*parts, "gone"])) - of("gone"), of("\n".join(parts)))
    assert of("\n".join([*parts, "x"])).written() != of("\n".join(parts)).written()


def test_likeness_follows_what_texts_share():
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    for share in (0.0, 0.25, 0.5, 0.75, 1.0):
        a = [word() for _ in range(400)]
        b = a[: int(400 * share)] + [word() for _ in range(400 - int(400 * share))]
        assert abs(likeness(of(" ".join(a)), of(" ".join(b)))[0] - share) < 0.3
    assert likeness(of(""), of(None))[0] == 1 and likeness(of(""), of("text"))[0] == 0
    assert likeness_of(of("a b").written(), of("a b").written())[0] == 1


def brute(rows):
    key = lambda r: (r[0] is None, r[0] or 0)
    rows = sorted(((k, t or "") for k, t in rows), key=key)
    out = []
    for at, (doc, text) in enumerate(rows):
        other, q = rows[(at + 1) % len(rows)][1], len(text) // 4
        edited = text[: len(text) - q] + other[:q]
        a, b, c = of(text), of(edited), of(other)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), a.written()[0], b.written()[0], float(likeness(a, b)[0]), float(likeness(a, c)[0])))
    return out


@pytest.mark.parametrize("n", [1, 2, 150])
def test_edits_take_the_next_document(spark, n):
    rng = random.Random(n)
    text = lambda: rng.choice([None, "", "ab", "é" * 9, "\n".join("".join(rng.choices("abc dé", k=rng.randrange(60))) for _ in range(rng.randrange(1, 9)))])
    rows = [(k * k - 50, text()) for k in range(n)]
    if n > 2:
        rows += [(None, "last one of all"), (10**15, "long " * 40_000), (10**15 + 1, rows[3][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS part", "'x' AS place").repartition(3)
    got = [tuple(r) for r in edited_rows(spark, frame, 20_000 * 5).collect()]
    want = brute(rows)
    key = lambda r: (r[0] is None, r[0] or 0)
    for a, b in zip(sorted(got, key=key), want, strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:])


def test_repeated_ids_and_rows(spark):
    """An id with a third of all rows is cut by hash; each text there meets the next one in order of hash, and copies meet each other."""
    rows = [(k, f"one {k} " * 5) for k in range(60)] + [(7, f"other {k} " * 3) for k in range(40)] + [(None, None)] * 3 + [(9, "same text here")] * 4
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in edited_rows(spark, frame, 20_000 * 12).collect()]
    # The order within an id is that of Spark's hash of the text.
    order = [(r.doc_id, r.text) for r in frame.selectExpr("*", "xxhash64(text) AS h").orderBy(frame.doc_id.asc_nulls_last(), "h").collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(order)))
    assert edited_rows(spark, frame.limit(0), 0).count() == 0


def test_fingerprints_keep_every_column(spark):
    frame = spark.createDataFrame([(1, "a", "b"), (2, None, None)], "fingerprint long, text string, row string")
    got = {r.row.fingerprint: (r.row.row, r.fingerprint) for r in fingerprints.fingerprints(frame).collect()}
    assert got == {1: ("b", of("a").written()[0]), 2: (None, of("").written()[0])}
