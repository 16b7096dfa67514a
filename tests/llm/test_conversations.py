"""Turn reassembly against a plain one, with conversations of several pages."""

import hashlib
import random

import pytest

from thicket.llm import conversations
from thicket.llm.conversations import Flow

TABLE = "conv_id long, turn long, role string, text string"


def plain(rows, how):
    """Events of (conv_id, turn, role, text, batch), one arrival after the other."""
    first, mail = {}, {}
    for conv, turn, role, text, batch in rows:
        if turn is not None:
            first[conv] = min(first.get(conv, turn), turn)
            own = mail.setdefault((batch, conv), {})
            new = (f"{role or ''}|{text or ''}".encode(), role or "")
            own[turn] = min(own.get(turn, new), new)
    out, last, closed, kept, left = [], {}, {}, {}, {}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for batch in range(how.batches + 1):
        for conv in first:
            for turn, (payload, role) in sorted(mail.get((batch, conv), {}).items()):
                if conv in closed:
                    out.append(("reject", conv, turn, batch, sha(payload), None, None))
                    continue
                last[conv] = batch
                kept.setdefault(conv, {}).setdefault(turn, (payload, role))
            if conv in closed or conv not in last:
                continue
            at = left.get(conv, first[conv])
            while at in kept[conv]:
                out.append(("release", conv, at, batch, sha(kept[conv][at][0]), None, None))
                at += 1
            left[conv] = at
            if batch - last[conv] >= how.quiet or batch == how.batches:
                closed[conv] = batch
                waits = ",".join(str(t) for t in sorted(kept[conv]) if t >= at)
                breaks = sum(t - 1 in kept[conv] and kept[conv][t - 1][1] == r for t, (_, r) in kept[conv].items())
                out.append(("close", conv, -1, batch, sha(waits.encode()), max(kept[conv]) - first[conv] + 1 - len(kept[conv]), breaks))
    return sorted(out, key=str)


def digested(row):
    sha = row.digest if row.event == "close" else hashlib.sha256(f"{row.role}|{row.text}".encode()).hexdigest()
    return row.event, row.conv_id, row.turn, row.batch, sha, row.n_missing, row.n_breaks


def run(spark, rows, how):
    table = spark.createDataFrame([r[:4] for r in rows], TABLE).repartition(3)
    arrivals = conversations.dealt(table, how).cache()
    want = plain([(r.conv_id, r.turn, r.role, r.text, r.batch) for r in arrivals.collect()], how)
    got = sorted((digested(r) for r in conversations.reassembled(spark, arrivals, len(rows), how).collect()), key=str)
    return got, want


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for conv in range(40):
        start = rng.choice([0, 0, 3, -7, 10**12])
        for turn in range(start, start + rng.choice([1, 2, 8, 8, 30])):
            if rng.random() < 0.95:
                out.append((conv, turn, rng.choice(["user", "assistant", "a|b", None]), rng.choice([None, "", "text", f"t {turn}", "é|ü"])))
    out += [(None, t, "user", f"none {t}") for t in range(6)] + [(0, None, "user", "dropped"), (None, None, None, None)]
    out += rng.choices(out, k=30) + [(3, 0, "user", "x" * 20_000), (41, 5, None, None)]
    return [(*r, None) for r in out]


@pytest.mark.parametrize("how", [Flow(), Flow(batches=6, quiet=1, page=4)])
def test_turns_leave_once_and_in_order(spark, rows, how):
    got, want = run(spark, rows, how)
    assert got == want
    assert {r[0] for r in got} == {"release", "reject", "close"}


def test_no_turns(spark):
    assert run(spark, [], Flow(batches=2)) == ([], [])


def test_one_conversation_holds_most_rows(spark):
    """Its pages lie in several buckets, and their releases wait for the pages before."""
    rng = random.Random(7)
    rows = [(1, t, "user" if t % 2 else "assistant", f"turn {t}", None) for t in range(300)] + [(2, t, "user", "x", None) for t in range(5)]
    rng.shuffle(rows)
    got, want = run(spark, rows, Flow(batches=4, page=16))
    assert got == want and len({r[3] for r in got if r[0] == "release" and r[1] == 1}) > 0


def test_columns_with_other_names_do_no_harm(spark, rows):
    table = spark.createDataFrame([r[:4] for r in rows[:40]], TABLE)
    plain_events = conversations.reassembled(spark, conversations.dealt(table, Flow(batches=2)), 40, Flow(batches=2))
    extra = conversations.dealt(table, Flow(batches=2)).selectExpr("*", "1 AS page", "'q' AS bucket", "2 AS off", "3 AS kind")
    assert sorted(map(str, plain_events.collect())) == sorted(map(str, conversations.reassembled(spark, extra, 40, Flow(batches=2)).collect()))
