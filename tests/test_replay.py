"""Replays, increments and spending, against whole runs and plain walks."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import rules
from folioscope.operators.lexicon import PACKS
from folioscope.plans import increment, replay
from folioscope.streaming import spending


def test_repeated_requests(spark):
    r = np.random.default_rng(0)
    asked = [(f"k{r.integers(0, 9)}" if i % 3 else "hot", i, f"r{i}") for i in range(300)] + [(None, 900, "null")]
    given = [(f"k{r.integers(0, 12)}" if i % 4 else "hot", i, f"a{i}") for i in range(200)] + [(None, 900, "null")]
    got = replay.matched(spark.createDataFrame(asked, "key string, ord int, id string").repartition(4), spark.createDataFrame(given, "key string, ord int, text string")).collect()
    left = {}
    for k, _, t in given:
        left.setdefault(k, []).append(t)
    want = {}
    for k, _, i in asked:
        want[i] = left[k].pop(0) if k is not None and left.get(k) else None
    assert {x.id: x.answer.text if x.answer else None for x in got} == want and all(x.answered == (want[x.id] is not None) for x in got)
    one = spark.range(1).select(replay.request_key(F.lit("a"), F.lit("b"), F.lit("1")).alias("x"), replay.request_key(F.lit("b"), F.lit("a"), F.lit("1")).alias("y")).first()
    assert len(one.x) == 64 and one.x != one.y


def test_known_errors(spark):
    errors = spark.createDataFrame([("a", "b"), ("c", "d"), ("e", "f"), ("g", "h"), ("i", "j")], "target string, replacement string")
    proposals = spark.createDataFrame([(2, "a", "b", True, "prose"), (1, "a", "b", False, "prose"), (3, "c", "d", True, "mechanical"), (4, "e", "other", False, "prose")], "ord int, target string, replacement string, unverified boolean, impact string")
    no = spark.createDataFrame([(2, "e", "voice", "later"), (1, "e", "semantic-trap", "a name goes\nsecond line"), (3, "a", "voice", "x"), (4, "i", "voice", None)], "ord int, target string, guard string, reason string")
    got = {r.target: (r.outcome, r.without_consent) for r in replay.outcomes(errors, proposals, no).collect()}
    assert got == {"a": ("offered", True), "c": ("review-only", True), "e": ("rejected by semantic-trap: a name goes", False), "g": ("missing", False), "i": (None, False)} or got["i"][0] is None


def test_pass_study(spark):
    calls = [("a", 0, "preserved", 1.0), ("a", 1, None, 0.5), ("a", 2, "changed", 1.0), ("a", 3, "preserved", 1.0), ("b", 0, "preserved", 2.0), ("b", 1, "preserved", 2.0), ("b", 2, "preserved", 2.0), ("c", 0, "preserved", 4.0), ("c", 1, "preserved", 4.0), ("d", 0, "changed", 8.0)]
    df = spark.createDataFrame([(*c, 1.0) for c in calls], "key string, ord int, verdict string, cost double, ms double")
    labels = spark.createDataFrame([("a", "harmful"), ("b", "valid"), ("c", None)], "key string, label string")
    assert sorted(map(tuple, replay.pass_study(df, labels).collect())) == [(1, 15.0, 0, 1, 1), (2, 22.5, 0, 0, 1), (3, 25.5, 0, 0, 0)]


BOOK = {
    ("c1", 0): "The colour of the harbour was was grey. Marlow slept.", ("c1", 1): "He likes the colour and the center. “Straight\" he said.", ("c1", 2): "Then Marlow and Marlaw met. Marlow left.", ("c2", 0): "A color, a color; nothing  else.",
    ("c2", 1): "Later Marlow spoke. " + "“Yes,” she said. " * 6, ("c3", 0): "Plain text with no news. Then Marlaw again.", ("c3", 1): "Plain text  two.",
}


def as_frame(spark, book):
    return spark.createDataFrame([(*k, v) for k, v in book.items()], "chapter string, scene int, text string")


@pytest.mark.parametrize(
    ("change", "most"),
    [
        ({("c3", 1): "Plain text  three three."}, 1),  # nothing but itself
        ({("c2", 0): "A colour, a colour; nothing  else.", ("c9", 0): "New centre. New centre.", ("c1", 2): None, ("c3", 0): None}, 6),  # the book's spelling turns, a name goes
        ({("c2", 1): "Later Marlow spoke."}, 6),  # the style of quotation is gone
    ],
)
def test_increment_is_a_whole_run(spark, tmp_path, change, most):
    keys, pack, settings = ["chapter", "scene"], PACKS["en"], rules.Settings()
    last = increment.first_run(as_frame(spark, BOOK), keys, pack, settings, str(tmp_path / "1"))
    book = {k: v for k, v in (BOOK | change).items() if v is not None}
    run, again = increment.next_run(last, as_frame(spark, book), keys, pack, settings, str(tmp_path / "2"))
    whole = increment.first_run(as_frame(spark, book), keys, pack, settings, str(tmp_path / "3"))
    for name in ("hashes", "words", "names", "quotes", "proposals"):
        a, b = getattr(run, name), getattr(whole, name)
        rows = lambda df, cols=sorted(b.columns): sorted((str(r) for r in df.select(*cols).collect()))  # noqa: B008
        assert rows(a) == rows(b), name
    assert again.count() <= most and run.proposals.count() > 3


def journal(seed=0, n=160):
    r = np.random.default_rng(seed)
    rows, at = [], 1_700_000_000_000
    for i in range(n):
        at += int(r.integers(1, 900))
        kind = "limit" if i < 3 else ["reserve", "settle", "odd"][r.choice(3, p=[0.6, 0.37, 0.03])]
        d = f"d{i}" if i < 3 else f"d{r.integers(0, 4)}"
        rows.append((d, i, at, kind, None if kind == "limit" else f"r{r.integers(0, 30)}", {"limit": 900, "reserve": int(r.integers(20, 300)), "settle": int(r.integers(5, 60))}.get(kind)))
    return rows


def by_hand(rows, hold, until=None):
    """Delegations one after the other, with plain lists."""
    out = []
    for d in sorted({r[0] for r in rows}):
        limit, spent, open_ = None, 0, {}

        def expire(t):
            for due, i in sorted((x[1], i) for i, x in open_.items() if hold is not None and x[1] <= t):  # noqa: B023
                del open_[i]  # noqa: B023
                out.append((d, None, i, "released", sum(x[0] for x in open_.values()), spent))  # noqa: B023

        for _, line, at, kind, i, amount in (r for r in rows if r[0] == d):
            expire(at)
            if kind == "limit":
                limit, said = amount, "limit"
            elif kind == "reserve" and i in open_:
                said = "repeated"
            elif kind == "reserve":
                said = "refused" if limit is None or spent + sum(x[0] for x in open_.values()) + amount > limit else "granted"
                if said == "granted":
                    open_[i] = (amount, at + (hold or 0))
            elif kind == "settle":
                said = "settled" if i in open_ else "late"
                open_.pop(i, None)
                spent += amount
            else:
                said = "unknown"
            out.append((d, line, i, said, sum(x[0] for x in open_.values()), spent))
        if until is not None:
            expire(until)
    return sorted(out, key=str)


def test_spending_of_a_whole_journal(spark):
    rows = journal()
    df = spark.createDataFrame(rows, "delegation string, line long, ms long, event string, id string, amount long").select("delegation", "line", F.timestamp_millis("ms").alias("at"), "event", "id", "amount").repartition(5)
    for hold in (None, 4000):
        assert sorted(map(tuple, spending.replayed(df, hold).collect()), key=str) == by_hand(rows, hold)
    assert spending.replayed(df.where("false")).count() == 0


def test_spending_as_a_stream_that_starts_again(spark, tmp_path):
    rows, hold = journal(1), 4000
    files = [rows[:50], rows[50:90], rows[90:]]
    (tmp_path / "log").mkdir()

    def put(i):
        stamp = lambda ms: f"{np.datetime64(ms, 'ms')}Z"
        path = tmp_path / "log" / f"{i}.json"
        path.write_text("\n".join(json.dumps({"delegation": d, "line": n, "at": stamp(at), "event": e, "id": x, "amount": a}) for d, n, at, e, x, a in files[i]))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))

    def run():
        log = spark.readStream.schema(spending.LOG).option("maxFilesPerTrigger", 1).json(str(tmp_path / "log"))
        q = spending.spending(log, hold).writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
        assert q.exception() is None

    put(0)
    put(1)
    run()
    put(2)
    run()  # a new query that goes on from the first one's state
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*spending.COLUMNS).collect()), key=str)
    assert got == by_hand(rows, hold, until=rows[-1][2])
    assert {"granted", "refused", "released", "settled", "late"} <= {r[3] for r in got}
