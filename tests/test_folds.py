"""Folds over keys of any size, the skyline, quotes by anchors, sweeps and orders, against plain walks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioscope.operators import evaluate, events, harness, intervals
from folioscope.plans import review


def greedy_by_hand(rows):
    last, out = {}, []
    for k, s, e, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2], r[3])):
        ok = k not in last or s >= last[k]
        if ok:
            last[k] = e
        out.append((i, ok))
    return sorted(out)


def kept_by_hand(rows):
    done, out = {}, []
    for k, s, e, i in sorted(rows, key=lambda r: r[3]):
        if not any(s < y and e > x for x, y in done.setdefault(k, [])):
            done[k].append((s, e))
            out.append(i)
    return sorted(out)


def spans(n, keys, wide, seed=0):
    r = np.random.default_rng(seed)
    start = r.integers(0, 40 * n // keys, n)
    k = np.where(r.random(n) < 0.6, "hot", [f"k{i}" for i in r.integers(0, keys, n)])
    ends = start + r.integers(0, wide, n)
    return [(None if a == "k1" else str(a), int(s), int(e), int(i)) for a, s, e, i in zip(k, start, ends, r.permutation(n), strict=True)]


@pytest.mark.parametrize("wide", [3, 60, 4000])
def test_spans_of_hot_keys(spark, wide):
    rows = spans(1500, 5, wide, wide)
    df = spark.createDataFrame(rows, "k string, start long, end long, id long").repartition(6)
    for few in (100_000, 300):
        assert sorted((r.id, r.accepted) for r in intervals.schedule(df, ["k"], "id", few).collect()) == greedy_by_hand(rows)
        assert sorted(r.id for r in intervals.first_kept(df, ["k"], "id", few).collect()) == kept_by_hand(rows)
    isles = intervals.islands(df, ["k"], "id").groupBy("k", "island").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    for _, one in isles.toPandas().sort_values("island").groupby("k", dropna=False):
        assert one["island"].tolist() == list(range(len(one))) and (one["a"].to_numpy()[1:] >= one["b"].cummax().to_numpy()[:-1]).all()
    assert intervals.schedule(df.where("false"), ["k"], "id").count() == intervals.first_kept(df.where("false"), ["k"], "id").count() == 0


def test_one_key_of_a_million(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * 3).alias("start"), (F.col("id") * 3 + F.pmod(F.col("id") * 7919, F.lit(11))).alias("end"), "id")
    got = intervals.schedule(df, ["k"], "id")
    last, want = None, 0
    for s, e in zip(np.arange(n) * 3, np.arange(n) * 3 + np.arange(n) * 7919 % 11, strict=True):
        if last is None or s >= last:
            last, want = e, want + 1
    assert got.where("accepted").count() == want
    calls = df.select("k", "id", F.when(F.col("id") % 5 == 4, "ok").alias("verdict"), F.lit(1.0).alias("cost"), F.lit(2.0).alias("ms"))
    row = events.passes(calls, "k", "id").agg(F.count("pass").alias("n"), F.max("pass").alias("last"), F.count_if(F.col("verdict") == "failed").alias("failed"), F.sum("cost").alias("cost")).first()
    assert tuple(row) == (n // 5 * 2, n // 5 * 2 - 1, n // 5, float(n))


def test_passes(spark):
    r = np.random.default_rng(4)
    rows = [(j, i, [None, "ok", "no"][r.choice(3, p=[0.7, 0.2, 0.1])], [None, 0.5, 0.25][r.integers(0, 3)], 1.5) for j in ("a", "b", None) for i in range(60)]
    df = spark.createDataFrame(rows, "job string, ord int, verdict string, cost double, ms double").repartition(4)
    got, split = (sorted(map(tuple, events.passes(df, "job", "ord", few=few).collect()), key=str) for few in (100, 10))
    want = []
    for j in ("a", "b", None):
        cost = ms = n = k = 0
        for _, _, v, c, m in (x for x in rows if x[0] == j):
            cost, ms, n = cost + (c or 0), ms + m, n + 1
            if v or n == 3:
                want.append((j, k, v or "failed", float(cost), ms, n))
                cost = ms = n = 0
                k += 1
    assert got == split == sorted(want, key=str)


@pytest.mark.parametrize("tilt", [0.0, 1.0])
def test_skyline(spark, tilt):
    r = np.random.default_rng(6)
    n = 100_000 if tilt == 0 else 3000
    x = r.integers(0, 400, (n, 3))
    if tilt:  # on a slope many points are as good as any other
        x[:, 2] = 800 - x[:, 0] - x[:, 1]
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "a": x[:, 0], "b": x[:, 1] / 4, "c": x[:, 2]})).repartition(5)
    y = np.unique(x * [-1, -1, 1], axis=0)
    best = [p for p in y if not ((y <= p).all(1) & (y < p).any(1)).any()] if tilt else None
    if not tilt:  # in order of all measures only earlier points can dominate
        best = []
        for p in y[np.lexsort(y.T[::-1])]:
            if not best or not (np.array(best) <= p).all(1).any():
                best.append(p)
    good = {tuple(p) for p in best}
    odd = spark.createDataFrame([(n, None, 1.0, 5), (n + 1, 9999, None, 0)], "id long, a long, b double, c long")
    got = sorted(r.id for r in evaluate.pareto(df.unionByName(odd), ["a", "b"], ["c"]).collect())
    assert got == sorted([i for i in range(n) if tuple(x[i] * [-1, -1, 1]) in good] + [n, n + 1])
    assert evaluate.pareto(df.where("false"), ["a"], ["c"]).count() == 0


def test_many_quotes(spark):
    r = np.random.default_rng(7)
    words = np.array([f"w{i}" for i in range(400)] + ["the", "of"])
    texts = [" ".join(words[r.integers(0, 402, 40)]) + "." for _ in range(300)] + [None, "", "the end, the end"]
    quotes = []
    for i in range(200_000):
        t = texts[r.integers(0, 300)]
        a = r.integers(0, len(t) - 12)
        quotes.append((i, t[a : a + int(r.integers(8, 60))] if i % 4 else f"w{i % 400} w{i % 399} absent{i}"))
    more = [(200_000, "the end"), (200_001, ", the"), (200_002, "xyzzy"), (200_003, None), (200_004, "w1"), (200_005, "end, the e")]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc int, text string").repartition(4)
    df = spark.createDataFrame(pd.DataFrame([*quotes, *more[:3], *more[4:]], columns=["item", "quote"])).unionByName(spark.createDataFrame(more[3:4], "item long, quote string"))
    got = evaluate.located(docs, df.repartition(6), "doc", "item").toPandas()
    some = set(range(0, 200_000, 499)) | {i for i, _ in more}
    want = sorted((d, i, t.find(q)) for i, q in [*quotes, *more] if i in some and q is not None for d, t in enumerate(texts) if t and q in t)
    assert sorted(map(tuple, got[got["item"].isin(some)].itertuples(index=False))) == want
    assert got["item"].nunique() == 150_000 + 4
    assert evaluate.located(docs, df.where("false"), "doc", "item").count() == 0


def test_marks(spark):
    chapters = spark.createDataFrame([("b", "c1", "one two three four. one two"), ("b", "c2", "the owl sat. one more"), ("x", "c1", "the owl sat.")], "book string, chapter string, text string")
    marks = spark.createDataFrame([("b", 1, "two three f"), ("b", 2, "one two"), ("b", 3, "the owl sat"), ("b", 4, "gone"), ("x", 5, "owl"), ("b", 6, "more")], "book string, mark_id int, quote string")
    got = sorted((r.mark_id, r.book, r.chapter, r.start, r.end) for r in review.located_marks(marks, chapters, ["book", "chapter"]).collect())
    assert got == [(1, "b", "c1", 4, 15), (3, "b", "c2", 0, 11), (5, "x", "c1", 4, 7), (6, "b", "c2", 17, 21)]


def test_sweep_and_unnecessary(spark):
    r = np.random.default_rng(8)
    rows = lambda n, wide: [(int(k), int(s), int(s + w), i) for i, (k, s, w) in enumerate(zip(r.integers(0, 4, n), r.integers(0, 300, n), r.integers(0, wide, n), strict=True))]
    edits, a, b = rows(200, 20), rows(30, 15), rows(8, 60)
    frame = lambda x: spark.createDataFrame(x, "scene int, start int, end int, id int").repartition(3)
    over = lambda e, spans: any(e[0] == s[0] and e[1] < s[2] and e[2] > s[1] for s in spans)
    got = {x.id: (x.a, x.b) for x in intervals.covered(frame(edits), {"a": frame(a), "b": frame(b)}, ["scene"], "id").collect()}
    assert got == {e[3]: (over(e, a), over(e, b)) for e in edits}
    good = [(i,) for i in range(0, 200, 3)] * 2
    df = frame(edits).unionByName(spark.createDataFrame([(1, None, None, 900)], "scene int, start int, end int, id int"))
    row = harness.unnecessary(df, spark.createDataFrame(good, "id int"), frame(a), ["scene"], F.col("scene") == 2, 1000).first()
    bad = sum(e[0] == 2 or over(e, a) or e[3] % 3 > 0 for e in edits) + 1
    assert tuple(row) == (bad, sum(e[0] == 2 for e in edits), sum(over(e, a) for e in edits), 1000, bad / 1000)
    assert harness.unnecessary(df.where("false"), spark.createDataFrame(good, "id int"), frame(a), ["scene"], F.lit(False), 0).first().rate == 0.0


def test_book_order(spark):
    r = np.random.default_rng(9)
    rows = [("hot" if i % 9 else "b", f"c{r.integers(0, 6)}", int(r.integers(0, 50)), f"id{i:04}", ["p", "q", "z"][i % 3]) for i in range(2000)]
    places = [(b, f"c{i}", 5 - i) for b in ("hot", "b") for i in range(5)]
    df = spark.createDataFrame(rows, "book string, chapter string, start int, id string, principle string").repartition(5)
    known = spark.createDataFrame([("p", "medium", "12-14"), ("q", None, "3")], "principle string, severity string, pages string")
    got = review.in_book_order(df, spark.createDataFrame(places, "book string, chapter string, rank int"), ["book", "chapter"], "book", known).collect()
    rank = {p[:2]: p[2] for p in places}
    for book in ("hot", "b"):
        want = sorted((x for x in rows if x[0] == book), key=lambda x: (rank.get(x[:2], 0), x[2], x[3]))
        mine = sorted((x for x in got if x.book == book), key=lambda x: x.place)
        assert [x.place for x in mine] == list(range(len(want))) and [x.id for x in mine] == [w[3] for w in want]
    assert {(x.principle, x.severity, x.pages) for x in got} == {("p", "medium", "12-14"), ("q", None, "3"), ("z", None, None)}


def test_window_counters(spark):
    windows = spark.createDataFrame([("a", "s", i) for i in range(4)] + [("b", "s", 0), ("c", "s", 0)], "chapter string, scene string, window int")
    answers = [("a", "s", 0, 0), ("a", "s", 0, 0), ("a", "s", 1, 2), ("a", "s", 1, None), ("a", "s", 2, 0), ("a", "s", 2, None), ("b", "s", 0, 0), ("z", "s", 0, 0)]
    got = review.window_counters(windows, spark.createDataFrame(answers, "chapter string, scene string, window int, edits int"), ["chapter", "scene"], ["chapter"], passes=2)
    assert sorted(map(tuple, got.collect())) == [("a", 4, 1, 2), ("b", 1, 0, 1), ("c", 1, 0, 1)]
