"""Operators on vectors against brute force."""

import hashlib

import numpy as np
import pytest

from folioscope.llm import multi_index, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, score string, tag int"
ODD = [(900, None, 1, "x", 0), (1000, [0.0] * 8, 1, "x", 0), (1001, [0.5, None] * 4, 1, "x", 0), (1002, [float("nan")] * 8, None, "x", 0), (1100, [float("inf")] * 8, 2, "x", 0), (1200, [], 2, "x", 0), (1300, [0.25], None, "x", 0)]


def table(spark, points, odd=ODD):
    rows = [(i, [float(np.float32(x)) for x in p], i % 5 if i % 7 else None, "x", 0) for i, p in enumerate(points)]
    return spark.createDataFrame([*rows, *odd], SCHEMA).repartition(5)


def clustered(n, d=8, seed=0):
    r = np.random.default_rng(seed)
    return r.normal(size=(20, d))[r.integers(0, 20, n)] + 0.3 * r.normal(size=(n, d))


def brute(points, ids, k=10):
    out = {}
    for a in np.flatnonzero(ids % 100 == 0):
        score = multi_index.exact(np.broadcast_to(points[a], points.shape), points)
        order = [b for b in np.lexsort((ids, score)) if b != a][:k]
        out[ids[a]] = [(ids[b], score[b]) for b in order]
    return out


def as_lists(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_all_cells_are_exact(spark):
    points = clustered(801).astype(np.float32).astype(float)
    points[300:600] = points[300]  # a third are copies: ties go to the smaller id
    got = as_lists(multi_index.nearest(table(spark, points), side=4, block=50))
    assert got == brute(points, np.arange(801))


@pytest.mark.parametrize("block", [64, 2048])
def test_walks_reach_their_recall(spark, block):
    points = clustered(4000, seed=1).astype(np.float32).astype(float)
    df = table(spark, points)
    index = multi_index.build(df, asked="id % 100 = 0", side=8, least=100, probes=20, block=block)
    assert index.depth < 4000 and index.recall >= 0.9 and sum(index.counts) == index.rows.count() == 4000
    assert max(r["count"] for r in index.rows.groupBy("bucket").count().collect()) <= 1.6 * block
    want = brute(points, np.arange(4000))
    got = as_lists(multi_index.nearest(df, side=8, least=100, probes=20, block=block))
    hits = [x in want[q] for q in want for x in got[q]]
    assert len(hits) == 400 and np.mean(hits) >= 0.9


def test_walk_orders_pairs():
    r = np.random.default_rng(3)
    a, b, counts = r.random(6), r.random(5), r.integers(0, 4, 30)
    cells = multi_index.walk(a, b, counts, 10**9)
    assert sorted(cells) == np.flatnonzero(counts).tolist()
    summed = (a[:, None] + b).ravel()[cells]
    assert (np.diff(summed) >= 0).all()
    some = multi_index.walk(a, b, counts, 12)
    assert some == cells[: len(some)] and counts[some].sum() >= 12 > counts[some[:-1]].sum()


def test_few_and_no_neighbours(spark):
    assert multi_index.nearest(table(spark, [])).count() == 0
    assert multi_index.nearest(table(spark, [], [])).columns == ["query_id", "rank", "vec_id", "score"]
    got = multi_index.nearest(table(spark, [[1.0] * 8, [2.0] * 8, [1.0] * 8], [*ODD, (0, [4.0] * 8, 0, "x", 0), (None, [1.0] * 8, 0, "x", 0)])).collect()
    assert len(got) == 8  # two rows have the id 0, each with four others
    assert {(r.rank, r.vec_id, r.score) for r in got} >= {(1, 2, 0.0), (2, None, 0.0)}
    one = spark.createDataFrame([(0, [3.0]), (1, [5.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in multi_index.nearest(one).collect()] == [(0, 1, 1, 2.0)]


def plain_codes(ids, x, labels, parts, entries, rounds):
    x = x.reshape(len(x), parts, -1)
    order = np.lexsort((np.arange(len(ids)), ids))[:entries]
    books = [x[order, p].copy() for p in range(parts)]
    for k in range(rounds + 1):
        d = np.stack([((x[:, p, None] - books[p]) ** 2).sum(2) for p in range(parts)], 1)
        near = d.argmin(2)
        for p in range(parts if k < rounds else 0):
            for j in range(len(books[p])):
                if (near[:, p] == j).any():
                    own = x[near[:, p] == j, p]
                    books[p][j] = [int(s) // len(own) for s in own.sum(0)]
    error = d.min(2).sum(1)
    sums = {}
    for lab, e in zip(labels, error, strict=True):
        sums[lab] = sums.get(lab, 0) + int(e)
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    return sorted((int(i), "".join(f"{c:02x}" for c in n), int(e), sums[lab], sha) for i, n, e, lab in zip(ids, near, error, labels, strict=True))


@pytest.mark.parametrize(("n", "entries", "rounds"), [(400, 16, 2), (400, 64, 3), (9, 64, 2), (1, 4, 1)])
def test_codes(spark, n, entries, rounds):
    points = clustered(n, seed=n).astype(np.float32)
    points[n // 3 : n // 2] = points[0]
    codes, books = vector_codes.product_codes(table(spark, points, [o for o in ODD if o[0] != 1000]), label_col="label", parts=4, entries=entries, rounds=rounds)
    got = sorted(map(tuple, vector_codes.with_label_errors(codes, "vec_id", books).collect()))
    x = np.floor(256 * points.astype(float)).astype(np.int64)
    assert got == plain_codes(np.arange(n), x, [i % 5 if i % 7 else None for i in range(n)], 4, entries, rounds)
    near = np.array([r.near for r in codes.orderBy("id").collect()])
    assert [r.error for r in codes.orderBy("id").collect()] == ((x - vector_codes.decoded(near, books)) ** 2).sum(1).tolist()


def test_bounds_spare_scans():
    r = np.random.default_rng(5)
    x = r.integers(-100, 100, (3000, 4))
    old = x[:32].copy()
    state = vector_codes.scanned(x, old)
    total = 0
    for _ in range(6):
        new = old + r.integers(-2, 3, old.shape)
        *state, scans = vector_codes.bounded(x, old, new, *state)
        near, upper, lower = vector_codes.scanned(x, new)
        assert (state[0] == near).all() and (state[1] >= upper - 1e-9).all() and (state[2] <= lower + 1e-9).all()
        old, total = new, total + scans
    assert 0 < total < 6 * 3000 * 0.7


def test_ties_in_codes():
    book = np.array([[0, 0], [4, 0], [4, 0], [2, 3]])
    near, upper, lower = vector_codes.scanned(np.array([[2, 0], [4, 0], [4, 1]]), book)
    assert near.tolist() == [0, 1, 1]
    again = vector_codes.bounded(np.array([[2, 0], [4, 0], [4, 1]]), book, book, near, upper, lower)
    assert again[0].tolist() == [0, 1, 1] and again[3] == 3


def test_odd_tables_of_codes(spark):
    codes, books = vector_codes.product_codes(table(spark, [], []), parts=4)
    assert codes.count() == 0 and books == [] and vector_codes.with_label_errors(codes, "vec_id", books).count() == 0
    again = table(spark, [[0.1] * 8], [(0, [0.2] * 8, None, "x", 1), (None, [-0.3] * 8, None, "x", 1)])
    codes, books = vector_codes.product_codes(again, label_col="label", parts=4)
    assert codes.count() == 3 and {r.error for r in codes.collect()} == {0}
    assert [b.tolist() for b in books] == [[[25, 25], [51, 51], [-77, -77]]] * 4
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.product_codes(again, parts=3)
    with pytest.raises(ValueError, match="64 bits"):
        vector_codes.product_codes(table(spark, [[1e30] * 8]), parts=4)
