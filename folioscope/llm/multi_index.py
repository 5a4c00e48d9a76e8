"""Approximate nearest neighbours: an inverted multi-index.

A vector's two halves are quantised separately, with ``side`` centroids each, so the rows are listed under side x side
cells although a row is compared with 2 x side centroids only. A query ranks the centroids of either half by distance
and walks pairs of them by summed distance with a heap, until the cells it has passed list ``depth`` rows. These are
reranked by their true distance, in double precision.

Centroids are fitted on a bounded sample (``sample`` rows by hash); every row is listed. How deep a query walks isn't
guessed: for up to ``probes`` queries the true neighbours are found among all rows in one pass, the place of each in
its query's walk is looked up, and ``depth`` is the least number of rows that brings ``recall`` of them. Vectors that
lie in groups need a small part of the table; where there is no structure, the walk is as long as it has to be.

Cells are laid out in buckets of at most ``block`` rows: small cells share one, a cell of many rows has several. What
visits a bucket comes in portions of at most about ``block`` queries, so that no task holds more than two such blocks,
whatever share of all rows one cell has.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import materialize, ship, small, table
from folioscope.llm.vectors import matrix, squared, taking_part

PAIRS = 1 << 17


@dataclass
class MultiIndex:
    rows: DataFrame  #: tag, id, v, cell, bucket
    d: int
    centroids: list[np.ndarray]
    counts: np.ndarray  #: rows of each cell
    first: np.ndarray  #: first bucket of each cell
    blocks: np.ndarray  #: how many buckets it has
    depth: int
    recall: float  #: of the probes' true neighbours, at this depth
    block: int


def lloyd(points: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """At most ``k`` centroids of a sample that fits into the driver."""
    rng = np.random.default_rng(seed)
    centroids = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds if points.shape[1] else 0):
        near = squared(points, centroids).argmin(1)
        n = np.bincount(near, minlength=len(centroids))
        sums = np.stack([np.bincount(near, c, len(centroids)) for c in points.T], 1)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def walk(a: np.ndarray, b: np.ndarray, counts: np.ndarray, depth: int) -> list[int]:
    """Cells in order of summed distance until they list ``depth`` rows; empty ones are passed over.

    ``a`` and ``b`` are the distances of a query's halves to the centroids of either side.
    """
    oa, ob = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
    da, db, width, listed = a[oa].tolist(), b[ob].tolist(), len(b), counts.tolist()
    heap, out, held = [(da[0] + db[0], 0, 0)], [], 0
    while heap and held < depth:
        _, i, j = heapq.heappop(heap)
        cell = oa[i] * width + ob[j]
        if listed[cell]:
            out.append(cell)
            held += listed[cell]
        if j + 1 < width:
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
    return out


def _sampled(rows: DataFrame, n: int, most: int, seed: int) -> DataFrame:
    """About ``most`` rows of ``n`` by a hash of their tags, never more than twice as many."""
    share = min(1.0, 1.5 * most / max(n, 1))
    picked = rows if share == 1 else rows.where(F.expr(f"pmod(xxhash64(tag, {seed}), 1000000007L) < {int(share * 1000000007)}L"))
    return picked.limit(2 * most)


def _assigned(rows: DataFrame, d: int, centroids: list[np.ndarray]) -> DataFrame:
    half, width = d // 2, len(centroids[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column("v"), d)
            cell = squared(v[:, :half], centroids[0]).argmin(1) * width + squared(v[:, half:], centroids[1]).argmin(1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("tag", "id", "v")), pa.array(cell, pa.int32())], ["tag", "id", "v", "cell"])

    return rows.select("tag", "id", "v").mapInArrow(run, f"tag long, id {rows.schema['id'].dataType.simpleString()}, v array<double>, cell int")


def _true_cells(rows: DataFrame, probes: np.ndarray, tags: np.ndarray, d: int, k: int) -> list[tuple[int, int]]:
    """(probe, cell) of the true neighbours of a bounded number of probes, among all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, cells = np.empty((len(probes), 0)), np.empty((len(probes), 0), np.int32)
        for b in batches:
            near = squared(probes, matrix(b.column("v"), d))
            near[tags[:, None] == b.column("tag").to_numpy()[None, :]] = np.inf
            best = np.concatenate([best, near], 1)
            cells = np.concatenate([cells, np.broadcast_to(b.column("cell").to_numpy(), near.shape)], 1)
            if best.shape[1] > k:
                at = np.argpartition(best, k, 1)[:, :k]
                best, cells = np.take_along_axis(best, at, 1), np.take_along_axis(cells, at, 1)
        probe, ok = np.repeat(np.arange(len(probes)), best.shape[1]), np.isfinite(best.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (probe, best.ravel(), cells.ravel())], ["probe", "near", "cell"])

    found = rows.select("tag", "v", "cell").mapInArrow(run, "probe long, near double, cell int")
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("probe").orderBy("near", "cell"))).where(F.col("r") <= k)
    return [(r.probe, r.cell) for r in found.collect()]


def build(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", asked: str = "true", k: int = 10, recall: float = 0.95,
    side: int | None = None, sample: int = 16384, probes: int = 256, least: int = 4096, block: int = 2048,
) -> MultiIndex | None:
    """Lists every row that takes part; None if none does.

    Null and zero vectors, those that hold null or non-finite components and those of another length than most take no
    part. ``asked`` is the condition on ``id`` of the rows that will be queries: the probes are drawn from them. Fewer than
    ``least`` rows are never visited by a query if there are as many.
    """
    ship(vectors.sparkSession)
    rows, d = taking_part(vectors, id_col, vector_col, zero=False)
    n = rows.count()
    if not n:
        return None
    side = side or min(128, max(4, 1 << int(np.log2(np.sqrt(n) / 6 + 1))))
    points = np.array([r.v for r in _sampled(rows, n, sample, 1).select("v").collect()])
    centroids = [lloyd(points[:, : d // 2], side), lloyd(points[:, d // 2 :], side)]
    index = materialize(_assigned(rows, d, centroids), "multi-index")
    counts = np.zeros(len(centroids[0]) * len(centroids[1]), np.int64)
    for r in index.groupBy("cell").count().collect():
        counts[r.cell] = r["count"]

    queries = rows.where(asked)
    drawn = _sampled(queries, queries.count(), probes, 2).select("tag", "v").collect()
    depth, got = n, 1.0
    if drawn and n > least:
        tags, asks = np.array([r.tag for r in drawn]), np.array([r.v for r in drawn])
        near = [squared(asks[:, : d // 2], centroids[0]), squared(asks[:, d // 2 :], centroids[1])]
        places = []
        for probe, cell in _true_cells(index, asks, tags, d, k):
            summed = (near[0][probe][:, None] + near[1][probe]).ravel()
            places.append(int(counts[summed <= summed[cell]].sum()))
        places.sort()
        depth = min(n, max(least, places[min(len(places) - 1, int(recall * len(places)))] if places else n))
        got = sum(p <= depth for p in places) / max(len(places), 1)

    first, blocks = np.zeros(len(counts), np.int64), np.maximum(1, -(-counts // block))
    bucket, room = 0, block
    for cell, c in enumerate(counts.tolist()):
        if c > room:
            bucket, room = bucket + (room < block), block
        first[cell] = bucket
        bucket, room = (bucket + int(blocks[cell]), block) if c > block else (bucket, room - c)
    laid = vectors.sparkSession.createDataFrame([(i, int(f), int(b)) for i, (f, b) in enumerate(zip(first, blocks, strict=True)) if counts[i]], "cell int, first long, blocks long")
    at = F.col("first") + F.pmod(F.xxhash64("tag"), F.col("blocks"))
    placed = index.join(F.broadcast(laid), "cell").select("tag", "id", "v", "cell", at.alias("bucket"))
    return MultiIndex(placed, d, centroids, counts, first, blocks, depth, got, block)


def _visits(asked: DataFrame, x: MultiIndex) -> DataFrame:
    """(bucket, tag, id, v, cells) for each query and each bucket that holds cells of its walk."""
    d, half, centroids, counts, first, blocks, depth = x.d, x.d // 2, x.centroids, x.counts, x.first, x.blocks, x.depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column("v"), d)
            a, z = squared(v[:, :half], centroids[0]), squared(v[:, half:], centroids[1])
            for i in range(b.num_rows):
                cells = np.array(walk(a[i], z[i], counts, depth))
                n = blocks[cells]
                bucket = np.repeat(first[cells], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                cells = np.repeat(cells, n)
                order = np.lexsort((cells, bucket))
                own, starts = np.unique(bucket[order], return_index=True)
                lists = pa.ListArray.from_arrays(pa.array([*starts, len(order)], pa.int32()), pa.array(cells[order], pa.int32()))
                again = pa.array(np.full(len(own), i), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *(b.column(c).take(again) for c in ("tag", "id", "v")), lists], ["bucket", "tag", "id", "v", "cells"])

    return asked.select("tag", "id", "v").mapInArrow(run, f"bucket long, tag long, id {asked.schema['id'].dataType.simpleString()}, v array<double>, cells array<int>")


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of pairs of rows; components are added one after the other."""
    total = np.zeros(len(q))
    for i in range(q.shape[1]):
        total += (q[:, i] - x[:, i]) ** 2
    return np.sqrt(total)


def _reranked(rows: pa.Table, asks: pa.Table, d: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance): the ``k`` nearest rows and more, of those in the cells that each query visits."""
    x, q = matrix(rows["v"], d), matrix(asks["v"], d)
    cells, at = np.unique(rows["cell"].to_numpy(), return_inverse=True)
    lists = asks["cells"].combine_chunks()
    who, what = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
    seen = np.zeros((len(q), len(cells) + 1), bool)
    found = np.minimum(np.searchsorted(cells, what), len(cells) - 1)
    seen[who, np.where(cells[found] == what, found, len(cells))] = True
    near = squared(q, x)
    near[~seen[:, at]] = np.inf
    near[asks["tag"].to_numpy()[:, None] == rows["tag"].to_numpy()] = np.inf
    bound = np.partition(near, k - 1, 1)[:, k - 1] if len(x) > k else np.full(len(q), np.inf)
    slack = 1e-11 * ((q * q).sum(1) + (x * x).sum(1).max(initial=0))
    a, b = np.nonzero((near <= (bound + slack)[:, None]) & np.isfinite(near))
    score = np.concatenate([np.empty(0), *(exact(q[a[i : i + PAIRS]], x[b[i : i + PAIRS]]) for i in range(0, len(a), PAIRS))])
    return a, b, score


def search(x: MultiIndex, asked: DataFrame, k: int = 10) -> DataFrame:
    """(q_tag, query_id, rank from 1, id, score) of each row (tag, id, v) of ``asked``; the row of the same tag isn't its own
    neighbour. Nearest first, ties to the smaller id (nulls last), then to the order of rows."""
    d, kind = x.d, x.rows.schema["id"].dataType.simpleString()

    def rerank(rows: pa.Table, asks: pa.Table) -> pa.Table:
        a, b, score = _reranked(rows, asks, d, k) if rows.num_rows and asks.num_rows else (np.empty(0, int), np.empty(0, int), np.empty(0))
        ids, tags = pc.rank(rows["id"], null_placement="at_end", tiebreaker="dense").to_numpy(), rows["tag"].to_numpy()
        order = np.lexsort((tags[b], ids[b], score, a))
        a, b, score = a[order], b[order], score[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        a, b, score = (z[place < k] for z in (a, b, score))
        take = lambda t, c, i: t[c].combine_chunks().take(pa.array(i, pa.int64()))
        return pa.table({"q_tag": take(asks, "tag", a), "query_id": take(asks, "id", a), "tag": take(rows, "tag", b), "id": take(rows, "id", b), "score": pa.array(score)})

    visits = materialize(_visits(asked, x), "multi-index-visits")
    portions = materialize(visits.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / x.block).alias("portions")), "multi-index-portions")
    asks = visits.join(small(portions), "bucket").select(F.col("bucket").alias("at"), F.pmod(F.xxhash64("tag"), F.col("portions")).alias("part"), "tag", "id", "v", "cells")
    rows = x.rows.join(small(portions.toDF("b", "n")), F.col("bucket") == F.col("b"))
    rows = rows.select("bucket", F.explode(F.expr("sequence(0L, n - 1)")).alias("portion"), "tag", "id", "v", "cell")
    found = rows.groupBy("bucket", "portion").cogroup(asks.groupBy("at", "part"))
    found = found.applyInArrow(rerank, f"q_tag long, query_id {kind}, tag long, id {kind}, score double")
    order = Window.partitionBy("q_tag").orderBy("score", F.col("id").asc_nulls_last(), "tag")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q_tag", "query_id", "rank", "id", "score")


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", asked: str = "id % 100 = 0", k: int = 10, **how) -> DataFrame:
    """(query_id, rank, id_col, score): the ``k`` nearest other rows of every row that meets ``asked``, a condition on ``id``.

    Fewer than ``k`` rows are returned where there are fewer others. Repeated ids are rows of their own, both as queries and
    as neighbours; a null id is a neighbour like any other. An empty table, or one without usable vectors, gives no rows.
    Other columns are ignored, whatever their names.
    """
    index = build(vectors, id_col, vector_col, asked, k, **how)
    if index is None:
        kind = vectors.schema[id_col].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, `{id_col}` {kind}, score double")
    found = search(index, index.rows.where(asked), k)
    return found.select("query_id", "rank", F.col("id").alias(id_col), "score")


def op11(spark, sf_dir: str) -> DataFrame:
    """Query op11_multi_index: every row of ``embeddings`` whose id is divisible by 100, against all rows."""
    return nearest(table(spark, sf_dir, "embeddings"))


#: The neighbours as such. The index finds all of them while a query's walk covers the table (4,096 rows), and 0.9 beyond.
OP11_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS tag, vec_id, CAST(embedding AS DOUBLE[]) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT q.tag, q.vec_id AS query_id, e.vec_id, sqrt(list_sum(list_transform(list_zip(q.v, e.v), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS score
  FROM e AS q JOIN e ON q.tag <> e.tag AND len(q.v) = len(e.v)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY tag ORDER BY score, vec_id NULLS LAST) AS INT) AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
