"""Vector code compression: product codes whose codebooks are found by integer Lloyd rounds with Hamerly's bounds.

A vector's components become integers and the vector is cut into equal parts; each part has a codebook of its own and is
stored as the index of its nearest entry. What an assignment found is kept for the next one: for each part the index, one
upper bound of the distance to that entry, and one lower bound of the distance to the second nearest. When entries move,
the first grows by the way its entry went, the second shrinks by the longest way any other entry went. Only where the upper
bound isn't strictly under the lower one, even after it was made exact, are all entries looked at, in integers, so ties
go to the lower index as in a plain assignment. Bounds are rounded outwards.

The rows stay where they are: each assignment is one pass that writes the table with its bounds, and sums are added up
within a task before they are shuffled (a row for each part and entry). The driver holds the codebooks alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import materialize, quoted, ship, small, table
from folioscope.llm.vectors import matrix, taking_part

STATE = ["tag", "id", "label", "x", "near", "upper", "lower"]
MANY = 4096


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, in integers."""
    out = np.zeros((len(x), len(book)), np.int64)
    for i in range(x.shape[1]):
        out += (x[:, i, None] - book[:, i]) ** 2
    return out


def _up(a: np.ndarray) -> np.ndarray:
    return np.nextafter(a, np.inf)


def _down(a: np.ndarray) -> np.ndarray:
    return np.nextafter(a, -np.inf)


def scanned(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (ties to the lower index), upper bound of its distance, lower bound of the second's, by a full scan."""
    d = distances(x, book)
    near, own = d.argmin(1), np.arange(len(x))
    upper = _up(np.sqrt(d[own, near].astype(np.float64)))
    if len(book) == 1:
        return near, upper, np.full(len(x), np.inf)
    d[own, near] = np.iinfo(np.int64).max
    return near, upper, _down(np.sqrt(d.min(1).astype(np.float64)))


def moved(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each entry went, and how far the farthest of the others went, both rounded up."""
    way = _up(np.sqrt(((new - old) ** 2).sum(1).astype(np.float64)))
    most = np.full(len(way), way.max())
    if len(way) > 1:
        most[way.argmax()] = np.partition(way, -2)[-2]
    else:
        most[:] = 0
    return way, most


def bounded(x: np.ndarray, old: np.ndarray, new: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same as ``scanned`` would find with entries ``new``, from what was found with ``old``; and the number of scans."""
    way, most = moved(old, new)
    upper, lower = _up(upper + way[near]), _down(lower - most[near])
    loose = np.flatnonzero(~(upper < lower))
    upper[loose] = _up(np.sqrt(((x[loose] - new[near[loose]]) ** 2).sum(1).astype(np.float64)))
    loose = loose[~(upper[loose] < lower[loose])]
    near = near.copy()
    near[loose], upper[loose], lower[loose] = scanned(x[loose], new)
    return near, upper, lower, len(loose)


def _assign(rows: DataFrame, books: list[np.ndarray], before: list[np.ndarray] | None) -> DataFrame:
    """One assignment of all rows: (tag, id, label, x, near, upper, lower)."""
    parts, width = len(books), books[0].shape[1]

    def flat(a: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, parts), pa.int32()), pa.array(a.ravel(), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, MANY) for i in range(0, whole.num_rows, MANY)):
                x = np.ascontiguousarray(b.column("x").flatten().to_numpy().reshape(-1, parts, width))
                near, upper, lower = np.empty((len(x), parts), np.int64), np.empty((len(x), parts)), np.empty((len(x), parts))
                if before:
                    held = [b.column(c).flatten().to_numpy().reshape(-1, parts) for c in ("near", "upper", "lower")]
                for p in range(parts):
                    if before:
                        near[:, p], upper[:, p], lower[:, p], _ = bounded(x[:, p], before[p], books[p], *(h[:, p] for h in held))
                    else:
                        near[:, p], upper[:, p], lower[:, p] = scanned(x[:, p], books[p])
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in STATE[:4]), flat(near, pa.int64()), flat(upper, pa.float64()), flat(lower, pa.float64())], STATE)

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in STATE[:4])
    return rows.mapInArrow(run, f"{kinds}, near array<long>, upper array<double>, lower array<double>")


def _means(state: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Every entry replaced by the floor of the mean of its parts; unused ones stay."""
    parts, width, entries = len(books), books[0].shape[1], len(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(-1, parts, width)
            slot = b.column("near").flatten().to_numpy().reshape(-1, parts) + np.arange(parts) * entries
            n += np.bincount(slot.ravel(), minlength=len(n))
            np.add.at(sums, slot.ravel(), x.reshape(-1, width))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), *(pa.array(c) for c in sums[used].T)], ["slot", "n", *names])

    names = [f"s{i}" for i in range(width)]
    partial = state.select("x", "near").mapInArrow(run, ", ".join(f"{c} long" for c in ["slot", "n", *names]))
    out = [b.copy() for b in books]
    for r in partial.groupBy("slot").agg(*(F.sum(c).alias(c) for c in ["n", *names])).collect():
        out[r.slot // entries][r.slot % entries] = [r[c] // r.n for c in names]
    return out


def product_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = None, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256
) -> tuple[DataFrame, list[np.ndarray]]:
    """(tag, id, label, near, error) of every row that takes part, and the codebooks, an integer matrix for each part.

    ``near`` lists the entries' indexes in the order of parts, ``error`` is the sum of the squared distances to them. A
    codebook starts as that part of the ``entries`` rows with the smallest ids (nulls last, then in the order of vectors), or
    of all rows where there are fewer. Null and empty vectors and those with null or non-finite components take no part, nor
    do those of another length than most; zero vectors do. Rows that repeat an id are coded each by itself. An empty
    table gives no rows and no codebooks. A length that ``parts`` doesn't divide, or integers so large that an error could
    pass 64 bits, raise a ValueError. Other columns are ignored, whatever their names.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index takes two hex digits: 256 entries at most")
    spark = vectors.sparkSession
    ship(spark)
    rows, d = taking_part(vectors, id_col, vector_col, {"label": label_col} if label_col else None)
    if not label_col:
        rows = rows.withColumn("label", F.lit(None).cast("int"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("tag", "id", "label"))
    if not d:
        return spark.createDataFrame([], f"{kinds}, near array<long>, error long"), []
    if d % parts:
        raise ValueError(f"vectors of {d} components can't be cut into {parts} equal parts")
    largest = rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).head()[0] * scale + 1
    if d * (2 * largest) ** 2 >= 2.0**63:
        raise ValueError("components are too large: squared distances would pass 64 bits")

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.floor(scale * matrix(b.column("v"), d)).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, d), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in STATE[:3]), lists], STATE[:4])

    state = rows.select("tag", "id", "label", "v").mapInArrow(integers, f"{kinds}, x array<long>")
    first = state.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    seeds = np.array([r.x for r in first], np.int64).reshape(len(first), parts, -1)
    books, before = [np.ascontiguousarray(seeds[:, p]) for p in range(parts)], None
    for k in range(rounds):
        state = materialize(_assign(state, books, before), f"codes-{k}")
        books, before = _means(state, books), books
    state = materialize(_assign(state, books, before), "codes-last")

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = np.stack(books)
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(-1, parts, d // parts)
            near = b.column("near").flatten().to_numpy().reshape(-1, parts)
            error = ((x - table_[np.arange(parts), near]) ** 2).sum((1, 2))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("tag", "id", "label", "near")), pa.array(error)], ["tag", "id", "label", "near", "error"])

    return state.select("tag", "id", "label", "x", "near").mapInArrow(errors, f"{kinds}, near array<long>, error long"), books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components, by part, entry and place, as comma-joined decimals."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def decoded(near: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """The integers that rows of indexes stand for."""
    return np.concatenate([b[near[:, p]] for p, b in enumerate(books)], 1)


def with_label_errors(codes: DataFrame, id_col: str, books: list[np.ndarray]) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256); null labels are one label."""
    codes = materialize(codes, "codes-errors")
    sums = materialize(codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l"), "codes-labels")
    hexed = F.concat_ws("", F.transform("near", lambda i: F.lpad(F.lower(F.hex(i)), 2, "0")))
    joined = codes.join(small(sums), F.col("label").eqNullSafe(F.col("l")))
    return joined.select(F.col("id").alias(id_col), hexed.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op12(spark, sf_dir: str) -> DataFrame:
    """Query op12_vector_codes: every row of ``embeddings``."""
    vectors = table(spark, sf_dir, "embeddings").select(*(quoted(c) for c in ("vec_id", "embedding", "label")))
    codes, books = product_codes(vectors, label_col="label")
    return with_label_errors(codes, "vec_id", books)


def _sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS tag, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), piece AS MATERIALIZED (
  SELECT tag, p, list_slice(v, p * (len(v) // {parts}) + 1, (p + 1) * (len(v) // {parts})) AS x FROM kept, range({parts}) AS r(p)
), book0 AS MATERIALIZED (
  SELECT p, j, x FROM (SELECT tag, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS j FROM kept) JOIN piece USING (tag) WHERE j < {entries}
)"""
    ]
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
  SELECT tag, p, min({{'d': d, 'j': j}}) AS best
  FROM (SELECT a.tag, p, b.j, list_sum(list_transform(list_zip(a.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d FROM piece AS a JOIN book{k} AS b USING (p))
  GROUP BY tag, p
)""")
        if k < rounds:
            steps.append(f"""book{k + 1} AS MATERIALIZED (
  SELECT p, j, coalesce(m, x) AS x FROM book{k} LEFT JOIN (
    SELECT p, j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m
    FROM (SELECT p, best.j AS j, i, sum(x[i]) AS s, count(*) AS n FROM near{k} JOIN piece USING (tag, p), range(1, 4097) AS r(i) WHERE i <= len(x) GROUP BY ALL)
    GROUP BY p, j
  ) USING (p, j)
)""")
    return f"""
WITH {", ".join(steps)}, coded AS (
  SELECT tag, string_agg(printf('%02x', best.j), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY tag
), joined AS (
  SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error FROM kept JOIN coded USING (tag)
)
SELECT *, (SELECT sha256(string_agg(c, ',' ORDER BY p, j, i)) FROM (SELECT p, j, i, CAST(x[i] AS VARCHAR) AS c FROM book{rounds}, range(1, 4097) AS r(i) WHERE i <= len(x))) AS codebooks_sha256
FROM joined
"""


OP12_SQL = _sql()
