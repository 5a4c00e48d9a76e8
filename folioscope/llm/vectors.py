"""What the operators on vectors share: which rows take part, and vectors as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import materialize, quoted


def finite(vector: Column) -> Column:
    """Whether a vector is there, and every component of it is a finite number."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~odd, F.lit(False))


def taking_part(df: DataFrame, id_col: str, vector_col: str, also: dict[str, str] | None = None, zero: bool = True) -> tuple[DataFrame, int]:
    """(tag, id, v, and the columns of ``also`` by their new names) as a written table, and the length of its vectors.

    Rows take part whose vector is finite, isn't all zero unless ``zero``, and has the length that most such rows have
    (the longer of two that are as frequent). ``tag`` tells rows apart that repeat an id.
    """
    named = {"id": id_col, "v": vector_col} | (also or {})
    rows = df.select(*(F.col(quoted(c)).alias(n) for n, c in named.items()))
    rows = rows.withColumn("v", F.col("v").cast("array<double>")).where(finite(F.col("v")) & (F.size("v") > 0))
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    rows = materialize(rows.withColumn("tag", F.monotonically_increasing_id()), "vectors")
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(2).collect()
    if not lengths:
        return rows, 0
    d = lengths[0].d
    return (rows.where(F.size("v") == d) if len(lengths) > 1 else rows), d


def matrix(lists: pa.Array, d: int) -> np.ndarray:
    """Lists of ``d`` numbers each as the rows of a matrix."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten() if len(lists) else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, d)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``, up to rounding."""
    out = (a * a).sum(1)[:, None] + (b * b).sum(1)
    out -= 2 * (a @ b.T)
    return np.maximum(out, 0, out=out)
