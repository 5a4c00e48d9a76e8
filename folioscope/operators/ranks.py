"""Places and sums along an order within keys of any size: no task holds a whole key.

The order is cut into cells at a bounded sample of its own points. Cells are summed first, then what stands before a cell
is added to what stands before a row in its cell, so a key that has most of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType


def cell_of(df: DataFrame, by: list[str], order: list[str], cuts: int = 64) -> Column:
    """A number that doesn't fall along (by, order): how many of at most ``cuts`` points of the table aren't above a row.

    The points are the rows with the least hashes, so they are the same whenever the table is.
    """
    fields = [*by, *order]
    kinds = {f.name: f.dataType.simpleString() for f in df.select(*fields).schema.fields}
    points = df.select(*fields).orderBy(F.xxhash64(*fields), *fields).limit(cuts).orderBy(*fields).collect()

    def said(value: object, kind: str) -> str:
        """A literal; texts go by their bytes, so whatever they hold does no harm."""
        text = f"decode(unhex('{value.encode().hex()}'), 'UTF-8')" if isinstance(value, str) else f"'{value}'"
        return f"cast({text} as {kind})"

    def reached(point: Row) -> str:
        """Whether a row isn't before a point; nulls come first."""
        whole = "true"
        for c in reversed(fields):
            name, value = "`" + c.replace("`", "``") + "`", None if point[c] is None else said(point[c], kinds[c])
            whole = f"({name} is not null or {whole})" if value is None else f"(coalesce({name} > {value}, false) or ({name} <=> {value} and {whole}))"
        return whole

    def search(low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high) // 2
        return f"case when {reached(points[middle])} then {search(middle + 1, high)} else {search(low, middle)} end"

    return F.expr(search(0, len(points)))  # as text: a tree of columns takes seconds to build


def before(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None, cuts: int = 64, cell: Column | None = None) -> DataFrame:
    """Adds, for each row, sums (0 at first) and maxima (null at first) over the rows of its key that stand before it.

    ``order`` tells the rows of a key apart. Null keys are a key; nulls come first in the order. ``cell`` is what ``cell_of``
    gave for the same keys and order, if it is at hand.
    """
    sums, maxes = sums or {}, maxes or {}
    names = {n: f"_v{i}" for i, n in enumerate([*sums, *maxes])}
    rows = df.withColumn("_cell", cell_of(df, by, order, cuts) if cell is None else cell).withColumns({names[n]: c for n, c in (sums | maxes).items()})
    rows = rows.repartition(*by, "_cell")  # both uses of the rows start from this shuffle, and cells are worked out once
    fold = lambda n, c: F.sum(c) if n in sums else F.max(c)
    cells = rows.groupBy(*by, "_cell").agg(*(fold(n, v).alias(v) for n, v in names.items()))
    upto = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "_cell"])), *(fold(n, v).over(upto).alias(f"_b{v}") for n, v in names.items()))
    near = Window.partitionBy(*by, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_n{v}": fold(n, v).over(near) for n, v in names.items()})
    same = F.lit(True)
    for i, c in enumerate([*by, "_cell"]):
        same = same & rows[c].eqNullSafe(F.col(f"_k{i}"))
    both = rows.join(cells, same, "left")
    whole = {n: F.coalesce(f"_b{v}", F.lit(0)) + F.coalesce(f"_n{v}", F.lit(0)) if n in sums else F.greatest(f"_b{v}", f"_n{v}") for n, v in names.items()}
    return both.select(*df.columns, *(c.alias(n) for n, c in whole.items()))


def placed(df: DataFrame, by: list[str], order: list[str], name: str, cuts: int = 64) -> DataFrame:
    """Adds each row's place, from 0, among the rows of its key."""
    return before(df, by, order, {name: F.lit(1).cast("long")}, cuts=cuts)


def walked(df: DataFrame, keys: list[str], order: list[str], step: Callable[[], Callable[..., object]], fields: list[str], name: str, flag: bool = True) -> DataFrame:
    """Adds what a fold says of each row: rows of a key come one after the other, and nothing but the fold's state is held.

    ``step()`` makes a fold for a key: a function of the row's ``fields`` that returns a boolean, or a whole number without ``flag``.
    """
    head = [*keys, *(f for f in fields if f not in keys)]
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold = None, None
        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in head}
            said = []
            for key, args in zip(zip(*(cols[k] for k in keys), strict=True), zip(*(cols[f] for f in fields), strict=True), strict=True):
                if fold is None or key != now:
                    now, fold = key, step()
                said.append(fold(*args))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, out)], [*b.schema.names, name])

    out = pa.bool_() if flag else pa.int64()
    return rows.mapInArrow(run, StructType([*df.schema.fields, StructField(name, BooleanType() if flag else LongType())]))


def split_hot(df: DataFrame, keys: list[str], few: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys with at most ``few`` rows, and those of the others, or None if there are no others."""
    hot = df.groupBy(*keys).count().where(F.col("count") > few).select(*(F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)))
    if hot.isEmpty():
        return df, None
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & df[k].eqNullSafe(hot[f"_h{i}"])
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")
