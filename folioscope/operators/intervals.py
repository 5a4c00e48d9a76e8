"""Spans of one text, or of any key, against each other: overlap, touch, containment, collapse, greedy choice, packing."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.matching import overlaps, touches, within
from folioscope.operators.ranks import before, cell_of, split_hot, walked

TESTS: dict[str, Callable[[Column, Column], Column]] = {"overlap": overlaps, "touch": touches, "within": within}


def span_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner", test: str = "overlap", width: int | None = None) -> DataFrame:
    """Joins spans (start, end) of the same keys by a test; inner, left_semi or left_anti.

    Columns of ``b`` but the keys come as ``b_<name>`` for inner. Keys prune to one text's spans. Where a key has very
    many, ``width`` cuts positions into buckets and joins by them too, each pair being kept in the bucket where it first
    meets; spans should be short against the width.
    """
    left = a.withColumn("_a", F.struct("start", "end"))
    right = b.select(*keys, *(F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys), F.struct("start", "end").alias("_b"))
    on = [*keys]
    first = F.lit(True)
    if width:
        cells = lambda s: F.explode(F.sequence(F.floor(s["start"] / width), F.floor(F.greatest(s["end"] - 1, s["start"]) / width)))
        left, right = left.withColumn("_cell", cells(F.col("_a"))), right.withColumn("_cell", cells(F.col("_b")))
        on = [*on, "_cell"]
        first = F.col("_cell") == F.greatest(F.floor(F.col("_a.start") / width), F.floor(F.col("_b.start") / width))
    cond = TESTS[test](F.col("_a"), F.col("_b"))
    if how == "inner":
        return left.join(right, on).where(cond & first).drop("_a", "_b", "_cell")
    if how not in ("left_semi", "left_anti"):
        raise ValueError(how)
    x, y = left.alias("x"), right.alias("y")
    same = F.lit(True)
    for k in on:
        same = same & (F.col(f"x.{k}") == F.col(f"y.{k}"))
    met = x.join(y, same & TESTS[test](F.col("x._a"), F.col("y._b")), "left_semi" if width else how)
    if not width:
        return met.drop("_a")
    hit = met.drop("_a", "_cell").distinct()
    return hit if how == "left_semi" else a.join(hit, [*a.columns], "left_anti")


def collapsed_count(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n: matches that start at or after the furthest end of all before them, whether those counted or not."""
    earlier = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("start") >= F.coalesce(F.max("end").over(earlier), F.lit(-(2**62)))
    return spans.withColumn("_new", new).groupBy(*keys).agg(F.count_if("_new").alias("n"))


def greedy(spans: Column) -> Column:
    """Marks of an array of spans in order of (start, end): true for each that starts at or after the last accepted end.

    A choice depends on those before it, so it is a fold, not a window; the array is one key's spans.
    """
    return F.aggregate(
        spans,
        F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<boolean>").alias("out")),
        lambda s, x: F.struct(
            F.when(s["last"].isNull() | (x["start"] >= s["last"]), x["end"].cast("long")).otherwise(s["last"]).alias("last"),
            F.concat(s["out"], F.array(s["last"].isNull() | (x["start"] >= s["last"]))).alias("out"),
        ),
        lambda s: s["out"],
    )


def islands(spans: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Adds ``island``: the number of those before it within its keys. An island ends where the furthest end so far is
    passed, so no span overlaps one of another island; a key of any size is cut into them without being gathered."""
    order = ["start", "end", ident]
    cell = cell_of(spans, keys, order)
    far = before(spans, keys, order, maxes={"_far": F.col("end")}, cell=cell)
    opens = (F.col("_far").isNotNull() & (F.col("start") >= F.col("_far"))).cast("long")
    rows = before(far.withColumn("_opens", opens), keys, order, {"_before": F.col("_opens")}, cell=cell)
    return rows.withColumn("island", F.col("_before") + F.col("_opens")).drop("_far", "_opens", "_before")


def _next_free() -> Callable[[int, int], bool]:
    last = None

    def fits(start: int, end: int) -> bool:
        nonlocal last
        if last is not None and start < last:
            return False
        last = end
        return True

    return fits


def _apart() -> Callable[[int, int], bool]:
    starts: list[int] = []
    ends: list[int] = []

    def fits(start: int, end: int) -> bool:
        i = bisect_right(starts, start)  # what is kept doesn't overlap: only its neighbours can
        if (i and ends[i - 1] > start and starts[i - 1] < end) or (i < len(starts) and starts[i] < end and ends[i] > start):
            return False
        starts.insert(i, start)
        ends.insert(i, end)
        return True

    return fits


def _folded(spans: DataFrame, keys: list[str], ident: str, order: list[str], fold: Callable, name: str, few: int) -> DataFrame:
    """Keys of at most ``few`` rows are folded one after the other; of larger ones, each island by itself."""
    some, hot = split_hot(spans, keys, few)
    out = walked(some, keys, order, fold, ["start", "end"], name)
    if hot is not None:
        parts = walked(islands(hot, keys, ident), [*keys, "island"], order, fold, ["start", "end"], name)
        out = out.unionByName(parts.drop("island"))
    return out


def schedule(spans: DataFrame, keys: list[str], ident: str, few: int = 100_000) -> DataFrame:
    """The rows of ``spans`` with ``accepted``: greedy choice for each key by (start, end, id)."""
    rows = spans.select(*keys, ident, "start", "end")
    return _folded(rows, keys, ident, ["start", "end", ident], _next_free, "accepted", few)


def first_kept(spans: DataFrame, keys: list[str], order: str, few: int = 100_000) -> DataFrame:
    """Rows that overlap no row of the same keys that was kept before them, in input order."""
    return _folded(spans, keys, order, [order], _apart, "_kept", few).where("_kept").drop("_kept")


def packed(sizes: Column, budget: Column | int) -> Column:
    """Group number of each size of an array: a group is closed before it would pass the budget and once it reaches it."""
    b = F.lit(budget) if isinstance(budget, int) else budget
    zero = F.lit(0).cast("long")
    return F.aggregate(
        sizes,
        F.struct(zero.alias("held"), F.lit(0).alias("group"), F.array().cast("array<int>").alias("out")),
        lambda s, x: _pack(s, x, b, zero),
        lambda s: s["out"],
    )


def _pack(s: Column, x: Column, budget: Column, zero: Column) -> Column:
    full = (s["held"] > 0) & (s["held"] + x > budget)
    group = s["group"] + full.cast("int")
    held = F.when(full, x.cast("long")).otherwise(s["held"] + x)
    closes = held >= budget
    return F.struct(F.when(closes, zero).otherwise(held).alias("held"), (group + closes.cast("int")).alias("group"), F.concat(s["out"], F.array(group)).alias("out"))


def shifted(edits: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``at``: where each edit starts once those before it are applied."""
    earlier = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    delta = F.length("replacement") - (F.col("end") - F.col("start"))
    return edits.withColumn("_d", delta).withColumn("at", F.col("start") + F.coalesce(F.sum("_d").over(earlier), F.lit(0))).drop("_d")


def covered(edits: DataFrame, sets: dict[str, DataFrame], keys: list[str], ident: str) -> DataFrame:
    """ident and, for each set of spans (keys, start, end), whether an edit overlaps one of them: one sweep for all sets.

    Along the text an edit's question stands where it ends, a span where it starts: an edit overlaps a span of a set if
    the furthest end of the set's spans that start before the edit's end lies behind the edit's start. So nothing is joined.
    """
    ask = edits.select(*keys, F.col("end").cast("long").alias("_pos"), F.lit(0).alias("_set"), F.col("start").cast("long").alias("_start"), F.lit(None).cast("long").alias("_end"), F.col(ident).alias("_id"))
    for i, spans in enumerate(sets.values(), 1):
        ask = ask.unionByName(spans.select(*keys, F.col("start").cast("long").alias("_pos"), F.lit(i).alias("_set"), F.lit(None).cast("long").alias("_start"), F.col("end").cast("long").alias("_end"), F.lit(None).cast(edits.schema[ident].dataType).alias("_id")))
    far = before(ask, keys, ["_pos", "_set", "_start", "_end", "_id"], maxes={f"_far{i}": F.when(F.col("_set") == i, F.col("_end")) for i in range(1, len(sets) + 1)})
    return far.where("_set = 0").select(F.col("_id").alias(ident), *(F.coalesce(F.col(f"_far{i}") > F.col("_start"), F.lit(False)).alias(n) for i, n in enumerate(sets, 1)))
