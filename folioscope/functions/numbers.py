"""Numbers: quantiles by index, rates, budgets, money."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def midpoint_median(value: Column | str) -> Column:
    """Median, the mean of the middle two for an even count."""
    return F.percentile(value, F.lit(0.5))


def floor_quantiles(rows: DataFrame, by: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """by, and a column for each fraction: the sorted values' entry at floor((n - 1) * fraction), never interpolated.

    Equal values are counted where they are read, so what a group sorts is its distinct values, not its rows. Nulls
    don't count; a group without values has none.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_k"))
    group = Window.partitionBy(*by)
    upto = F.sum("_k").over(group.orderBy(value))
    counts = counts.withColumns({"_upto": upto, "_n": F.sum("_k").over(group)})
    picks = (F.min(F.when(F.col("_upto") > F.floor((F.col("_n") - 1) * F.lit(f)), F.col(value))).alias(name) for name, f in fractions.items())
    return counts.groupBy(*by).agg(*picks)


def floor_quantile(value: Column | str, fraction: float) -> Column:
    """Aggregate form of ``floor_quantiles`` for groups that are small by nature: it collects the group's values."""
    values = F.array_sort(F.collect_list(value))
    return F.get(values, F.floor((F.size(values) - 1) * F.lit(fraction)).cast("int"))


def low_median(value: Column | str) -> Column:
    """The lower of the middle two for an even count."""
    return floor_quantile(value, 0.5)


def per_thousand(amount: Column, words: Column) -> Column:
    return amount * F.lit(1000.0) / F.greatest(words, F.lit(1))


def token_budget(chars: Column, per_token: Column | float, least: int = 2048) -> Column:
    """Tokens to allow for a text: characters over characters a token, a quarter more, ``least`` at least."""
    need = F.ceil(chars / (F.lit(per_token) if isinstance(per_token, (int, float)) else per_token) * 1.25)
    return F.greatest(F.lit(least), need).cast("long")


def call_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Cost of a call at prices for a million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / F.lit(1e6)


def worst_reservation(chars: Column) -> Column:
    """Tokens a request may take at worst: one for two characters."""
    return F.ceil(chars / 2).cast("long")


def total_or_null(amount: Column, billed: Column) -> Column:
    """Sum that is null as soon as a billed row has no amount."""
    return F.when(F.coalesce(F.bool_or(billed & amount.isNull()), F.lit(False)), F.lit(None)).otherwise(F.coalesce(F.sum(amount), F.lit(0.0)))
