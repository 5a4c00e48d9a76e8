"""Append-only logs folded to states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.ranks import before, placed, split_hot, walked


def last_wins(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. An aggregate: partial maxima are made before rows move."""
    rest = [c for c in log.columns if c not in keys]
    best = F.max(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *rest)).alias("_m")
    return log.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_m.{c}").alias(c) for c in rest))


def first_wins(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in log.columns if c not in keys]
    best = F.min(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *rest)).alias("_m")
    return log.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_m.{c}").alias(c) for c in rest))


def suppressed(statuses: DataFrame, findings: DataFrame, key: str, order: list[str], closed: tuple[str, ...] = ("wontfix", "false-positive", "fixed")) -> DataFrame:
    """Findings that their last status doesn't close; a status with evidence closes only that evidence."""
    last = last_wins(statuses.select(key, "status", F.col("evidence").alias("status_evidence"), *order), [key], order)
    met = findings.join(last.select(key, "status", "status_evidence"), key, "left")
    shut = F.col("status").isin(*closed) & (F.col("status_evidence").isNull() | (F.col("status_evidence") == F.col("evidence")))
    return met.where(~F.coalesce(shut, F.lit(False))).drop("status", "status_evidence")


def active_acceptances(log: DataFrame, key: str, order: str, kind: str = "event") -> DataFrame:
    """key, first and last order, n and conflict of keys whose last event is an acceptance.

    An ``accept`` opens or repeats, a ``withdraw`` closes. What holds is the first acceptance since the last
    withdrawal; later ones that differ in ``payload`` are in conflict with it.
    """
    w = Window.partitionBy(key)
    closed = F.max(F.when(F.col(kind) == "withdraw", F.col(order))).over(w)
    live = log.withColumn("_closed", closed).where((F.col(kind) == "accept") & (F.col("_closed").isNull() | (F.col(order) > F.col("_closed"))))
    return live.groupBy(key).agg(
        F.min(order).alias("first_at"), F.max(order).alias("last_at"), F.count(F.lit(1)).alias("n"),
        F.min_by("payload", order).alias("payload"), (F.countDistinct("payload") > 1).alias("conflict"),
    )


def spent(reservations: DataFrame, settlements: DataFrame, key: str, by: list[str]) -> DataFrame:
    """by, spent, open: settled reservations at their cost, open ones at the whole amount."""
    done = settlements.groupBy(key).agg(F.sum("cost").alias("cost"))
    met = reservations.join(done, key, "left")
    return met.groupBy(*by).agg(F.sum(F.coalesce("cost", "amount")).alias("spent"), F.count_if(F.col("cost").isNull()).alias("open"))


def delegation_refusal(d: Column, workspace: Column, capability: Column, now: Column) -> Column:
    """Why a delegation doesn't cover a capability now, the first reason of eight; null if it does."""
    granted, expires, revoked = (F.try_to_timestamp(d[c]) for c in ("granted_at", "expires_at", "revoked_at"))
    return (
        F.when(d["workspace"].isNull() | d["granted_by"].isNull() | d["allow"].isNull() | granted.isNull() | expires.isNull(), "incomplete")
        .when(d["workspace"] != workspace, "other workspace")
        .when(F.unix_micros(expires) - F.unix_micros(granted) > 7 * 86_400_000_000, "longer than seven days")
        .when(now < granted, "not yet valid")
        .when(now >= expires, "expired")
        .when(F.coalesce(revoked <= now, F.lit(False)), "revoked")
        .when(F.coalesce(F.array_contains(d["deny"], capability), F.lit(False)), "denied")
        .when(~F.array_contains(d["allow"], capability), "not allowed")
    )


def _attempts(most: int) -> Callable[[], Callable[[str | None], int]]:
    def fold() -> Callable[[str | None], int]:
        number, n = 0, 0

        def step(verdict: str | None) -> int:
            nonlocal number, n
            mine, n = number, n + 1
            if verdict is not None or n == most:
                number, n = number + 1, 0
            return mine

        return step

    return fold


def passes(calls: DataFrame, job: str, order: str, most: int = 3, few: int = 100_000) -> DataFrame:
    """job, pass, verdict, cost, ms, attempts: calls up to a complete verdict, or to the third attempt.

    Attempts are counted from the call after the last verdict; every third without one closes a pass as well. Jobs of at
    most ``few`` calls are walked. In larger ones a call's stretch is the number of verdicts before it, its group goes by its
    place in the stretch, and the number of a pass is that of the closed groups before it: three running sums.
    """
    some, hot = split_hot(calls, [job], few)
    whole = lambda rows, by: rows.groupBy(job, *by).agg(F.array_sort(F.collect_list(F.struct(order, F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce("ms", F.lit(0.0)).alias("ms")))).alias("c"), F.max("verdict").alias("v")).where(F.col("v").isNotNull() | (F.size("c") == most))
    out = whole(walked(some, [job], [order], _attempts(most), ["verdict"], "pass", flag=False), ["pass"])
    if hot is not None:
        rows = before(hot, [job], [order], {"_gap": F.col("verdict").isNotNull().cast("long")})
        rows = placed(rows, [job, "_gap"], [order], "_i").withColumn("_g", F.floor(F.col("_i") / most))
        out = out.unionByName(placed(whole(rows, ["_gap", "_g"]), [job], ["_gap", "_g"], "pass").drop("_gap", "_g"))
    total = lambda f: F.aggregate("c", F.lit(0.0), lambda s, x: s + x[f])
    return out.select(job, F.col("pass").cast("int").alias("pass"), F.coalesce("v", F.lit("failed")).alias("verdict"), total("cost").alias("cost"), total("ms").alias("ms"), F.size("c").alias("attempts"))
