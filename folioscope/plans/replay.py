"""Recorded answers replayed: requests meet the answers of the run that asked them, and what came of known errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import stable_id
from folioscope.operators.evaluate import accepted_at, cost_at
from folioscope.operators.events import passes
from folioscope.operators.ranks import placed


def request_key(before: Column, after: Column, version: Column) -> Column:
    """Digest of a canonical request: what is to be replaced, by what, and the version of the prompt."""
    return stable_id(F.struct(after.alias("after"), before.alias("before"), version.alias("version")), 64)


def matched(requests: DataFrame, answers: DataFrame, order: str = "ord") -> DataFrame:
    """Requests (key, order, …) with the recorded answers (key, order, …) as ``answer``, and ``answered``.

    A request that was made again takes the next answer of its key: the n-th meets the n-th, in the order of either side.
    What has no answer left is unanswered, a result of its own. Nothing is gathered by key, so one key may hold most rows.
    """
    given = placed(answers, ["key"], [order], "_nth")
    given = given.select(F.col("key").alias("_key"), F.col("_nth").alias("_at"), F.struct(*(c for c in answers.columns if c != "key")).alias("answer"))
    asked = placed(requests, ["key"], [order], "_nth")
    met = asked.join(given, (F.col("key") == F.col("_key")) & (F.col("_nth") == F.col("_at")), "left")
    return met.select(*requests.columns, F.col("_nth").alias("nth"), "answer", F.col("_key").isNotNull().alias("answered"))


def outcomes(errors: DataFrame, proposals: DataFrame, rejections: DataFrame) -> DataFrame:
    """target, replacement, outcome, without_consent: what a run made of each known error.

    ``proposals`` has (ord, target, replacement, unverified, impact), ``rejections`` (ord, target, guard, reason); the first of
    each counts. Outcome: offered, review-only, rejected by its guard, or missing. ``without_consent`` says whether the edit
    could be taken without asking.
    """
    first = proposals.groupBy("target", "replacement").agg(F.min_by(F.struct("unverified", "impact"), "ord").alias("p"))
    no = rejections.groupBy("target").agg(F.min_by(F.struct("guard", "reason"), "ord").alias("r"))
    met = errors.join(first, ["target", "replacement"], "left").join(no, "target", "left")
    line = F.element_at(F.split("r.reason", "\n"), 1)
    outcome = F.when(F.col("p").isNotNull(), F.when(F.col("p.unverified"), "review-only").otherwise("offered")).when(F.col("r").isNotNull(), F.concat(F.lit("rejected by "), F.col("r.guard"), F.lit(": "), line)).otherwise("missing")
    free = F.coalesce(~F.col("p.unverified") | (F.col("p.impact") == "mechanical"), F.lit(False))
    return met.select("target", "replacement", outcome.alias("outcome"), free.alias("without_consent"))


def pass_study(calls: DataFrame, proposals: DataFrame, most: int = 3) -> DataFrame:
    """k, cost, valid_more, harmful_more, unknown_more: decisions after fewer passes than ``most`` were made.

    ``calls`` has (key, ord, verdict, cost, ms), the verifier's calls by their request; ``proposals`` (key, label) says whether
    the edit of a request was valid, harmful, or null. A row counts, by label, what k passes accept and ``most`` reject.
    """
    each = passes(calls, "key", "ord", most)
    lists = each.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pass", "verdict", "cost"))).alias("p"))  # a few passes
    labels = proposals.groupBy("key").agg(F.first("label", ignorenulls=True).alias("label"))
    rows = lists.join(labels, "key", "left").withColumns({"yes": F.transform("p", lambda x: x["verdict"] == "preserved"), "costs": F.transform("p", lambda x: x["cost"])})
    per = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (accepted_at(F.col("yes"), k) & ~accepted_at(F.col("yes"), most)).alias("more"), cost_at(F.col("costs"), k).alias("cost")) for k in range(1, most + 1))))
    rows = rows.select("label", per.alias("x")).select("label", "x.*")
    known = F.when(F.col("label").isin("valid", "harmful"), F.col("label")).otherwise("unknown")
    return rows.groupBy("k").agg(F.round(F.sum("cost"), 6).alias("cost"), *(F.count_if(F.col("more") & (known == n)).alias(f"{n}_more") for n in ("valid", "harmful", "unknown")))
