"""The evaluation suite around proposals: policies, scores of guides and passes, the review table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.evaluate import outcome, rank_of
from folioscope.operators.intervals import covered

#: What a model may repair in each mode.
ALLOWED = {"copy": ("typo", "doubled-word", "agreement", "redundancy", "qualifier", "sentence-frame", "formulaic"), "proofread": ("typo", "doubled-word", "agreement"), "mechanical": ("typo", "agreement")}


def policy(kind: Column, mode: str, spoken: Column) -> Column:
    """What may repair a defect: model-fixable, proofread-only, or nothing."""
    none = F.array().cast("array<string>")
    return (
        F.when(kind.isin("terminology", "dialogue-format"), none)
        .when(kind == "punctuation", F.array(F.lit("model-fixable" if mode == "proofread" else "proofread-only")))
        .when(spoken, none)
        .when(kind.isin(*ALLOWED[mode]), F.array(F.lit("model-fixable")))
        .otherwise(none)
    )


def policy_score(pairs: DataFrame, mutations: DataFrame) -> DataFrame:
    """One row of counts: detected, outcomes, reachable, compliant.

    ``pairs`` has mutation, source, scene, edit, defect (structs), judged and policy for each proposal beside each
    mutation of its scene; ``mutations`` has mutation and policy.
    """
    rows = pairs.withColumn("outcome", outcome(F.col("scene"), F.col("edit"), F.col("defect"), F.col("judged"))).where("outcome is not null")
    allowed = F.array_contains("policy", F.when(F.col("source") == "model", "model-fixable").otherwise("rule-fixable"))
    rows = rows.withColumn("good", F.col("outcome").isin("exact", "alternative") & allowed)
    best = rows.groupBy("mutation").agg(F.max_by("outcome", rank_of(F.col("outcome"))).alias("best"), F.bool_or("good").alias("compliant"), F.count_if(F.col("outcome") == "harmful").alias("harm"))
    met = mutations.join(best, "mutation", "left")
    reach = F.exists("policy", lambda p: p.isin("model-fixable", "rule-fixable"))
    n = lambda c, name: F.count_if(c).alias(name)
    return met.agg(F.count(F.lit(1)).alias("total"), n(F.col("best").isNotNull(), "detected"), *(n(F.col("best") == o, o) for o in ("exact", "alternative", "partial", "incorrect")), n(F.col("harm") > 0, "harmful"), n(reach, "reachable"), n(F.coalesce("compliant", F.lit(False)), "policy_compliant"))


def guide_score(hits: DataFrame, defects: DataFrame, keep: DataFrame) -> DataFrame:
    """One row: verdicts of hits (scene, start, end, principle), bounds of precision, and recall of defects."""
    h = hits.withColumn("_h", F.xxhash64(*hits.columns)).alias("h")
    d = defects.alias("d")
    over = (F.col("h.scene") == F.col("d.scene")) & (F.col("h.start") < F.col("d.end")) & (F.col("h.end") > F.col("d.start"))
    met = h.join(d, over, "left").groupBy("h._h", F.col("h.scene").alias("scene")).agg(F.bool_or(F.col("h.principle") == F.col("d.principle")).alias("same"), F.count("d.scene").alias("near"))
    kept = keep.select("scene", F.lit(True).alias("kept")).distinct()
    verdict = F.when(F.col("kept"), "fp-keep").when(F.col("same"), "tp").when(F.col("near") > 0, "near").otherwise("unlabeled")
    v = met.join(kept, "scene", "left").withColumn("verdict", verdict)
    n = lambda k, name: F.count_if(F.col("verdict") == k).alias(name)
    counts = v.agg(F.count(F.lit(1)).alias("findings"), n("tp", "tp"), n("near", "near"), n("fp-keep", "fp_on_keep"), n("unlabeled", "unlabeled"))
    found = d.join(h, over & (F.col("h.principle") == F.col("d.principle")), "left_semi").agg(F.count(F.lit(1)).alias("found"))
    every = defects.agg(F.count(F.lit(1)).alias("defects"))
    one = counts.join(found).join(every)  # three tables of one row
    some = F.when(F.col("findings") > 0, F.col("findings"))
    return one.select("findings", "tp", "near", "fp_on_keep", "unlabeled", (F.col("tp") / some).alias("precision_lower"), ((F.col("tp") + F.col("near") + F.col("unlabeled")) / some).alias("precision_upper"), (F.col("found") / F.when(F.col("defects") > 0, F.col("defects"))).alias("recall"))


def pass_metrics(cases: DataFrame, k: int) -> DataFrame:
    """One row over cases (decision, severity, verdicts, costs in order of passes): decisions after k passes and rates."""
    at = F.when((F.size("verdicts") >= k) & F.forall(F.slice("verdicts", 1, k), lambda v: v == "preserved"), "ACCEPT").otherwise("REJECT")
    rows = cases.withColumn("at", at).withColumn("cost", F.aggregate(F.slice("costs", 1, k), F.lit(0.0), lambda s, x: s + x))
    yes, no = F.col("at") == "ACCEPT", F.col("at") == "REJECT"
    rate = lambda part, whole: F.round(F.count_if(part & whole) / F.when(F.count_if(whole) > 0, F.count_if(whole)), 3)
    accept, reject = F.col("decision") == "ACCEPT", F.col("decision") == "REJECT"
    harmful = reject & (F.col("severity") == "harmful")
    return rows.agg(F.count(F.lit(1)).alias("cases"), F.count_if(harmful & yes).alias("harmful_accepted"), F.count_if(reject & (F.col("severity") == "unnecessary") & yes).alias("unnecessary_accepted"), F.count_if(accept & no).alias("valid_rejected"), rate(yes, accept).alias("correct_acceptance_rate"), rate(no, reject).alias("correct_rejection_rate"), rate(no, harmful).alias("harmful_rejection_rate"), F.round(F.sum("cost"), 6).alias("cost"))


def escalated(cases: DataFrame, rejects_too: bool) -> DataFrame:
    """Adds escalate and final: cases with risk triggers go to a second verifier, accepted ones or all."""
    go = (F.size("triggers") > 0) & ((F.col("first") == "ACCEPT") | F.lit(rejects_too))
    return cases.withColumn("escalate", go).withColumn("final", F.when(go, F.col("second")).otherwise(F.col("first"))).withColumn("spent", F.col("cost") + F.when(go, F.col("second_cost")).otherwise(0.0))


def provenance(merged: DataFrame) -> DataFrame:
    """passes, n: merged edits by the passes that proposed them."""
    return merged.groupBy(F.array_join("passes", "+").alias("passes")).agg(F.count(F.lit(1)).alias("n"))


def acceptance_refusals(wanted: DataFrame, active: DataFrame, unverified_ok: bool) -> DataFrame:
    """id, why: acceptances that can't be written: asked for twice, unverified, or accepted before with another edit."""
    twice = F.count(F.lit(1)).over(Window.partitionBy("id")) > 1
    rows = wanted.withColumn("_twice", twice).join(active.select("id", F.col("payload").alias("_was")), "id", "left")
    why = F.when(F.col("_twice"), "duplicate").when(F.col("unverified") & ~F.lit(unverified_ok), "unverified").when(F.col("_was") != F.col("payload"), "conflicting")
    return rows.select("id", why.alias("why")).where("why is not null").distinct()


def review_view(latest: DataFrame, history: DataFrame, results: DataFrame, rejected: DataFrame, places: DataFrame) -> DataFrame:
    """Proposals of the latest run and of the history, which overrides it, with their state.

    States: accepted, or why an accepted edit doesn't apply; rejected; pending if it is found in the text; else stale.
    """
    past = history.select("id").withColumn("accepted", F.lit(True))
    rows = latest.join(history.select("id"), "id", "left_anti").unionByName(history)
    rows = rows.join(past, "id", "left").join(results.select("id", F.col("status").alias("_r")), "id", "left").join(rejected.select("id").distinct().withColumn("_no", F.lit(True)), "id", "left").join(places.select("id", F.col("found").alias("_f")), "id", "left")
    status = F.when(F.col("accepted"), F.when(F.col("_r") == "applied", "accepted").otherwise(F.coalesce("_r", F.lit("stale")))).when(F.col("_no"), "rejected").when(F.col("_f"), "pending").otherwise("stale")
    return rows.withColumn("status", status).drop("accepted", "_r", "_no", "_f")


def unnecessary(edits: DataFrame, contributing: DataFrame, preserve: DataFrame, keys: list[str], control: Column, words: int) -> DataFrame:
    """One row: count, control_proposals, preserve_proposals, scanned_words, rate of edits that nothing asked for.

    ``edits`` has (id, keys, start, end; start is null where the target isn't found any more). An edit is unnecessary in a
    control chapter, on a span to be preserved, or where it isn't among those that ``contributing`` (id) names.
    """
    over = covered(edits.where("start is not null"), {"kept": preserve}, keys, "id")
    met = edits.withColumn("_c", F.coalesce(control, F.lit(False))).join(over, "id", "left").join(contributing.select("id", F.lit(True).alias("_good")).distinct(), "id", "left")
    kept, good = F.coalesce("kept", F.lit(False)), F.coalesce("_good", F.lit(False))
    n = F.count_if(F.col("_c") | kept | ~good)
    return met.agg(n.alias("count"), F.count_if("_c").alias("control_proposals"), F.count_if(kept).alias("preserve_proposals"), F.lit(words).cast("long").alias("scanned_words"), (n / F.lit(words) if words else F.lit(0.0)).alias("rate"))
