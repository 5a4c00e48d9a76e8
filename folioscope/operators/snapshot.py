"""One run against the next: changes, staleness, cached work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_diff(previous: DataFrame, latest: DataFrame, key: str = "id", evidence: str = "evidence") -> DataFrame:
    """key, state: new, unchanged, updated or resolved."""
    a = previous.select(F.col(key).alias("k"), F.col(evidence).alias("ea"), F.lit(True).alias("in_a"))
    b = latest.select(F.col(key).alias("k"), F.col(evidence).alias("eb"), F.lit(True).alias("in_b"))
    state = F.when(F.col("in_a").isNull(), "new").when(F.col("in_b").isNull(), "resolved").when(F.col("ea").eqNullSafe(F.col("eb")), "unchanged").otherwise("updated")
    return a.join(b, "k", "full_outer").select(F.col("k").alias(key), state.alias("state"))


def with_stale(changes: DataFrame, stale: DataFrame, key: str = "id") -> DataFrame:
    """The changes and a ``stale`` row for each accepted edit that no longer holds; an id may occur twice."""
    return changes.unionByName(stale.select(key, F.lit("stale").alias("state")))


def same_files(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, ``same``: whether two sets of (file, hash) agree."""
    odd = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), ["file", "hash"], "full_outer").where(F.col("_a").isNull() | F.col("_b").isNull())
    return odd.agg((F.count(F.lit(1)) == 0).alias("same"))


def file_hashes(parts: DataFrame, by: str = "file", part: str = "hash") -> DataFrame:
    """(file, hash): one hash for all parts of a file, from their hexadecimal hashes, whatever order these come in.

    Stretches of the hashes are summed, so a file of any number of parts is folded where it is read.
    """
    sums = [F.sum(F.conv(F.substring(part, i, 12), 16, 10).cast("decimal(20,0)")).cast("string") for i in (1, 13, 25, 37, 49)]
    return parts.groupBy(by).agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums), 256).alias(part))


def split_by_cache(units: DataFrame, cache: DataFrame, stage: str, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(known, missing): units whose key the stage has a value for, with it, and those to be computed."""
    own = cache.where(F.col("stage") == stage).select(key, "value")
    return units.join(own, key), units.join(own, key, "left_anti")


def cache_key(fields: list[str]) -> Column:
    """Key of everything a unit reads: the digest of its fields in the order of their names."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*sorted(fields))), 256))


def orphans(existing: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Outputs that no chapter stands for any more."""
    return existing.join(expected, key, "left_anti")


def changed_only(outputs: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Outputs whose text isn't what is there already."""
    now = outputs.withColumn("content_hash", F.sha2("text", 256))
    return now.join(existing.select(key, "content_hash"), [key, "content_hash"], "left_anti")
