"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies (target / size of the source). The documents are
laid out in one order, those expectations are summed along it, one offset is added, and a document is emitted once
for each whole number its stretch of the sum crosses. Ordered by size, neighbours in the order are alike, so the
words taken stay close to the target. The order's prefix sums are taken in three steps (sizes of a source, cells of one
size, rows), so no task ever sorts a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import hidden, materialize, small, table

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(skey, source_size, target) from (skey, source, source_size): water-filling over the sources.

    Weights repeat along the sources in code-point order, null last. A target stops at ``most`` times its source; the
    excess goes to the others by weight. Sources are taken in the order in which they fill up: before the k-th, the
    level is what the full ones leave, by the weight that remains, and the highest level met is the final one.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("i") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))).withColumn("w", w)
    filling = Window.orderBy(F.col("source_size") * most / F.col("w"), "i")
    whole = Window.partitionBy()
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(most))
    before = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(filling.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(whole) * F.lit(share) - before) / left
    ranked = ranked.withColumn("level", level)
    target = F.least(F.col("cap"), F.max("level").over(whole) * F.col("w")).cast("double")
    return ranked.select("skey", "source_size", target.alias("target"))


def mix_plan(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    share: float = 1.0,
    most: int = 3,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    broadcast_rows: int = 1_000_000,
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """One row for each input row: id, size, source_size, target, copies.

    Size is the number of words; a null text has none. A null source is a source of its own, the last. Rows that
    repeat an id are rows of their own; a null id orders first. A document of size 0 may be emitted and adds nothing;
    a source whose documents are all empty has target 0. An empty table gives an empty plan. Other columns of
    ``docs`` are ignored, but for those that ``keep`` makes. The offset of a source comes from ``seed`` and its name, so reruns agree.
    """
    size = F.coalesce(F.size(F.regexp_extract_all(F.col(text_col), F.lit(WORD), 0)), F.lit(0)).cast("long")
    size = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(size).cast("long")
    more = [c.alias(f"keep{i}") for i, c in enumerate((keep or {}).values())]
    # rows of one source and size are laid out by a digest of their ids, whatever pattern these have
    deal = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.xxhash64(text_col).cast("string"))), 1, 2)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), deal.alias("deal"), *more)
    rows = materialize(rows.withColumn("skey", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), "mix-sizes")
    n = rows.count()
    sources = rows.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    few = rows.groupBy("skey").count().count() <= broadcast_rows
    targets = source_targets(sources, weights, share, most)
    # Strata of one source and size. A stratum of many rows is dealt out; there are at most 10,000 of those.
    large = max(64, n // 10_000)
    strata = rows.groupBy("skey", "size").count().where(F.col("count") > large).select("skey", "size", F.lit(1).alias("dealt"))
    rows = rows.join(F.broadcast(strata), ["skey", "size"], "left").withColumn("cell", F.when(F.col("dealt").isNotNull(), F.col("deal")).otherwise(F.lit("")))
    rows = rows.drop("source", "dealt")
    cells = rows.groupBy("skey", "size", "cell").count()
    bands = cells.groupBy("skey", "size").agg(F.sum("count").alias("held"))
    bands = bands.select("skey", "size", (F.sum("held").over(Window.partitionBy("skey").orderBy(F.desc("size"))) - F.col("held")).alias("band_from"))
    within = F.sum("count").over(Window.partitionBy("skey", "size").orderBy("cell")) - F.col("count")
    cells = cells.withColumn("cell_from", within).join(bands, ["skey", "size"])
    cells = cells.join(F.broadcast(targets) if few else targets, "skey")
    cells = cells.select("skey", "size", "cell", (F.col("band_from") + F.col("cell_from")).alias("base"), "source_size", "target")
    order = Window.partitionBy("skey", "size", "cell").orderBy("deal", "id")
    placed = rows.withColumn("k", F.row_number().over(order)).join(cells, ["skey", "size", "cell"])
    i = F.col("base") + F.col("k")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), "skey")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    copies = F.floor(offset + i * rate) - F.floor(offset + (i - 1) * rate)
    # rounding of the sums never lifts a document above its bound
    kept = [F.col(f"keep{i}").alias(c) for i, c in enumerate(keep or {})]
    return placed.select(F.col("id").alias(id_col), *kept, "size", "source_size", "target", F.least(copies, F.lit(most)).cast("long").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, each as often as the plan takes it.

    Rows are told apart by id, text and source; of rows that agree in all three, some are taken once more than others, so
    that together they are taken as often as planned. Null texts and sources are values like others, a null id too. An
    empty table gives an empty mix; other columns pass through whatever their names.
    """
    rows, names = hidden(docs)
    by = {c: n for n, c in names.items()}
    key = [F.col(by[id_col]).alias("_id"), F.xxhash64(F.coalesce(by[text_col], F.lit("")), F.col(by[text_col]).isNull()).alias("_x"), F.col(by[source_col]).cast("string").alias("_s")]
    plan = mix_plan(rows, id_col=by[id_col], text_col=by[text_col], source_col=by[source_col], keep={"_x": key[1], "_s": key[2]}, **options)
    plan = plan.groupBy(F.col(by[id_col]).alias("_pi"), F.col("_x").alias("_px"), F.col("_s").alias("_ps")).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    plan = small(materialize(plan.where("_copies > 0"), "mix-plan"))
    taken = rows.select("*", *key).join(plan, F.col("_id").eqNullSafe(F.col("_pi")) & (F.col("_x") == F.col("_px")) & F.col("_s").eqNullSafe(F.col("_ps")))
    once = taken.where("_rows = 1").withColumn("_n", F.col("_copies"))
    # the k-th of several equal rows: a window over those alone
    again = taken.where("_rows > 1").withColumn("_k", F.row_number().over(Window.partitionBy("_id", "_x", "_s").orderBy("_x")))
    again = again.withColumn("_n", F.floor(F.col("_copies") / F.col("_rows")) + (F.col("_k") <= F.col("_copies") % F.col("_rows")).cast("long")).drop("_k")
    taken = once.unionByName(again).where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    return taken.select(*(F.col(n).alias(c) for n, c in names.items()))


def op2(spark, sf_dir: str) -> DataFrame:
    """Query op2_mix_sources: every row of ``documents``."""
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP2_SQL = """
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size FROM documents),
     s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
     r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM s),
     w AS (SELECT *, 1 + (i - 1) % 3 AS w, source_size * 3.0::DOUBLE AS cap FROM r),
     l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
     t AS (SELECT source, source_size, least(cap, max(level) OVER () * w)::DOUBLE AS target,
                  ('0x' || substr(md5('mix' || coalesce('=' || source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM l),
     o AS (SELECT doc_id, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                  row_number() OVER (PARTITION BY d.source ORDER BY size DESC, substr(md5(doc_id::VARCHAR), 1, 2), doc_id) AS i
           FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (least(floor(u + i * rate) - floor(u + (i - 1) * rate), 3) * size)::BIGINT AS taken FROM o
"""
