"""Votes, recall, confusion, frontiers: how well proposals did."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.matching import texts
from folioscope.functions.text import is_subsequence

#: From worst to best.
OUTCOMES = ("harmful", "incorrect", "partial", "alternative", "exact")


_INNER = r"[\p{L}\p{N}]+"


def _grams(words: Column, n: int) -> Column:
    """Hashes of the runs of ``n`` words."""
    rows = F.arrays_zip(*(F.slice(words, i + 1, 1_000_000_000).alias(f"t{i}") for i in range(n)))
    whole = F.filter(rows, lambda r: r[f"t{n - 1}"].isNotNull())
    return F.transform(whole, lambda r: F.xxhash64(*(r[f"t{i}"] for i in range(n))))


def located(docs: DataFrame, quotes: DataFrame, doc: str, item: str, within: tuple[str, ...] = (), portion: int = 10_000) -> DataFrame:
    """doc, item, start: first place of each quote in every document that contains it verbatim.

    A quote's inner words stand as whole words in any text that contains it. So its runs of three of them (or fewer) are
    looked up among the documents' runs, the one that the fewest documents have is its anchor, and only documents with the
    anchor are searched. Quotes without an inner word, single words mostly, are searched for in all documents, ``portion`` of
    them at a time. Columns ``within`` have to agree on both sides. Null and repeated texts are allowed, ids tell rows apart.
    """
    inner = F.regexp_replace(F.regexp_replace("quote", rf"\A{_INNER}", ""), rf"{_INNER}\z", "")
    asked = quotes.where(F.col("quote").isNotNull()).withColumn("_w", texts(inner, _INNER)).withColumn("_n", F.least(F.size("_w"), F.lit(3)))
    sizes = {r["_n"]: r["count"] for r in asked.groupBy("_n").count().collect()}  # four numbers
    kept = [doc, item, *within]
    found = []
    if longest := [n for n in (1, 2, 3) if sizes.get(n)]:
        pick = F.when(F.lit(False), F.array().cast("array<long>"))
        for n in longest:
            pick = pick.when(F.col("_n") == n, _grams(F.col("_w"), n))
        own = asked.where("_n > 0").select(item, *within, F.explode(F.array_distinct(pick)).alias("gram"))
        listed = docs.withColumn("_w", texts(F.col("text"), _INNER)).select(doc, *within, F.explode(F.array_distinct(F.concat(*(_grams(F.col("_w"), n) for n in longest)))).alias("gram"))
        listed = listed.join(own.select("gram", *within).distinct(), ["gram", *within], "left_semi")
        often = listed.groupBy("gram", *within).agg(F.count(F.lit(1)).alias("n"))
        anchors = own.join(often, ["gram", *within], "left").groupBy(item, *within).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("a")).where("a.n > 0")
        pairs = anchors.select(item, *within, F.col("a.gram").alias("gram")).join(listed, ["gram", *within]).select(*kept)
        met = pairs.join(quotes.select(item, *within, "quote"), [item, *within]).join(docs.select(doc, *within, "text"), [doc, *within])
        found.append(met.where(F.contains("text", F.col("quote"))))
    parts = -(-sizes.get(0, 0) // portion)
    for i in range(parts):
        some = asked.where("_n = 0").where(F.pmod(F.xxhash64(item), F.lit(parts)) == i).select(item, *within, "quote")
        test = F.contains(docs["text"], some["quote"])
        for c in within:
            test = test & docs[c].eqNullSafe(some[c])
        found.append(docs.join(F.broadcast(some), test).select(doc, item, *(docs[c] for c in within), "quote", "text"))
    if not found:
        kind = quotes.schema[item].dataType
        found = [docs.select(doc, *within, "text").where("false").withColumns({item: F.lit(None).cast(kind), "quote": F.lit(None).cast("string")})]
    out = found[0].select(*kept, "quote", "text")
    for more in found[1:]:
        out = out.unionByName(more.select(*kept, "quote", "text"))
    return out.select(*kept, (F.expr("locate(quote, text)") - 1).cast("int").alias("start"))


def majority(votes: DataFrame, keys: list[str], yes: str) -> DataFrame:
    """keys, accepted, votes: more than half of the votes, rounded down, say yes."""
    return votes.groupBy(*keys).agg((F.count_if(yes) >= F.floor(F.count(F.lit(1)) / 2) + 1).alias("accepted"), F.count(F.lit(1)).alias("votes"))


def unanimity(votes: DataFrame, keys: list[str], order: str, yes: str) -> DataFrame:
    """keys, unanimous, passes: all say yes; passes that were needed: up to the first no."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    rows = votes.withColumn("_i", i)
    return rows.groupBy(*keys).agg(F.bool_and(yes).alias("unanimous"), F.coalesce(F.min(F.when(~F.col(yes), F.col("_i"))), F.count(F.lit(1)).cast("int")).alias("passes"))


def accepted_at(answers: Column, k: int) -> Column:
    """Whether the first k answers (booleans in order) are there and all yes."""
    return (F.size(answers) >= k) & F.forall(F.slice(answers, 1, k), lambda a: a)


def cost_at(costs: Column, k: int) -> Column:
    return F.aggregate(F.slice(costs, 1, k), F.lit(0.0), lambda s, x: s + x)


def confusion(rows: DataFrame, by: list[str], valid: str, accepted: str) -> DataFrame:
    """by and over all (null keys): cases, accepted of either kind, and rates to three places, null where empty."""
    v, a = F.col(valid), F.col(accepted)
    n = lambda c: F.count_if(c)
    rate = lambda part, whole: F.round(n(part) / F.when(n(whole) > 0, n(whole)), 3)
    return rows.groupingSets([by, []], *by).agg(
        F.count(F.lit(1)).alias("cases"), n(v & a).alias("valid_accepted"), n(~v & a).alias("harmful_accepted"),
        rate(v & a, v).alias("acceptance_rate"), rate(~v & ~a, ~v).alias("rejection_rate"),
    )


def recall(rows: DataFrame, by: list[str], hit: str) -> DataFrame:
    """by, total, recalled, rate."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("recalled"), F.avg(F.col(hit).cast("int")).alias("rate"))


def spread(rows: DataFrame, by: list[str], value: str, least: int = 1) -> DataFrame:
    """by, mean, least, most of groups with ``least`` values and more."""
    out = rows.groupBy(*by).agg(F.count(value).alias("_n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    return out.where(F.col("_n") >= least).drop("_n")


def _best(cols: list[np.ndarray], signs: list[int]) -> np.ndarray:
    """Places of the points that no other point dominates; the larger is better where the sign is -1.

    In order of all measures no point is dominated by a later one, so each is held against what is kept before it.
    """
    codes = np.stack([np.unique(c, return_inverse=True)[1] * s for c, s in zip(cols, signs, strict=True)], 1)
    order = np.lexsort(codes.T[::-1])
    kept, n = np.empty((64, codes.shape[1]), codes.dtype), 0
    places = []
    for i in order:
        if n and (kept[:n] <= codes[i]).all(1).any() and not (kept[:n] == codes[i]).all(1).any():
            continue
        if n == len(kept):
            kept = np.concatenate([kept, np.empty_like(kept)])
        kept[n], n = codes[i], n + 1
        places.append(i)
    return np.sort(np.array(places, np.int64))


def pareto(rows: DataFrame, more: list[str], less: list[str]) -> DataFrame:
    """Rows that no other row dominates: as good everywhere and better somewhere.

    Distinct points are filtered where they are read, then in a few tasks, then in one that sees only what is left, and
    the rows of the points that remain are returned. A row with a null measure is beaten by none and beats none.
    """
    names, signs = [*more, *less], [-1] * len(more) + [1] * len(less)
    points = rows.select(*(F.col(c).alias(f"_m{i}") for i, c in enumerate(names))).distinct()
    some = F.lit(True)
    for i in range(len(names)):
        some = some & F.col(f"_m{i}").isNotNull()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            now = pa.Table.from_batches([b])
            held = now if held is None else pa.concat_tables([held, now])
            if held.num_rows:
                held = held.take(_best([c.to_numpy() for c in held.columns], signs))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    left = points.where(some)
    for parts in (None, 8, 1):
        left = (left if parts is None else left.repartition(parts)).mapInArrow(best, left.schema)
    same = F.lit(False)
    for c in names:
        same = same | rows[c].isNull()
    on = F.lit(True)
    for i, c in enumerate(names):
        on = on & (rows[c] == left[f"_m{i}"])
    return rows.join(left, on, "left_semi").unionByName(rows.where(same))


def best_match(pairs: DataFrame, key: str, rank: Column, order: str) -> DataFrame:
    """Of each key the pair of highest rank, the first in order on a tie."""
    rest = [c for c in pairs.columns if c != key]
    best = F.max(F.struct(rank.alias("_r"), (-F.col(order)).alias("_o"), *rest)).alias("_m")
    return pairs.groupBy(key).agg(best).select(key, *(F.col(f"_m.{c}").alias(c) for c in rest))


def window_text(scene: Column, frm: Column, to: Column, start: Column, end: Column, inner: Column) -> Column:
    """The scene from ``frm`` to ``to`` with start..end replaced."""
    return F.concat(F.substring(scene, frm + 1, start - frm), inner, F.substring(scene, end + 1, to - end))


def outcome(scene: Column, edit: Column, mutation: Column, judged: Column) -> Column:
    """What an edit (start, end, replacement) does to a mutation (start, end, original, mutated, alternatives).

    Null if it leaves the mutated place as it is or doesn't reach it. ``judged`` is a person's label or null.
    """
    frm, to = F.least(edit["start"], mutation["start"]), F.greatest(edit["end"], mutation["end"])
    got = window_text(scene, frm, to, edit["start"], edit["end"], edit["replacement"])
    of = lambda t: window_text(scene, frm, to, mutation["start"], mutation["end"], t)
    words = lambda t: texts(t, r"[\p{L}\p{N}]+")
    partial = (F.size(words(got)) < F.size(words(of(mutation["mutated"])))) & is_subsequence(words(got), words(of(mutation["mutated"]))) & is_subsequence(words(of(mutation["original"])), words(got))
    return (
        F.when((edit["start"] > mutation["end"]) | (edit["end"] < mutation["start"]) | (got == of(mutation["mutated"])), F.lit(None).cast("string"))
        .when(judged == "harmful", "harmful")
        .when(got == of(mutation["original"]), "exact")
        .when(F.coalesce(F.exists(mutation["alternatives"], lambda a: got == of(a)), F.lit(False)), "alternative")
        .when(partial, "partial")
        .otherwise("incorrect")
    )


def rank_of(result: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, OUTCOMES)), result)


def risk_triggers(before: Column, after: Column, verdicts: Column) -> Column:
    """Names of what makes an edit worth a second verifier."""
    words = lambda t: texts(t, r"[\p{L}\p{N}]+")
    caps = lambda t: F.filter(words(t), lambda w: F.regexp_like(w, F.lit(r"^\p{Lu}")))
    b, a = words(F.lower(before)), words(F.lower(after))
    tests = {
        "verification-failure": F.exists(verdicts, lambda v: ~v.isin("preserved", "changed")),
        "split-verdicts": F.size(F.array_distinct(verdicts)) > 1,
        "capitalized-word-change": F.array_join(caps(before), " ") != F.array_join(caps(after), " "),
        "dialogue": F.regexp_like(F.concat(before, after), F.lit("[“”«»\"]|(^|\\n)\\s*[—–-]\\s")),
        "new-word": F.exists(a, lambda w: ~F.array_contains(b, w)),
        "word-order": F.array_join(F.filter(b, lambda w: F.array_contains(a, w)), " ") != F.array_join(F.filter(a, lambda w: F.array_contains(b, w)), " "),
    }
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in tests.items())))


def disagreements(answers: DataFrame, keys: list[str], verdict: str) -> DataFrame:
    """Keys with more than one answer that don't all agree."""
    return answers.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(verdict).alias("kinds")).where("n > 1 and kinds > 1")
