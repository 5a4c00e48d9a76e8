"""Benchmark decontamination: a hash set of benchmark n-grams against the token windows of all documents.

A window is ``n`` consecutive words of a benchmark item, or the whole item if it is shorter. Document windows get
rolling hashes by doubling (4 words, then ``n``), inside the row; only the positions whose hash is in the set leave
it, and there the words themselves are compared. The set is broadcast while it is small, and shuffled beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import hidden, lower_ascii, materialize, small, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of the text in order; null has none."""
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), 0), F.array().cast("array<string>"))


def _hashes(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds h<L>: for each L the hash of the L words from each position on (null words past the end are skipped)."""
    at = lambda name, i: F.get(F.col(name), i)
    rows = rows.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    if max(lengths) >= 4:
        rows = rows.withColumn("h4", F.transform("h1", lambda h, i: F.xxhash64(h, at("h1", i + 1), at("h1", i + 2), at("h1", i + 3))))
    for n in lengths:
        if n not in (1, 4):
            parts = [("h4", k) for k in range(0, n - n % 4, 4)] + [("h1", k) for k in range(n - n % 4, n)]
            rows = rows.withColumn(f"h{n}", F.transform(parts[0][0], lambda h, i: F.xxhash64(h, *(at(c, i + k) for c, k in parts[1:]))))  # noqa: B023
    return rows


def benchmark_windows(bench: DataFrame, n: int, id_col: str, text_col: str) -> tuple[DataFrame, list[int]]:
    """(len, gram, items): every distinct window with the items that have it; and the window lengths, n at most."""
    items = bench.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("len", F.least(F.size("words"), F.lit(n)))
    lengths = sorted(r[0] for r in items.select("len").distinct().collect())  # n values at most
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1), lambda i: F.slice("words", i, F.col("len"))))
    grams = items.select("item", "len", gram.alias("gram"))
    return grams.groupBy("len", "gram").agg(F.array_sort(F.collect_set("item")).alias("items")), lengths


def _found(docs: DataFrame, bench: DataFrame, n: int, id_col: str, text_col: str, item_col: str, item_text_col: str, broadcast_windows: int) -> DataFrame:
    """id, x (a hash of the text), n_words, rows, hits (sorted positions of the words that are hit), items: a row for each
    id and text."""
    grams, lengths = benchmark_windows(bench, n, item_col, item_text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("x"), words_of(F.col(text_col)).alias("words"))
    start = rows.select("id", "x", F.size("words").cast("long").alias("n_words"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("len"), F.lit(None).cast("array<string>").alias("items"))
    if lengths:
        hashed = _hashes(rows, lengths)
        each = lambda m: F.slice(f"h{m}", 1, F.greatest(F.size("words") - (m - 1), F.lit(0)))
        tagged = lambda m: F.transform(each(m), lambda h, i: F.struct(F.lit(m).alias("len"), i.alias("pos"), h.alias("h")))
        # One row for the document itself (pos null, key of length 0), then its windows.
        keyed = F.flatten(F.array(
            F.array(F.struct(F.lit(0).alias("len"), F.lit(-1).alias("pos"), F.lit(0).cast("long").alias("h"))),
            *(tagged(m) for m in lengths),
        )) if len(lengths) > 1 else None
        grams = _hashes(grams.withColumnRenamed("gram", "words"), lengths)
        key = F.element_at(F.coalesce(*(F.when(F.col("len") == m, F.col(f"h{m}")) for m in lengths)), 1)
        grams = grams.select(key.alias("key"), F.col("len").alias("glen"), F.col("words").alias("gram"), "items")
        own = grams.sparkSession.range(1).select(F.lit(0).cast("long").alias("key"), F.lit(0).alias("glen"), F.array().cast("array<string>").alias("gram"), F.array().cast("array<string>").alias("items"))
        grams = grams.unionByName(own)
        small_set = grams.count() <= broadcast_windows
        if small_set:
            grams = F.broadcast(grams)
        if keyed is None:
            m = lengths[0]
            listed = F.concat(F.array(F.lit(0).cast("long")), each(m))
            flat = hashed.select("id", "x", "words", F.posexplode(listed).alias("pos", "h")).withColumn("pos", F.col("pos") - 1)
            flat = flat.withColumn("len", F.when(F.col("pos") < 0, 0).otherwise(m))
        else:
            flat = hashed.select("id", "x", "words", F.explode(keyed).alias("k")).select("id", "x", "words", F.col("k.pos").alias("pos"), F.col("k.h").alias("h"), F.col("k.len").alias("len"))
        # Next to a broadcast set the words stay in the row and are cut at hits only; a row to be shuffled takes its window
        # along and nothing else.
        cut = F.when(F.col("pos") >= 0, F.slice("words", F.col("pos") + 1, F.greatest(F.col("len"), F.lit(1)))).otherwise(F.array().cast("array<string>"))
        size = F.size("words").cast("long") if small_set else F.col("n_words")
        flat = flat if small_set else flat.withColumn("n_words", F.size("words").cast("long")).withColumn("own", cut).drop("words")
        met = flat.join(grams, (F.col("h") == F.col("key")) & (F.col("len") == F.col("glen")))
        # not a plain equality next to a broadcast set: it would become a key of the join and be made for every row
        met = met.where((F.col("pos") < 0) | (cut == F.col("gram")) if small_set else F.col("own") == F.col("gram"))
        start = met.select("id", "x", size.alias("n_words"), F.when(F.col("pos") >= 0, F.col("pos")).alias("pos"), F.col("len"), "items")
    hit = F.when(F.col("pos").isNotNull(), F.struct("pos", (F.col("pos") + F.col("len")).alias("end")))
    whole = start.groupBy("id", "x", "n_words").agg(
        F.count(F.when(F.col("pos").isNull(), 1)).cast("int").alias("rows"),
        F.collect_set(hit).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return whole.withColumn("hits", F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["pos"], h["end"] - 1))))))


def contamination(
    docs: DataFrame,
    bench: DataFrame,
    n: int = 13,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_windows: int = 1_000_000,
) -> DataFrame:
    """One row for each input row: id, n_words, spans (word positions, half-open, merged), items (sorted strings).

    A null or wordless text has no words and no hits; an item without words has no window; null item ids count for
    hits but aren't listed. Rows that repeat an id with the same text get equal rows, with another text their own.
    Other columns are ignored. Windows are broadcast up to ``broadcast_windows`` of them (about 200 bytes each).
    """
    whole = _found(docs, bench, n, id_col, text_col, item_col, item_text_col, broadcast_windows)
    # where a run of positions starts and ends
    after = F.transform("hits", lambda i: i + 1)
    spans = F.arrays_zip(F.array_sort(F.array_except("hits", after)).alias("start"), F.array_sort(F.array_except(after, "hits")).alias("end"))
    whole = whole.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return whole.select(F.col("id").alias(id_col), "n_words", spans.alias("spans"), "items")


def judged(found: DataFrame, percent: int = 5) -> DataFrame:
    """Adds n_hit and contaminated: at least ``percent`` of the document's words are hit, and one at least."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]))
    found = found.withColumn("n_hit", n_hit)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))


def _beside(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    """Documents (hidden names) joined to what was found of them, by id and text."""
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_x"))
    return docs.join(small(materialize(found, "contaminated")), same, how)


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 5, n: int = 13, item_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = 1_000_000) -> DataFrame:
    """The documents that aren't contaminated, with all their columns.

    Each row is judged by its own text, so rows that repeat an id, or have none, stay or go by themselves. Null and
    wordless texts stay. An empty table gives an empty one; other columns pass through whatever their names.
    """
    rows, names = hidden(docs)
    by = {c: n for n, c in names.items()}
    found = _found(rows, bench, n, by[id_col], by[text_col], item_col, item_text_col, broadcast_windows)
    bad = found.where((F.size("hits") > 0) & (100 * F.size("hits") >= percent * F.col("n_words"))).select(F.col("id").alias("_id"), F.col("x").alias("_x"))
    return _beside(rows, bad, by[id_col], by[text_col], "left_anti").toDF(*names.values())


def remove_spans(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 13, item_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = 1_000_000) -> DataFrame:
    """Documents with the hit words cut out of their texts; what lies between the other words stays as it is.

    Each row is cut by what was found in its own text, whatever ids repeat or are missing. A null text stays null, an empty
    table empty; other columns pass through whatever their names.
    """
    rows, names = hidden(docs)
    by = {c: n for n, c in names.items()}
    found = _found(rows, bench, n, by[id_col], by[text_col], item_col, item_text_col, broadcast_windows).where(F.size("hits") > 0)
    hit = _beside(rows, found.select(F.col("id").alias("_id"), F.col("x").alias("_x"), F.col("hits").alias("_hits")), by[id_col], by[text_col], "left")
    text = F.col(by[text_col])
    gaps, words = F.split(text, ANY_CASE, -1), F.regexp_extract_all(text, F.lit(ANY_CASE), 0)
    stays = F.transform(words, lambda w, i: F.when(F.array_contains("_hits", i), F.lit("")).otherwise(w))
    cut = F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), stays.alias("w")), lambda x: F.concat(x["g"], F.coalesce(x["w"], F.lit("")))), "")
    fixed = F.when(F.col("_hits").isNotNull(), cut).otherwise(text)
    return hit.select(*((fixed if c == text_col else F.col(n)).alias(c) for n, c in names.items()))


def op1(spark, sf_dir: str) -> DataFrame:
    """Query op1_decontaminate: every row of ``documents`` against every item of ``benchmark``."""
    found = judged(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
     g AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, w[i : i + least(13, len(w)) - 1] AS gram
           FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
     p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n),
     h AS (SELECT doc_id, item_id, p.n, i FROM p JOIN g ON p.n = g.n AND w[i : i + p.n - 1] = gram),
     k AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
     m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)
"""
