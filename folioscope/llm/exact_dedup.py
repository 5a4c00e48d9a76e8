"""Exact deduplication over an extendible-hash index in shared files.

Each text is reduced to an entry (key, length, id). Copies are folded where they are read, so a group that holds
a third of all rows reaches the index as one entry a task. The index is a table in the shared folder whose rows are
kept by bucket; a directory of hash prefixes says which bucket a key is in. The directory starts with one slot and
doubles while a bucket is overfull, and only overfull buckets are split: the others keep their shorter prefix.
Owner tasks then read whole key ranges (buckets), chain entries of equal keys, and the texts behind a chain of more
than one row are compared byte by byte, so that a collision of keys never joins two texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import materialize, table


def squeezed(text: Column) -> Column:
    """The text without ASCII white space; null is the empty text."""
    out = F.coalesce(text, F.lit(""))
    for c in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def directory(counts: DataFrame, capacity: int, depth: int) -> dict[int, int]:
    """slot -> local depth of the bucket that serves it, by directory doubling.

    ``counts`` has (slot, n) for the 2**depth finest slots, so it is of bounded size whatever the input. A bucket is
    overfull if it holds more than ``capacity`` entries; it is split on the next bit until it isn't, or at ``depth``.
    """
    n = [0] * (1 << depth)
    for slot, k in counts.collect():
        n[slot] = k
    held = [n]  # held[i]: entries of each prefix of depth - i bits
    while len(held[-1]) > 1:
        held.append([x + y for x, y in zip(held[-1][::2], held[-1][1::2], strict=True)])
    held.reverse()
    out: dict[int, int] = {}
    full = [(0, 0)]
    while full:  # each pass is one doubling of the directory
        deeper = []
        for prefix, bits in full:
            if bits < depth and held[bits][prefix] > capacity:
                deeper += [(2 * prefix, bits + 1), (2 * prefix + 1, bits + 1)]
            else:
                span = depth - bits
                out.update(dict.fromkeys(range(prefix << span, (prefix + 1) << span), bits))
        full = deeper
    return out


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 200_000,
    depth: int | None = None,
    key_bits: int = 256,
    broadcast_keys: int = 1_000_000,
) -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical without ASCII white space; null is the empty text. Of a group the row with the most
    code points in its original text stays, then the one with the least id (a null id comes last). Rows that repeat
    an id are rows of their own for ``group_size``; the first of them counts as kept along with its repeats.
    Other columns of ``docs`` are ignored; an empty table gives an empty result. ``key_bits`` shortens the key, to try
    the chaining of collisions. The directory doubles up to 2**``depth`` slots; unless given that goes by the number of keys,
    to a million slots. Keys of chains are broadcast up to ``broadcast_keys`` of them, beyond that shuffled.
    """
    text = squeezed(F.col(text_col))
    row = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.length(text_col), F.lit(0)).alias("len"), text.alias("norm")
    ).withColumn("sha", F.sha2("norm", 256))
    key = F.col("sha") if key_bits >= 256 else F.substring("sha", 1, key_bits // 4)
    row = row.withColumn("key", key)
    entries = materialize(row.select("id", "len", "sha", "key"), "exact-entries")
    best = F.min(F.struct((-F.col("len")).alias("len"), F.col("id").isNull().alias("none"), "id")).alias("best")
    # Folded first: a key is one entry a task, however many copies it has.
    folded = entries.groupBy("key").agg(best, F.count(F.lit(1)).alias("n"))
    folded = materialize(folded, "exact-folded")
    # Eight times as many slots as buckets are needed, so that uneven prefixes can be told apart; digests are even.
    depth = min(20, max(4, (folded.count() // capacity).bit_length() + 3)) if depth is None else depth
    slot = F.conv(F.substring(F.rpad("key", 8, "0"), 1, 8), 16, 10).cast("long")
    folded = folded.withColumn("slot", F.shiftright(slot, 32 - depth).cast("int"))
    depths = directory(folded.groupBy("slot").count(), capacity, depth)
    bits = F.element_at(F.split(F.lit(",".join(str(depths[i]) for i in range(1 << depth))), ","), F.col("slot") + 1).cast("int")  # of a constant
    bucket = F.expr(f"shiftright(slot, {depth} - bits) + shiftleft(1, bits)")
    owners = len({(i >> (depth - b)) + (1 << b) for i, b in depths.items()})
    index = folded.withColumn("bits", bits).withColumn("bucket", bucket).drop("bits").repartitionByRange(owners, "bucket", "key")
    index = materialize(index.sortWithinPartitions("bucket", "key"), "exact-index")
    chained = index.where("n > 1").select("key")
    if chained.count() <= broadcast_keys:
        chained = F.broadcast(chained)
    # Bytes behind a chain: the copies fold again where they are read, now by the bytes themselves.
    links = row.join(chained, "key", "left_semi").groupBy("key", "sha", "norm").agg(best, F.count(F.lit(1)).alias("n"))
    single = index.where("n = 1").select("key", F.lit(None).cast("string").alias("sha"), "best", "n")
    # A key that stands for several texts has its members told apart by their own digest.
    found = single.unionByName(links.select("key", "sha", "best", "n"))
    out = entries.alias("e").join(found.alias("o"), (F.col("e.key") == F.col("o.key")) & (F.col("o.sha").isNull() | (F.col("e.sha") == F.col("o.sha"))))
    keep = F.col("o.best.id")
    return out.select(
        F.col("e.id").alias(id_col), keep.alias("keep_id"), F.col("o.n").alias("group_size"),
        F.col("e.id").eqNullSafe(keep).alias("kept"), F.col("e.sha").alias("text_sha256"),
    )



def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat the kept id, all stay."""
    gone = exact_groups(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias("_gone")).where("_gone is not null")
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


def op7(spark, sf_dir: str) -> DataFrame:
    """Query op7_exact_dedup: every row of ``documents``."""
    return exact_groups(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH t AS (SELECT doc_id, coalesce(length(text), 0) AS len,
                  regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
     g AS (SELECT norm, arg_min(doc_id, (-len, doc_id)) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""
