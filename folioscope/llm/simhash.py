"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Fingerprints that differ in at most two bits differ in at most two of their eight bytes, so they share at least six
bytes at the same positions. Postings of a single byte would hold a 256th of the corpus each, so the index is keyed
by four positional bytes at a time: of the four byte pairs at least two are untouched, hence one of six keys is shared.
For each pair that meets in a posting the shared positional bytes are tallied, pairs with six and more are retained,
and these are verified bit by bit. Copies have one fingerprint and enter the index once.

A posting longer than ``dense`` isn't paired off. Its fingerprints are linked exactly by another way: two fingerprints
are within two bits if and only if some word is within one bit of both. Each is listed under its 65 such words, a
word lists 65 fingerprints at most, and these are linked to the least of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from folioscope.llm.common import components, hidden, materialize, ship, small, table, trim

PIECE = 1 << 16


def fingerprint(text: bytes | None, k: int = 3) -> int:
    """64-bit SimHash of the k-word shingles of a UTF-8 text, A-Z lower-cased; 0 if it has no words."""
    words = (text or b"").lower().split()  # bytes: only A-Z and ASCII white space are meant
    if not words:
        return 0
    if len(words) <= k:
        return xxh64_intdigest(b" ".join(words), 42)
    total, n = np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, PIECE):
        part = words[at : at + PIECE + k - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(k)), strict=False))
        h = np.fromiter((xxh64_intdigest(s, 42) for s in shingles), np.dtype("<u8"))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(id, fp) of each row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(t.as_py(), k) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.int64())], ["id", "fp"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def near_links(groups: DataFrame, bits: int = 2, dense: int = 48, broadcast_keys: int = 1_000_000) -> DataFrame:
    """(a, b) of representatives that are linked, from distinct fingerprints (fp, rep)."""
    if bits != 2:
        raise ValueError("the index is laid out for two bits")
    pair = lambda i: F.expr(f"shiftrightunsigned(fp, {16 * i}) & 65535L")
    keys = [F.lit(n).cast("long") * (1 << 32) + pair(i) * 65536 + pair(j) for n, (i, j) in enumerate((i, j) for i in range(4) for j in range(i))]
    postings = groups.select("fp", "rep", F.explode(F.array(*keys)).alias("key"))
    held = materialize(postings.groupBy("key").count().where("count > 1"), "simhash-postings")
    long = held.where(F.col("count") > dense).select("key")
    short = held.where(F.col("count") <= dense).select("key")
    met = materialize(postings.join(small(short, broadcast_keys), "key", "left_semi"), "simhash-met")
    a, b = met.alias("a"), met.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")))
    byte = lambda s, i: F.expr(f"shiftrightunsigned({s}.fp, {8 * i}) & 255L")
    tally = sum(((byte("a", i) == byte("b", i)).cast("int") for i in range(1, 8)), (byte("a", 0) == byte("b", 0)).cast("int"))
    met = met.where(tally >= 8 - bits).where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= bits)
    links = met.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))
    crowd = postings.join(small(long, broadcast_keys), "key", "left_semi").select("fp", "rep").distinct()
    words = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    listed = crowd.select("rep", F.explode(words).alias("word")).groupBy("word").agg(F.collect_set("rep").alias("reps")).where("size(reps) > 1")
    stars = listed.select(F.array_min("reps").alias("a"), F.explode("reps").alias("b")).where("a < b").distinct()
    return links.unionByName(stars).where("a is not null and b is not null")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dense: int = 48) -> DataFrame:
    """One row for each input row: id, fp (signed long), component_id (the least id that can be reached by links).

    A null or wordless text has fingerprint 0 and is linked like any other. Rows that repeat are rows of their own.
    A row without an id gets its component's id, but links nothing by itself (component_id is null if it is alone).
    An empty table gives an empty result; other columns are ignored.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "simhash-prints")
    groups = materialize(prints.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-groups")
    found = components(near_links(groups, dense=dense), "simhash-components")
    found = groups.join(found, groups["rep"] == found["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return prints.join(found, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all its columns: the one with the least id.

    Null and wordless texts are alike. Of rows that repeat the id, one stays. Rows without an id stay. An empty table gives
    an empty one; other columns pass through whatever their names.
    """
    rows, names = hidden(docs)
    id_name, text_name = (next(n for n, c in names.items() if c == col) for col in (id_col, text_col))
    found = near_duplicates(rows.select(F.col(id_name).alias("id"), F.col(text_name).alias("text")), "id", "text").where("id is not null")
    found = materialize(found.groupBy("id").agg(F.min("component_id").alias("root"), F.count(F.lit(1)).alias("n")), "simhash-found")
    gone = small(found.where("id <> root").select(F.col("id").alias("_gone")))
    kept = rows.join(gone, F.col(id_name).cast("long") == F.col("_gone"), "left_anti")
    again = found.where("id = root and n > 1").select(F.col("id").alias("_again"))
    if not again.isEmpty():
        same = F.col(id_name).cast("long") == F.col("_again")
        kept = kept.join(small(again), same, "left_anti").unionByName(kept.join(small(again), same, "left_semi").dropDuplicates([id_name]))
    return kept.toDF(*names.values())


def op4(spark, sf_dir: str) -> DataFrame:
    """Query op4_simhash: every row of ``documents``."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
