"""What the operators share: tables, scratch tables in the cluster's shared folder, components of link tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.cluster import ship

__all__ = ["components", "discard", "gathered", "hidden", "lower_ascii", "materialize", "quoted", "release", "scratch_dir", "ship", "small", "split_words", "sweep", "table", "trim", "values"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII white space, as the contracts name it.
SPACE = "\x20\x09-\x0d"
_own: dict[str, str] = {}
_released: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a local one only where that is unset and there is one
    machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="folioscope-")
    return _own[context.applicationId]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back, which cuts its lineage.

    The files survive lost executors, and each reader prunes their columns. They are this run's scratch: ``release``
    removes all of them, at the end of the program at the latest.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{scratch_dir(spark)}/folioscope/{app}/{label}-{uuid.uuid4().hex}"
    if app not in _released:  # results are read after a query returns, so the tables stay until the program ends
        _released.add(app)
        atexit.register(_release_at_end, spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes written tables that everything made from them is past, and shuffles that are no longer part of a plan."""
    for df in tables:
        _delete(df.sparkSession, df.scratch)
    sweep(tables[0].sparkSession)


def sweep(spark: SparkSession) -> None:
    """Has the engine look for shuffles that are no longer part of a plan; else they stay until its memory is short."""
    spark._jvm.System.gc()


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """The table, to be broadcast if it has at most ``rows`` rows. It is counted: give it a written table."""
    return F.broadcast(df) if df.count() <= rows else df


def release(spark: SparkSession) -> None:
    """Removes this application's scratch tables. Results not yet computed from them are lost."""
    _delete(spark, f"{scratch_dir(spark)}/folioscope/{spark.sparkContext.applicationId}")


def _release_at_end(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:
        release(spark)


def trim() -> None:
    """Gives freed memory back: a Python worker outlives its task, and so would its largest heap."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def gathered(batches: Iterator[pa.RecordBatch], most: int = 1 << 23) -> Iterator[list[pa.Array]]:
    """Columns of about ``most`` bytes at a time, or of one batch: what repeats in them is then met once."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield [pa.concat_arrays(c) for c in zip(*(x.columns for x in held), strict=True)]
            held, size = [], 0
    if held:
        yield [pa.concat_arrays(c) for c in zip(*(x.columns for x in held), strict=True)]


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of all texts (A-Z lower-cased, cut at ASCII white space) one after the other, and how many each text has."""
    texts = texts.cast(pa.large_string()).fill_null("")
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    sizes, flat = pc.list_value_length(cut).to_numpy().astype(np.int64), pc.list_flatten(cut)
    some = pc.not_equal(pc.binary_length(flat), 0)  # white space at an end leaves an empty string
    if not pc.all(some).as_py():
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(some.to_numpy(zero_copy_only=False))])
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        sizes, flat = np.diff(ends[at]), flat.filter(some)
    return flat.cast(pa.large_binary()).dictionary_encode(), sizes


def values(strings: pa.Array) -> list:
    """An Arrow array as Python values, without a box for each."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def quoted(name: str) -> str:
    """A column's name, whatever it holds, as the engine reads it."""
    return "`" + name.replace("`", "``") + "`"


def hidden(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with columns ``_c0``, ``_c1``, … and what each was called, so that no added name can clash with one."""
    names = {f"_c{i}": c for i, c in enumerate(docs.columns)}
    return docs.toDF(*names), names


def lower_ascii(text):
    """Lower-cases A-Z only; a plain-ASCII text takes the byte-wise way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def components(edges: DataFrame, label: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root) of every node of an undirected link table (a, b); root is the least node that can be reached.

    Alternating large-star and small-star steps: every round rewrites links towards the least neighbour, so the
    longest chain shrinks by a constant factor a round. Neighbourhoods are aggregated (a minimum for each node),
    never collected, and each round is written to the shared folder, so lineage stays short.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label
    )
    for _ in range(rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: each neighbour above the node is linked to the least of the node's neighbourhood
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the neighbours below, and the node itself, are linked to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = materialize(small, label)
        same = after.join(now, ["a", "b"], "left_anti").isEmpty() and now.join(after, ["a", "b"], "left_anti").isEmpty()
        now = after
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
