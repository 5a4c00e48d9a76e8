"""The training-data pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.common import materialize, table
from folioscope.llm.decontaminate import drop_contaminated
from folioscope.llm.language_id import keep_identified
from folioscope.llm.mixing import mix
from folioscope.llm.simhash import drop_near_duplicates
from folioscope.llm.token_store import encode_documents


#: Rows that go to Python at a time. The engine's default of 10,000 is tens of MB of text for each task, on both sides, and
#: an executor keeps what its largest batch took.
BATCH = 512


def in_batches(spark: SparkSession) -> None:
    """Texts go to Python ``BATCH`` rows at a time, from here on in this session; a session that asks for fewer keeps that."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, null texts among them, and those no learned language explains better than chance, go.

    Rows that repeat an id or have none are judged by their own texts; a missing label is no reason to go."""
    in_batches(spark)
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least id; of rows that repeat an id, one.

    Wordless texts are alike. Rows without an id stay."""
    in_batches(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth of the words or more go, each row by its own text."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a document occurs as often as the mix takes it, three times at most.

    Null is a source like any other. A row that repeats is a row of its own."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids are written to the shared folder and read back: one row for each document of the mix.

    A null text is its end alone; null ids come first. An empty table gives, here as in every stage, an empty one."""
    in_batches(spark)
    return encode_documents(docs)


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", tokens),
]

#: Language identification is a trained model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
