"""Records: proposals, findings, journals and runs, as JSON lines with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import normalize_quote, sha256
from folioscope.operators.events import first_wins

PROPOSAL = "id string, source string, category string, impact string, chapter string, scene string, target string, before string, after string, occurrence int, target_hash string, replacement string, evidence_hash string, reason string, unverified boolean, source_findings array<string>"
EVIDENCE = "struct<type:string,scene:string,text:string,hash:string,name:string,value:double,baseline:double,unit:string,uri:string,note:string>"
FINDING = f"id string, tool string, run_id string, category string, severity string, primary struct<category:string,key:string>, evidence_hash string, evidence array<{EVIDENCE}>, suggestion string"
STATUS = "finding_id string, status string, evidence string, at string"
JOURNAL = "event string, proposal_id string, evidence_hash string, replacement string, actor string, at string"
SPEND = "kind string, id string, delegation_id string, amount double, cost double, currency string, at string"
LEDGER = "stage string, provider string, model string, tokens_in long, tokens_out long, cost double, currency string, ms double, budget long, error string"
#: From least to most severe.
SEVERITIES = ("info", "low", "medium", "high", "critical")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def read_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines. Strict: a bad line is an error. Else bad lines come back in _corrupt_record."""
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    return spark.read.schema(f"{schema}, _corrupt_record string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def read_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """Proposals of a run; a repeated id is an error."""
    rows = read_lines(spark, f"{path}/run_id={run_id}", PROPOSAL)
    twice = rows.groupBy("id").count().where("count > 1").first()
    if twice:
        raise ValueError(f"repeated proposal id: {twice.id}")
    return rows


def finding_id(tool: Column, primary: Column) -> Column:
    return F.concat(tool, F.lit(":"), F.substring(F.sha2(F.to_json(primary), 256), 1, 16))


def evidence_digest(evidence: Column) -> Column:
    """Digest of the sorted anchors of a finding's evidence."""
    anchor = lambda e: F.when(e["type"] == "quote", F.concat_ws(":", F.lit("quote"), e["scene"], e["hash"])).when(e["type"] == "metric", F.concat_ws(":", F.lit("metric"), e["name"], e["value"].cast("string"))).otherwise(F.concat(F.lit("reference:"), e["uri"]))
    return sha256(F.array_join(F.array_sort(F.transform(evidence, anchor)), "\n"))


def valid_findings(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, dropped tools): a tool whose run has a finding with a wrong id, quote hash or evidence hash is dropped whole."""
    quotes = F.forall("evidence", lambda e: (e["type"] != "quote") | (e["hash"] == sha256(normalize_quote(e["text"], compose=False))))
    ok = (F.col("id") == finding_id(F.col("tool"), F.col("primary"))) & quotes & (F.col("evidence_hash") == evidence_digest(F.col("evidence")))
    judged = rows.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    bad = judged.groupBy("tool").agg(F.bool_and("_ok").alias("ok")).where("not ok").select("tool")
    return judged.drop("_ok").join(bad, "tool", "left_anti"), bad


def write_run(rows: DataFrame, path: str, run_id: str, replace: bool = False) -> None:
    """Publishes a run as a partition, then points ``latest`` at it. Spark's committer makes either appear whole."""
    spark = rows.sparkSession
    rows.write.mode("overwrite" if replace else "errorifexists").json(f"{path}/run_id={run_id}")
    spark.createDataFrame([(run_id,)], "run_id string").coalesce(1).write.mode("overwrite").json(f"{path}/latest")


def latest_run(spark: SparkSession, path: str) -> str:
    return spark.read.schema("run_id string").json(f"{path}/latest").first()["run_id"]


def append(rows: DataFrame, path: str) -> None:
    """Adds to a journal."""
    rows.write.mode("append").json(path)


def write_findings(rows: DataFrame, path: str, run_id: str, order: str) -> DataFrame:
    """Publishes findings, the last of an id, and returns their counts by severity."""
    from folioscope.operators.events import last_wins

    kept = last_wins(rows, ["id"], [order])
    write_run(kept, path, run_id)
    return kept.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def write_cache(rows: DataFrame, path: str) -> None:
    """Adds (stage, key, value) rows; of a key written twice the first is read."""
    rows.select("stage", "key", "value").write.mode("append").partitionBy("stage").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return first_wins(spark.read.schema("key string, value string, stage string").parquet(path), ["stage", "key"], ["value"])


def to_findings(hits: DataFrame, chapter_ord: str, scene_ord: str, tool: str, run_id: str) -> DataFrame:
    """Findings from hits (chapter and scene ordinals, scene text, start, end, quote, id, principle): ids, hashes, lines."""
    place = F.concat(F.lit("ch"), F.lpad((F.col(chapter_ord) + 1).cast("string"), 2, "0"), F.lit("/s"), F.lpad((F.col(scene_ord) + 1).cast("string"), 2, "0"))
    head = F.substring("text", F.lit(1), F.col("start"))
    line = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1
    primary = F.struct(F.regexp_replace(F.lower("principle"), "[^a-z0-9]+", "-").alias("category"), F.concat_ws(":", place, F.col("id"), F.sha2("quote", 256)).alias("key"))
    quote = F.struct(F.lit("quote").alias("type"), place.alias("scene"), F.col("quote").alias("text"), sha256(normalize_quote(F.col("quote"), compose=False)).alias("hash"), *(F.lit(None).cast(t).alias(n) for n, t in (("name", "string"), ("value", "double"), ("baseline", "double"), ("unit", "string"), ("uri", "string"), ("note", "string"))))
    rows = hits.withColumns({"primary": primary, "evidence": F.array(quote), "line": line, "place": place})
    return rows.select(finding_id(F.lit(tool), F.col("primary")).alias("id"), F.lit(tool).alias("tool"), F.lit(run_id).alias("run_id"), F.col("primary.category").alias("category"), F.lit("low").alias("severity"), "primary", evidence_digest(F.col("evidence")).alias("evidence_hash"), "evidence", F.lit(None).cast("string").alias("suggestion"), "place", "line")


def route(findings: DataFrame, scenes: DataFrame) -> DataFrame:
    """id, n, state, start: the n-th quote of a finding against the n-th occurrence in its scene.

    States: applicable, ambiguous (the scene's name isn't unique), already-resolved (scene or occurrence gone).
    """
    from pyspark.sql import Window

    from folioscope.functions.matching import occurrences

    rows = findings.select("id", F.posexplode("evidence").alias("n", "e")).where("e.type = 'quote'").select("id", "n", F.col("e.scene").alias("scene_id"), F.col("e.text").alias("quote"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("id", "scene_id", "quote").orderBy("n")))
    named = scenes.groupBy("scene_id").agg(F.count(F.lit(1)).alias("k"), F.min("text").alias("text"))
    met = rows.join(named, "scene_id", "left")
    at = F.get(occurrences(F.col("text"), F.col("quote")), F.col("nth") - 1)
    state = F.when(F.col("k") > 1, "ambiguous").when(F.col("k").isNull() | at.isNull(), "already-resolved").otherwise("applicable")
    return met.select("id", "n", state.alias("state"), F.when(state == "applicable", at).alias("start"))


def report(run: DataFrame) -> DataFrame:
    """line, text: a run's report, its counts by impact and category and its proposals by place."""
    head = run.agg(F.concat(F.lit("Proposals: "), F.count(F.lit(1)).cast("string")).alias("text")).select(F.lit(0).alias("part"), F.lit("").alias("k"), "text")
    by = run.groupBy("impact", "category").agg(F.count(F.lit(1)).alias("n")).select(F.lit(1).alias("part"), F.concat_ws("/", "impact", "category").alias("k"), F.format_string("%s, %s: %d", "impact", "category", "n").alias("text"))
    each = run.select(F.lit(2).alias("part"), F.concat_ws("/", "chapter", "scene", "id").alias("k"), F.format_string("%s/%s [%s] %s → %s", "chapter", "scene", "id", "target", "replacement").alias("text"))
    return head.unionByName(by).unionByName(each).orderBy("part", "k").select("part", "text")
