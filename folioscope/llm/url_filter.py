"""URL filtering: a blocked Bloom filter of listed keys, then an exact hash join.

Lists hold canonical URLs (host and path) and rules (a host with its subdomains, and a path prefix). Both become
keys. A URL is expanded to the keys that could list it: itself, and each of its host suffixes with each of its path
prefixes, but only for the numbers of labels and characters that occur in the list. The filter's blocks of 256 bits
are rows (block, four words), so a probe reads one row; what passes is joined to the list by the whole key.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import UPPER, table

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, UPPER.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _bits(key: str, blocks: int) -> list[Column]:
    """Block number, and one mask of two bits for each of the block's four words."""
    block = F.expr(f"pmod(xxhash64({key}), {blocks}L)").alias("block")
    one = "shiftleft(1L, cast(shiftright(y, {}) & 63 as int))"
    return [block, *(F.expr(f"{one.format(12 * i)} | {one.format(12 * i + 6)}".replace("(y,", f"(xxhash64({key}, 7),")).alias(f"m{i}") for i in range(4))]


def blocked_bloom(keys: DataFrame, blocks: int, key: str = "key") -> DataFrame:
    """(block, m0..m3): the filter, a row for each block that has a key; 16 bits and more for each key."""
    return keys.select(*_bits(key, blocks)).groupBy("block").agg(*(F.bit_or(f"m{i}").alias(f"m{i}") for i in range(4)))


def probe(keys: DataFrame, bloom: DataFrame, blocks: int, key: str = "key", broadcast_blocks: int = 1_000_000) -> DataFrame:
    """Rows whose key may be in the filter: every row whose key is, and about one in a thousand of the others."""
    own = [c.alias(f"p{i}") for i, c in enumerate(_bits(key, blocks))]
    asked = keys.select("*", *own)
    near = F.broadcast(bloom) if blocks <= broadcast_blocks else bloom
    met = asked.join(near, asked["p0"] == near["block"])
    for i in range(4):
        met = met.where(F.col(f"m{i}").bitwiseAND(F.col(f"p{i + 1}")) == F.col(f"p{i + 1}"))
    return met.select(*keys.columns)


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    listed: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    broadcast_keys: int = 1_000_000,
) -> DataFrame:
    """One row for each input row: id, host, path, rule, listed (whether its canonical URL is), verdict.

    ``rules`` has (action, host, path), action being allow or block; ``listed`` has canonical URLs to block in a
    column ``url``. A rule fits its host and all subdomains if the path starts with the rule's; of several the longest
    (host and path together, then host) wins, of equal ones that say both, block. Where no rule fits, a listed URL is
    blocked and any other allowed. Null URLs and those without :// have an empty host and path, which a rule or list
    never names. Rows that repeat are judged alike, an empty table gives an empty result, other columns are ignored.
    """
    spark = pages.sparkSession
    host, path = host_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host.alias("host"), path.alias("path"))
    low = F.translate("host", UPPER, UPPER.lower())
    rules = rules.select("action", low.alias("rhost"), F.coalesce("path", F.lit("")).alias("rpath")).where("rhost <> ''")
    rules = rules.groupBy("rhost", "rpath").agg(F.max("action").alias("action"))  # block is the later word
    rules = rules.select(F.concat(F.lit("r:"), "rhost", "rpath").alias("key"), F.concat("rhost", "rpath").alias("rule"), "action", F.length("rhost").alias("host_len"), (F.size(F.split("rhost", r"\.")) ).alias("labels"), F.length("rpath").alias("chars"))
    shapes = [tuple(r) for r in rules.select("labels", "chars").distinct().collect()]  # a few hundred in any list
    keys = rules.select("key", "rule", "action", "host_len")
    if listed is not None:
        lhost, lpath = host_path(F.col("url"))
        named = listed.select(lhost.alias("h"), lpath.alias("p")).where("h <> ''").distinct()
        keys = keys.unionByName(named.select(F.concat(F.lit("u:"), "h", "p").alias("key")), allowMissingColumns=True)
    n = keys.count()
    blocks = max(1, n * 16 // 256 + 1)
    urls = rows.where("host <> ''").select("host", "path").distinct()
    labels = F.size(F.split("host", r"\."))
    every = F.from_json(F.lit(json.dumps([{"k": k, "c": c} for k, c in sorted(shapes)])), "array<struct<k:int,c:int>>")  # a constant
    fitting = F.filter(every, lambda x: (labels >= x["k"]) & (F.length("path") >= x["c"]))
    asked = F.transform(fitting, lambda x: F.concat(F.lit("r:"), F.call_function("substring_index", F.col("host"), F.lit("."), -x["k"]), F.substring("path", F.lit(1), x["c"])))
    if listed is not None:
        asked = F.concat(asked, F.array(F.concat(F.lit("u:"), "host", "path")))
    found = urls.select("host", "path", F.explode(asked).alias("key"))
    found = probe(found, blocked_bloom(keys, blocks), blocks)
    found = found.join(F.broadcast(keys) if n <= broadcast_keys else keys, "key")
    rank = F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "host_len", "rule", "action"))
    best = found.groupBy("host", "path").agg(F.max(rank).alias("best"), F.count(F.when(F.col("rule").isNull(), 1)).alias("exact"))
    out = rows.join(best, ["host", "path"], "left")
    is_listed = F.coalesce(F.col("exact"), F.lit(0)) > 0
    verdict = F.coalesce(F.col("best.action"), F.when(is_listed, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), is_listed.alias("listed"), verdict.alias("verdict"))


def op5(spark, sf_dir: str) -> DataFrame:
    """Query op5_url_filter: every row of ``pages`` against the fixed rules; the list has the canonical URLs of those that block."""
    rows = F.array(*(F.struct(*(F.lit(x).alias(c) for x, c in zip(r, ("action", "host", "path"), strict=True))) for r in RULES))
    rules = spark.range(1).select(F.inline(rows))
    listed = rules.where("action = 'block'").select(F.concat(F.lit("http://"), "host", "path").alias("url"))
    return judge_urls(table(spark, sf_dir, "pages"), rules, listed).drop("listed")


OP5_SQL = r"""
WITH r(action, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
     u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
     p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
     f AS (SELECT host, path, arg_max(rhost || rpath, len(rhost) + len(rpath)) AS rule, arg_max(action, len(rhost) + len(rpath)) AS action
           FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path)
SELECT page_id, p.host, p.path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN f ON p.host = f.host AND p.path = f.path
"""
