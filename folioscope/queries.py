"""Queries over the test tables, by name, each through the operators; ``ORACLE_SQL`` states the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.functions.matching import count, matches, numbered, occurrences, texts
from folioscope.functions.numbers import floor_quantiles, midpoint_median, total_or_null
from folioscope.operators import evaluate, events, guards, harness, intervals, lexicon, metrics, patterns, rules, segment, snapshot
from folioscope.sources import markup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
EN_STOP = lexicon.PACKS["en"].stopwords
_STOP = ", ".join(f"'{w}'" for w in EN_STOP)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def letters(column: str = "text"):
    return texts(F.lower(F.col(column)), r"\p{L}+")


# --- words, frequencies, metrics ---------------------------------------------------------------------------------

_W = r"SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word, generate_subscripts(regexp_extract_all(lower(text), '\p{L}+'), 1) AS pos FROM documents"


@query(r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents) GROUP BY word")
def word_counts(spark, d):
    return metrics.word_counts(t(spark, d, "documents"), letters())


def _drafts(rule, docs, settings=None):
    """doc_id, n, chars: drafts of a rule over whole texts, and the length of their targets."""
    found = rule(docs.select("doc_id", "text"), rules.Context(lexicon.PACKS["en"], settings or rules.Settings()))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("target")).alias("chars"))


@query(rf"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\p{{L}}+')) AS word, unnest(regexp_split_to_array(text, '\p{{L}}+')[2:]) AS gap, generate_subscripts(regexp_extract_all(text, '\p{{L}}+'), 1) AS pos FROM documents),
     c AS (SELECT *, coalesce(lower(word) <> lag(lower(word)) OVER o OR NOT regexp_full_match(lag(gap) OVER o, '[ \t\r\n]+'), true) AS new FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
     r AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM c),
     k AS (SELECT doc_id, run, min(lower(word)) AS word, count(*) AS n FROM r GROUP BY doc_id, run HAVING count(*) >= 2)
SELECT doc_id, sum(n // 2)::BIGINT AS n FROM k WHERE length(word) >= 2 AND word NOT IN ('that', 'had', 'chow', 'bye', 'so', 'no', 'yes', 'very') GROUP BY doc_id
""")
def doubled_words(spark, d):
    return _drafts(rules.doubled_word, t(spark, d, "documents")).select("doc_id", "n")


@query(r"""
WITH m AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}] {2,}[^\s]') || regexp_extract_all(text, '[^\s][ \t]+\r?(?:\n|$)') AS m,
                  regexp_extract_all(text, '[\p{L}\p{N}][ \t]+[,.;:!?](?:[^\p{N}]|$)') AS p FROM documents)
SELECT doc_id, (len(m) + len(p))::BIGINT AS n FROM m WHERE len(m) + len(p) > 0
""")
def whitespace_drafts(spark, d):
    return _drafts(rules.whitespace, t(spark, d, "documents")).select("doc_id", "n")


@query(r"""
WITH m AS (SELECT doc_id, regexp_extract_all(text, '"[^"\r\n]+"|“[^”\r\n]+”') AS m FROM documents),
     c AS (SELECT doc_id, list_filter(m, lambda x: x[1] = '"' OR regexp_matches(x, '‘[^’]+’')) AS m FROM m)
SELECT doc_id, len(m)::BIGINT AS n, len(array_to_string(m, ''))::BIGINT AS chars FROM c WHERE len(m) > 0
""")
def quote_drafts(spark, d):
    return _drafts(rules.quotes, t(spark, d, "documents"), rules.Settings(quotes="“”"))


@query(r"""
WITH m AS (SELECT doc_id, regexp_extract_all(text, '"[^"“”\r\n]+”|“[^"“”\r\n]+"') AS m FROM documents)
SELECT doc_id, len(m)::BIGINT AS n, len(array_to_string(m, ''))::BIGINT AS chars FROM m WHERE len(m) > 0
""")
def mixed_quote_drafts(spark, d):
    return _drafts(rules.mixed_quotes, t(spark, d, "documents"), rules.Settings(quotes="“”"))


@query(r"""
WITH f AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES (-1::BIGINT, 'A - b - c.. d...' || chr(10) || '- Well. e..f'), (-2, '-  yes 1..2'), (-3, '..x... y')) x(doc_id, text)),
     m AS (SELECT doc_id, len(regexp_extract_all(text, '\p{L} - \p{L}')) AS dash, len(regexp_extract_all(text, '[\p{L}\p{N}]+\.\.(?:[^.…]|$)')) AS stops, len(regexp_extract_all(text, '(?m)^-[ \t]+\p{L}')) AS speech FROM f)
SELECT doc_id, (dash + stops + speech)::BIGINT AS n FROM m WHERE dash + stops + speech > 0
""")
def dash_drafts(spark, d):
    extra = spark.createDataFrame([(-1, "A - b - c.. d...\n- Well. e..f"), (-2, "-  yes 1..2"), (-3, "..x... y")], "doc_id long, text string")
    docs = t(spark, d, "documents").select("doc_id", "text").unionByName(extra)
    return _drafts(rules.dashes_ellipsis, docs, rules.Settings(ellipsis=None)).select("doc_id", "n")


@query("""
WITH b AS (SELECT source, median(n_chars)::DOUBLE AS baseline, list_sort(list(n_chars)) AS v FROM documents GROUP BY source),
     s AS (SELECT source, baseline, baseline + greatest(1.5 * (v[1 + floor((len(v) - 1) * 0.75)::INT] - v[1 + floor((len(v) - 1) * 0.25)::INT]), 0.5 * baseline, 0.001) AS threshold FROM b)
SELECT doc_id, source, n_chars, baseline, threshold::DOUBLE AS threshold FROM documents JOIN s USING (source) WHERE n_chars > threshold
""")
def hotspots(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source", "n_chars")
    return metrics.hotspots(docs, ["source"], "n_chars").select("doc_id", "source", "n_chars", "baseline", "threshold")


@query(rf"""
WITH g AS (SELECT doc_id, word AS a, lead(word) OVER w AS b, lead(word, 2) OVER w AS c FROM ({_W}) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
     k AS (SELECT doc_id, a, b, c, count(*) AS n FROM g WHERE c IS NOT NULL AND (a NOT IN ({_STOP}))::INT + (b NOT IN ({_STOP}))::INT + (c NOT IN ({_STOP}))::INT >= 2 GROUP BY doc_id, a, b, c)
SELECT doc_id, sum(n - 1)::BIGINT AS repeats FROM k GROUP BY doc_id HAVING sum(n - 1) > 0
""")
def ngram_repeats(spark, d):
    docs = t(spark, d, "documents").select("doc_id", letters().alias("w"))
    return docs.select("doc_id", metrics.surplus_repeats(F.col("w"), EN_STOP).alias("repeats")).where("repeats > 0")


@query(rf"""
WITH c AS (SELECT doc_id, word, count(*) AS n FROM ({_W}) WHERE word NOT IN ({_STOP}) AND length(word) > 3 GROUP BY doc_id, word),
     k AS (SELECT doc_id, count(*) AS words FROM ({_W}) GROUP BY doc_id)
SELECT doc_id, round(max(n) * 1000.0 / words, 6)::DOUBLE AS rate FROM c JOIN k USING (doc_id) GROUP BY doc_id, words
""")
def top_content_word_rate(spark, d):
    docs = t(spark, d, "documents").select("doc_id", letters().alias("w"))
    content = F.filter("w", lambda w: ~w.isin(*EN_STOP) & (F.length(w) > 3))
    docs = docs.select("doc_id", F.size("w").alias("words"), metrics.top_count(content).alias("top")).where("top > 0")
    return docs.select("doc_id", F.round(F.col("top") * 1000.0 / F.col("words"), 6).alias("rate"))


@query(r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS s FROM documents),
     o AS (SELECT doc_id, line, array_to_string(regexp_extract_all(lower(s), '\p{L}+')[1:3], ' ') AS opening FROM l)
SELECT opening, count(*) AS n, count(DISTINCT doc_id) AS docs FROM o WHERE opening <> '' GROUP BY opening HAVING count(*) >= 2
""")
def opening_repetition(spark, d):
    lines = t(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("s"))
    opening = F.array_join(F.slice(letters("s"), 1, 3), " ")
    rows = lines.select("doc_id", opening.alias("opening")).where("opening <> ''")
    return rows.groupBy("opening").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs")).where("n >= 2")


@query(r"""
WITH c AS (SELECT lang, doc_id, unnest(regexp_extract_all(lower(text), '\p{L}{1,4}')) AS word, generate_subscripts(regexp_extract_all(lower(text), '\p{L}{1,4}'), 1) AS pos FROM documents),
     k AS (SELECT lang, word, count(*) AS n, min((doc_id, pos)) AS first FROM c GROUP BY lang, word),
     r AS (SELECT lang, word, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, first)::INT AS rank FROM k)
SELECT * FROM r WHERE rank <= 60
""")
def derived_stopwords(spark, d):
    return lexicon.derived_stopwords(t(spark, d, "documents").withColumn("ord", F.col("doc_id")), by=("lang",))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents),
     w AS (SELECT unnest((regexp_extract_all(s, '\p{L}+'))[2:]) AS name FROM l)
SELECT name, count(*) AS n FROM w WHERE regexp_matches(name, '^\p{Lu}') AND length(name) >= 2 GROUP BY name
""")
def proper_nouns(spark, d):
    lines = t(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("s"))
    rows = lines.select(F.explode(F.slice(texts(F.col("s"), r"\p{L}+"), 2, 1_000_000_000)).alias("name"))
    return rows.where(F.regexp_like("name", F.lit(r"^\p{Lu}")) & (F.length("name") >= 2)).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


PAIRS = (("thon", "then"), ("erest", "reest"), ("ander", "anther"), ("colour", "color"))


@query(r"""
WITH c AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents) WHERE word IN ('thon', 'then', 'erest', 'reest', 'ander', 'anther', 'colour', 'color') GROUP BY word),
     p(a, b) AS (VALUES ('thon', 'then'), ('erest', 'reest'), ('ander', 'anther'), ('colour', 'color')),
     q AS (SELECT a, b, coalesce(x.n, 0) AS na, coalesce(y.n, 0) AS nb FROM p LEFT JOIN c x ON x.word = a LEFT JOIN c y ON y.word = b)
SELECT CASE WHEN na >= nb THEN b ELSE a END AS loser, CASE WHEN na >= nb THEN a ELSE b END AS winner, least(na, nb) AS hits FROM q WHERE na > 0 AND nb > 0
""")
def spelling_majority(spark, d):
    counts = metrics.word_counts(t(spark, d, "documents"), letters())
    wanted = rules.spelling_preferences(counts, PAIRS, None)
    return wanted.join(counts, wanted["loser"] == counts["word"]).select("loser", "winner", F.col("n").alias("hits"))


@query(r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS s FROM documents WHERE lang = 'en'),
     w AS (SELECT doc_id, line, unnest((regexp_extract_all(s, '\p{L}+'))[2:]) AS name, generate_subscripts((regexp_extract_all(s, '\p{L}+'))[2:], 1) AS pos FROM l),
     c AS (SELECT name, count(*) AS n, min((doc_id, line, pos)) AS first FROM w WHERE regexp_matches(name, '^\p{Lu}\p{L}*$') AND length(name) >= 4 AND lower(name) NOT IN ('they', 'this', 'that', 'there', 'their', 'from', 'were', 'with') GROUP BY name),
     m AS (SELECT a.name, a.n, b.name AS candidate, b.n AS candidate_n, row_number() OVER (PARTITION BY a.name ORDER BY b.first) AS k FROM c a JOIN c b
           ON a.name <> b.name AND b.n > a.n AND levenshtein(lower(a.name), lower(b.name)) = 1
           AND ((length(a.name) = length(b.name) AND lower(a.name)[:-2] = lower(b.name)[:-2]) OR (length(a.name) >= 6 AND length(b.name) >= 6 AND lower(a.name)[1:6] = lower(b.name)[1:6]))
           AND NOT ((starts_with(lower(a.name), lower(b.name)) OR starts_with(lower(b.name), lower(a.name))) AND abs(length(a.name) - length(b.name)) = 1))
SELECT name, n, candidate, candidate_n FROM m WHERE k = 1
""")
def name_variants(spark, d):
    lines = t(spark, d, "documents").where("lang = 'en'").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    rows = lines.select("doc_id", "line", F.posexplode(F.slice(texts(F.col("s"), r"\p{L}+"), 2, 1_000_000_000)).alias("pos", "name"))
    rows = rows.where(F.regexp_like("name", F.lit(r"^\p{Lu}")))
    names = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "line", "pos")).alias("first"))
    return rules.similar_names(names, "en", EN_STOP)


@query(r"""
WITH m AS (SELECT doc_id, len(regexp_extract_all(text, '[.!?][ \t\r\n]+\p{Ll}')) AS hits FROM documents) SELECT doc_id, hits::BIGINT AS hits FROM m WHERE hits > 0
""")
def sentence_start_lower(spark, d):
    return t(spark, d, "documents").select("doc_id", count(F.col("text"), r"[.!?][ \t\r\n]+\p{Ll}").alias("hits")).where("hits > 0")


@query(r"""
WITH f AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES (-1::BIGINT, 'Look (here.'), (-2, 'A [b] {c'), (-3, 'odd " one'))),
     p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS p FROM f),
     c AS (SELECT doc_id, p, length(p) - length(replace(p, '(', '')) AS a, length(p) - length(replace(p, ')', '')) AS b, length(p) - length(replace(p, '[', '')) AS c, length(p) - length(replace(p, ']', '')) AS d,
                  length(p) - length(replace(p, '{', '')) AS e, length(p) - length(replace(p, '}', '')) AS g, length(p) - length(regexp_replace(p, '[“”«»"]', '', 'g')) AS q FROM p)
SELECT doc_id, kind, count(*) AS n FROM (SELECT doc_id, '()' AS kind FROM c WHERE a <> b UNION ALL SELECT doc_id, '[]' FROM c WHERE c <> d UNION ALL SELECT doc_id, '{}' FROM c WHERE e <> g UNION ALL SELECT doc_id, 'quotes' FROM c WHERE q % 2 = 1) GROUP BY doc_id, kind
""")
def balance_warnings(spark, d):
    extra = spark.createDataFrame([(-1, "Look (here."), (-2, "A [b] {c"), (-3, 'odd " one')], "doc_id long, text string")
    docs = t(spark, d, "documents").select("doc_id", "text").unionByName(extra)
    return rules.balance_warnings(docs, ["doc_id"]).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(r"""
SELECT median(n_chars)::DOUBLE AS midpoint, list_sort(list(n_chars))[1 + floor((count(*) - 1) * 0.25)::INT] AS q1, list_sort(list(n_chars))[1 + floor((count(*) - 1) * 0.75)::INT] AS q3,
       list_sort(list(n_chars))[1 + floor((count(*) - 1) * 0.5)::INT] AS low, lang FROM documents GROUP BY lang
""")
def quantiles_by_lang(spark, d):
    docs = t(spark, d, "documents").select("lang", "n_chars")
    return docs.groupBy("lang").agg(midpoint_median("n_chars").alias("midpoint")).join(floor_quantiles(docs, ["lang"], "n_chars", {"q1": 0.25, "low": 0.5, "q3": 0.75}), "lang")


@query(r"""
WITH w AS (SELECT source, lang, len(regexp_extract_all(text, '[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}|[0-9]+([.,][0-9]+)+|\p{L}+([''’]\p{L}+)*|[0-9]+')) AS words FROM documents WHERE NOT regexp_matches(text, '[0-9]'))
SELECT source, count(DISTINCT lang) AS chapters, count(*) AS scenes, sum(words)::BIGINT AS words FROM w GROUP BY source
""")
def book_totals(spark, d):
    """Documents without digits: the edges of numbers are no matter for SQL's patterns."""
    docs = t(spark, d, "documents").where(~F.regexp_like("text", F.lit("[0-9]")))
    return metrics.totals(docs, ["source"], "lang")


@query(r"""
SELECT lang, count(*) AS docs, count(*) FILTER (text LIKE '%;%') AS semicolons, sum(length(text) - length(replace(text, ',', '')))::BIGINT AS commas, sum(len(regexp_extract_all(text, '\?\s*(\n|$)')))::BIGINT AS questions FROM documents GROUP BY lang
""")
def mark_densities(spark, d):
    text = F.col("text")
    docs = t(spark, d, "documents")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.contains(text, F.lit(";"))).alias("semicolons"), F.sum((F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))).cast("long")).alias("commas"), F.sum(count(text, r"\?\s*(?:\n|\z)")).alias("questions"))


# --- spans, patterns, gates -------------------------------------------------------------------------------------

@query("SELECT item_id, doc_id, (position(b.text IN d.text) - 1)::INT AS start FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def evidence_located(spark, d):
    quotes = t(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    docs = t(spark, d, "documents").select("doc_id", "text")
    return evaluate.located(docs, quotes, "doc_id", "item_id").select("item_id", "doc_id", "start")


@query("""
WITH q AS (SELECT doc_id, len(string_split(text, 'tion')) - 1 AS every, len(string_split(array_to_string(regexp_extract_all(text, '"[^"]*"'), '|'), 'tion')) - 1 AS inside FROM documents)
SELECT doc_id, (every - inside)::BIGINT AS n FROM q WHERE every > inside
""")
def hits_not_in_dialogue(spark, d):
    docs, text = t(spark, d, "documents"), F.col("text")
    hits = docs.select("doc_id", F.explode(occurrences(text, F.lit("tion"))).alias("start")).withColumn("end", F.col("start") + 4)
    spoken = docs.select("doc_id", F.explode(matches(text, '"[^"]*"')).alias("m")).select("doc_id", "m.start", "m.end")
    return intervals.span_join(hits, spoken, ["doc_id"], "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


_H = r"(SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '\p{L}+tion')) AS quote FROM documents)"


@query(rf"WITH k AS (SELECT doc_id, count(*) AS n, count(DISTINCT quote[1:5]) AS kinds FROM {_H} GROUP BY doc_id) SELECT doc_id, n FROM k WHERE kinds >= 3")
def cluster_gate(spark, d):
    hits = t(spark, d, "documents").select("doc_id", F.explode(texts(F.lower("text"), r"\p{L}+tion")).alias("quote"))
    hits = hits.withColumns({"id": F.lit("tion"), "scope": F.lit("scene")})
    return patterns.cluster_gate(hits, ["doc_id"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(rf"""
WITH h AS (SELECT source, count(*) AS n FROM {_H} GROUP BY source), w AS (SELECT source, sum(len(regexp_extract_all(text, '\p{{L}}+'))) AS words FROM documents GROUP BY source)
SELECT source, n AS book_n FROM h JOIN w USING (source) WHERE n >= 5 AND n * 10000.0 / words >= 250
""")
def rate_gate(spark, d):
    docs = t(spark, d, "documents")
    hits = docs.select("source", F.explode(texts(F.lower("text"), r"\p{L}+tion")).alias("quote")).withColumns({"id": F.lit("tion"), "scope": F.lit("book")})
    words = docs.groupBy("source").agg(F.sum(count(F.col("text"), r"\p{L}+")).alias("words"))
    return patterns.rate_gate(hits, words, ["source"], rate=250.0).select("source", "book_n").distinct()


@query(r"""
WITH l AS (SELECT doc_id, len(string_split(text, 'tion')) - 1 AS n, position('tion' IN text) - 1 AS first FROM documents) SELECT doc_id, n::BIGINT AS n, first::INT AS first FROM l WHERE n > 0
""")
def literal_occurrences(spark, d):
    starts = occurrences(F.col("text"), F.lit("tion"))
    docs = t(spark, d, "documents").where(F.contains("text", F.lit("tion"))).select("doc_id", starts.alias("s"))
    return docs.select("doc_id", F.size("s").cast("long").alias("n"), F.col("s")[0].alias("first"))


@query("""
WITH g AS (SELECT doc_id, unnest(string_split(text, 'the')) AS gap, generate_subscripts(string_split(text, 'the'), 1) AS i FROM documents),
     m AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id) AS n, sum(length(gap)) OVER w AS chars, sum(length(gap) - length(replace(gap, chr(10), ''))) OVER w AS breaks FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, (chars + 3 * (i - 1))::INT AS start, (i - 1)::INT AS ordinal, (1 + breaks)::INT AS line FROM m WHERE i < n
""")
def occurrence_ordinals(spark, d):
    return t(spark, d, "documents").select("doc_id", F.explode(numbered(F.col("text"), F.lit("the"))).alias("m")).select("doc_id", "m.*")


_I = "(SELECT user_id, event_id, epoch_us(ts) AS s, epoch_us(ts) + 21600000000 AS e FROM events)"


def _spans(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return t(spark, d, "events").select("user_id", "event_id", at.alias("start"), (at + 21_600_000_000).alias("end"))


@query(f"""
WITH x AS (SELECT user_id, s, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {_I})
SELECT user_id, count(*) FILTER (m IS NULL OR s >= m) AS n FROM x GROUP BY user_id
""")
def collapse_overlaps(spark, d):
    return intervals.collapsed_count(_spans(spark, d), ["user_id"])


@query(f"""
WITH RECURSIVE x AS (SELECT user_id, s, e, event_id, row_number() OVER (PARTITION BY user_id ORDER BY s, e, event_id) AS i FROM {_I}),
     f AS (SELECT user_id, i, event_id, e AS last, true AS accepted FROM x WHERE i = 1
           UNION ALL SELECT x.user_id, x.i, x.event_id, CASE WHEN x.s >= f.last THEN x.e ELSE f.last END, x.s >= f.last FROM f JOIN x ON x.user_id = f.user_id AND x.i = f.i + 1)
SELECT user_id, event_id, accepted FROM f
""")
def greedy_schedule(spark, d):
    return intervals.schedule(_spans(spark, d), ["user_id"], "event_id").select("user_id", "event_id", "accepted")


@query(f"""
WITH x AS (SELECT * FROM {_I}) SELECT a.event_id AS a, b.event_id AS b FROM x a JOIN x b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.s < b.e AND a.e > b.s
""")
def overlapping_pairs(spark, d):
    s = _spans(spark, d)
    met = intervals.span_join(s, s, ["user_id"], width=86_400_000_000).where("event_id < b_event_id")
    return met.select(F.col("event_id").alias("a"), F.col("b_event_id").alias("b"))


@query(r"""
WITH RECURSIVE l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS s FROM documents),
     f AS (SELECT doc_id, i, CASE WHEN length(s) >= 500 THEN 0 ELSE length(s) END AS held, (length(s) >= 500)::INT AS nxt, 0 AS grp FROM l WHERE i = 1
           UNION ALL SELECT l.doc_id, l.i, CASE WHEN (CASE WHEN f.held > 0 AND f.held + length(l.s) > 500 THEN length(l.s) ELSE f.held + length(l.s) END) >= 500 THEN 0 ELSE (CASE WHEN f.held > 0 AND f.held + length(l.s) > 500 THEN length(l.s) ELSE f.held + length(l.s) END) END,
                  f.nxt + (f.held > 0 AND f.held + length(l.s) > 500)::INT + ((CASE WHEN f.held > 0 AND f.held + length(l.s) > 500 THEN length(l.s) ELSE f.held + length(l.s) END) >= 500)::INT,
                  f.nxt + (f.held > 0 AND f.held + length(l.s) > 500)::INT
           FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i + 1)
SELECT doc_id, grp::INT AS grp, count(*) AS lines FROM f GROUP BY doc_id, grp
""")
def budget_windows(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda s: F.length(s)).alias("sizes"))
    groups = docs.select("doc_id", F.explode(intervals.packed(F.col("sizes"), 500)).alias("grp"))
    return groups.groupBy("doc_id", "grp").agg(F.count(F.lit(1)).alias("lines"))


# --- logs, runs, decisions --------------------------------------------------------------------------------------

@query("SELECT user_id, arg_max(event_type, event_id) AS status, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_status(spark, d):
    log = t(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("status"))
    return events.last_wins(log, ["user_id"], ["event_id"]).select("user_id", "status", "event_id")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS hash FROM documents GROUP BY text")
def first_wins_dedupe(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return events.first_wins(docs, ["hash"], ["doc_id"]).select("doc_id", "hash")


@query("""
WITH s AS (SELECT user_id AS id, arg_max(event_type, event_id) AS st, arg_max(value, event_id) AS ev FROM events GROUP BY user_id), f AS (SELECT event_id, user_id AS id, round(value, 6) AS ev FROM events)
SELECT event_id FROM f LEFT JOIN s USING (id) WHERE NOT coalesce(st IN ('error', 'signup') AND (s.ev IS NULL OR round(s.ev, 6) = f.ev), false)
""")
def status_suppression(spark, d):
    log = t(spark, d, "events")
    statuses = log.select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.round("value", 6).alias("evidence"), "event_id")
    findings = log.select("event_id", F.col("user_id").alias("id"), F.round("value", 6).alias("evidence")).withColumnRenamed("event_id", "finding")
    return events.suppressed(statuses, findings, "id", ["event_id"], ("error", "signup")).select(F.col("finding").alias("event_id"))


@query("""
WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS e FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS e FROM orders WHERE o_orderkey % 4 <> 0)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'new' WHEN b.id IS NULL THEN 'resolved' WHEN a.e IS NOT DISTINCT FROM b.e THEN 'unchanged' ELSE 'updated' END AS state FROM a FULL JOIN b ON a.id = b.id
""")
def run_diff(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("evidence"))
    later = o.where("id % 4 <> 0").withColumn("evidence", F.when(F.col("id") % 5 == 0, "X").otherwise(F.col("evidence")))
    return snapshot.run_diff(o.where("id % 3 <> 0"), later)


@query("""
WITH r AS (SELECT event_id, user_id, coalesce(value, 0) AS amount FROM events WHERE event_type = 'signup'), s AS (SELECT event_id - event_id % 2 AS event_id, sum(value) AS cost FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT user_id, round(sum(coalesce(cost, amount)), 6) AS spent, count(*) FILTER (cost IS NULL) AS open FROM r LEFT JOIN s USING (event_id) GROUP BY user_id
""")
def unsettled_spend(spark, d):
    e = t(spark, d, "events")
    reserved = e.where("event_type = 'signup'").select("event_id", "user_id", F.coalesce("value", F.lit(0.0)).alias("amount"))
    settled = e.where("event_type = 'purchase'").select((F.col("event_id") - F.col("event_id") % 2).alias("event_id"), F.col("value").alias("cost"))
    return events.spent(reserved, settled, "event_id", ["user_id"]).withColumn("spent", F.round("spent", 6))


@query("""
WITH l AS (SELECT user_id, event_id, CASE WHEN event_type IN ('error', 'signup') THEN 'withdraw' ELSE 'accept' END AS ev, event_type AS payload FROM events),
     c AS (SELECT user_id, max(event_id) FILTER (ev = 'withdraw') AS closed FROM l GROUP BY user_id),
     a AS (SELECT l.* FROM l JOIN c USING (user_id) WHERE ev = 'accept' AND (closed IS NULL OR event_id > closed))
SELECT user_id, min(event_id) AS first_at, max(event_id) AS last_at, count(*) AS n, arg_min(payload, event_id) AS payload, count(DISTINCT payload) > 1 AS conflict FROM a GROUP BY user_id
""")
def accept_withdraw(spark, d):
    kind = F.when(F.col("event_type").isin("error", "signup"), "withdraw").otherwise("accept")
    log = t(spark, d, "events").select("user_id", "event_id", kind.alias("event"), F.col("event_type").alias("payload"))
    return events.active_acceptances(log, "user_id", "event_id")


@query("SELECT user_id, (count(*) FILTER (event_type <> 'error') >= floor(count(*) / 2) + 1) AS accepted, count(*) AS votes FROM events GROUP BY user_id")
def vote_majority(spark, d):
    votes = t(spark, d, "events").select("user_id", (F.col("event_type") != "error").alias("yes"))
    return evaluate.majority(votes, ["user_id"], "yes")


@query("""
WITH v AS (SELECT user_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
SELECT user_id, bool_and(ok) AS unanimous, coalesce(min(i) FILTER (NOT ok), count(*))::INT AS passes FROM v GROUP BY user_id
""")
def unanimity(spark, d):
    votes = t(spark, d, "events").select("user_id", "event_id", (F.col("event_type") != "error").alias("yes"))
    return evaluate.unanimity(votes, ["user_id"], "event_id", "yes")


@query("SELECT event_type, CASE WHEN bool_or(value IS NULL) THEN NULL ELSE round(sum(value), 4) END AS cost, count(*) AS calls FROM events GROUP BY event_type")
def ledger_totals(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.round(total_or_null(F.col("value"), F.lit(True)), 4).alias("cost"), F.count(F.lit(1)).alias("calls"))


@query("""
WITH RECURSIVE c AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'preserved' WHEN 'signup' THEN 'changed' END AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
     f AS (SELECT user_id, i, 1 AS n, (v IS NOT NULL) AS closes, coalesce(v, 'failed') AS v FROM c WHERE i = 1
           UNION ALL SELECT c.user_id, c.i, CASE WHEN f.closes THEN 1 ELSE f.n + 1 END, c.v IS NOT NULL OR (CASE WHEN f.closes THEN 1 ELSE f.n + 1 END) >= 3, coalesce(c.v, 'failed') FROM f JOIN c ON c.user_id = f.user_id AND c.i = f.i + 1)
SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY i) - 1)::INT AS pass, v AS verdict, n::INT AS attempts FROM f WHERE closes
""")
def call_passes(spark, d):
    verdict = F.when(F.col("event_type") == "purchase", "preserved").when(F.col("event_type") == "signup", "changed")
    calls = t(spark, d, "events").select("user_id", "event_id", verdict.alias("verdict"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("ms"))
    return events.passes(calls, "user_id", "event_id").select("user_id", "pass", "verdict", "attempts")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def cache_misses(spark, d):
    units = t(spark, d, "documents").select(F.col("doc_id").alias("key"))
    cache = t(spark, d, "labels").select(F.col("doc_id").alias("key"), F.lit("rules").alias("stage"), F.col("quality").alias("value")).distinct()
    return snapshot.split_by_cache(units, cache, "rules")[1].select(F.col("key").alias("doc_id")).distinct()


@query("""
WITH a AS (SELECT source AS file, sha256(string_agg(sha256(text), '' ORDER BY sha256(text))) AS hash FROM documents GROUP BY source) SELECT NOT EXISTS (SELECT * FROM (SELECT file, hash FROM a EXCEPT SELECT file, hash FROM a WHERE file <> 'src3')) AS same
""")
def file_sets_agree(spark, d):
    docs = snapshot.file_hashes(t(spark, d, "documents").select(F.col("source").alias("file"), F.sha2("text", 256).alias("hash")))
    return snapshot.same_files(docs, docs.where("file <> 'src3'"))


@query("SELECT source AS file, count(*) AS n FROM documents GROUP BY source")
def outputs_changed(spark, d):
    """Of each source's documents, those whose edited text isn't what is there: all, as each text gets an end."""
    docs = t(spark, d, "documents").select("doc_id", "source", "text")
    there = docs.select("doc_id", F.sha2("text", 256).alias("content_hash"))
    now = docs.withColumn("text", F.concat("text", F.lit(".")))
    return snapshot.changed_only(now, there, "doc_id").groupBy(F.col("source").alias("file")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1")
def orphan_outputs(spark, d):
    expected = t(spark, d, "labels").where("quality = 1").select("doc_id").distinct()
    return snapshot.orphans(t(spark, d, "documents").select("doc_id"), expected, "doc_id").distinct()


@query("""
WITH o AS (SELECT o_orderkey AS id, o_custkey % 97 + 5 AS old, o_custkey % 89 + 5 AS new, o_orderkey % 50 AS job, row_number() OVER (PARTITION BY o_orderkey % 50 ORDER BY o_orderkey) * 200 AS start FROM orders)
SELECT id, (start + coalesce(sum(new - old) OVER (PARTITION BY job ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "at" FROM o
""")
def shifted_edits(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 97 + 5).alias("old"), (F.col("o_custkey") % 89 + 5).alias("new"), (F.col("o_orderkey") % 50).alias("job"))
    o = o.withColumn("start", F.row_number().over(Window.partitionBy("job").orderBy("id")).cast("long") * 200)
    o = o.select("id", "job", "start", (F.col("start") + F.col("old")).alias("end"), F.expr("repeat('x', cast(new as int))").alias("replacement"))
    return intervals.shifted(o, ["job"]).select("id", "at")


_T = "(SELECT conv_id, turn, text AS a, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)"


def _texts(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("a"))
    return c.withColumn("b", F.lag("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null")


@query(rf"SELECT conv_id, turn, regexp_replace(a, '[\p{{L}}\p{{N}}\s]', '', 'g') AS marks FROM {_T} WHERE b IS NOT NULL")
def mark_profiles(spark, d):
    return _texts(spark, d).select("conv_id", "turn", X.mark_profile(F.col("a")).alias("marks"))


@query(rf"""SELECT conv_id, turn, trim(regexp_replace(trim('“' || a || '»'), '^[«“"''‘„]+|[»”"''’“]+$', '', 'g')) AS bare FROM {_T} WHERE b IS NOT NULL""")
def stripped_quotes(spark, d):
    return _texts(spark, d).select("conv_id", "turn", X.strip_quotes(F.concat(F.lit("“"), F.col("a"), F.lit("»"))).alias("bare"))


@query(rf"SELECT conv_id, turn, regexp_replace(replace(lower(a), '’', ''''), '\s+', ' ', 'g') AS key FROM {_T} WHERE b IS NOT NULL")
def dictionary_keys(spark, d):
    return _texts(spark, d).select("conv_id", "turn", X.dictionary_key(F.col("a")).alias("key"))


@query(rf"""
WITH h AS (SELECT conv_id, turn, sha256(a) AS h FROM {_T} WHERE b IS NOT NULL)
SELECT conv_id, turn, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS uuid FROM h
""")
def digest_ids(spark, d):
    return _texts(spark, d).select("conv_id", "turn", X.uuid_of(F.col("a")).alias("uuid"))


@query(r"""
WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '(\r?\n){2,}')) AS p FROM documents) SELECT doc_id, count(*) AS n, sum(length(p))::BIGINT AS chars FROM p WHERE trim(regexp_replace(p, '\s+', ' ', 'g')) <> '' GROUP BY doc_id
""")
def paragraph_counts(spark, d):
    rows = segment.paragraphs_table(t(spark, d, "documents"), ["doc_id"])
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).cast("long").alias("chars"))


@query(r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+([''’-][\p{L}\p{N}]+)*'))::BIGINT AS n FROM documents WHERE len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+([''’-][\p{L}\p{N}]+)*')) > 0")
def content_token_counts(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.size(segment.content_tokens(F.col("text"))).cast("long").alias("n"))
    return docs.where("n > 0")


@query("""
WITH h AS (SELECT user_id, event_type, epoch_us(ts) AS s, epoch_us(ts) + 3600000000 AS e, event_id FROM events), k AS (SELECT user_id, s, e, event_id FROM h WHERE event_type = 'purchase'), w AS (SELECT user_id, s - 7200000000 AS s, e + 7200000000 AS e, event_id AS w FROM h WHERE event_type = 'signup')
SELECT DISTINCT k.event_id FROM k JOIN w ON k.user_id = w.user_id AND k.s >= w.s AND k.e <= w.e
""")
def spans_within(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    e = t(spark, d, "events").select("user_id", "event_id", "event_type", at.alias("start"), (at + 3_600_000_000).alias("end"))
    inner = e.where("event_type = 'purchase'").drop("event_type")
    wide = e.where("event_type = 'signup'").select("user_id", (F.col("start") - 7_200_000_000).alias("start"), (F.col("end") + 7_200_000_000).alias("end"))
    return intervals.span_join(inner, wide, ["user_id"], "left_semi", test="within").select("event_id").distinct()


@query("""
WITH v AS (SELECT user_id AS id, count(*) FILTER (event_type <> 'error') AS yes, count(*) AS n FROM events GROUP BY user_id) SELECT id FROM v WHERE yes >= n // 2 + 1
""")
def confirmed_candidates(spark, d):
    from folioscope.plans import review

    e = t(spark, d, "events")
    return review.confirmed(e.select(F.col("user_id").alias("id")).distinct(), e.select(F.col("user_id").alias("id"), (F.col("event_type") != "error").alias("yes")))


@query("SELECT event_type AS model, round(sum(event_id % 100 * 3 + user_id % 50 * 7) / 1000000.0, 6) AS cost, count(*) AS calls FROM events WHERE event_type <> 'view' GROUP BY 1 UNION ALL SELECT 'view', NULL, count(*) FROM events WHERE event_type = 'view' HAVING count(*) > 0")
def priced_calls(spark, d):
    from folioscope.plans import review

    calls = t(spark, d, "events").select(F.col("event_type").alias("model"), (F.col("event_id") % 100).alias("tokens_in"), (F.col("user_id") % 50).alias("tokens_out"))
    prices = calls.select("model").distinct().where("model <> 'view'").select("model", F.lit(3.0).alias("price_in"), F.lit(7.0).alias("price_out"))
    out = review.ledger(calls, prices).groupBy("model").agg(F.round(F.sum("cost"), 6).alias("cost"), F.count(F.lit(1)).alias("calls"))
    return out


# --- evaluation -------------------------------------------------------------------------------------------------

@query("""
WITH d AS (SELECT lang, quality, toxic, n_chars > 2000 AS accepted FROM labels JOIN documents USING (doc_id))
SELECT coalesce(lang, 'all') AS lang, count(*) AS cases, count(*) FILTER (quality = 1 AND accepted) AS valid_accepted, count(*) FILTER (quality = 0 AND accepted) AS harmful_accepted,
       round(count(*) FILTER (quality = 1 AND accepted) / nullif(count(*) FILTER (quality = 1), 0), 3) AS acceptance_rate, round(count(*) FILTER (quality = 0 AND NOT accepted) / nullif(count(*) FILTER (quality = 0), 0), 3) AS rejection_rate
FROM d GROUP BY GROUPING SETS ((lang), ())
""")
def confusion_metrics(spark, d):
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    rows = rows.select("lang", (F.col("quality") == 1).alias("valid"), (F.col("n_chars") > 2000).alias("accepted"))
    return evaluate.confusion(rows, ["lang"], "valid", "accepted").withColumn("lang", F.coalesce("lang", F.lit("all")))


@query("""
WITH s AS (SELECT l_suppkey AS id, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY l_suppkey)
SELECT id FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.n >= a.n AND b.revenue >= a.revenue AND b.discount <= a.discount AND (b.n > a.n OR b.revenue > a.revenue OR b.discount < a.discount))
""")
def pareto_suppliers(spark, d):
    s = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"))
    return evaluate.pareto(s, more=["n", "revenue"], less=["discount"]).select("id")


@query("""
SELECT o_orderkey AS mutation, arg_max(l_linenumber, (l_returnflag, -l_linenumber)) AS best FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
""")
def best_match_argmax(spark, d):
    pairs = t(spark, d, "orders").join(t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return evaluate.best_match(pairs, "o_orderkey", F.col("l_returnflag"), "l_linenumber").select(F.col("o_orderkey").alias("mutation"), F.col("l_linenumber").alias("best"))


@query("""
SELECT quality::VARCHAR AS kind, count(*) AS total, count(*) FILTER (toxic = 0) AS recalled, round(avg((toxic = 0)::INT), 6) AS rate FROM labels GROUP BY quality
""")
def recall_by_type(spark, d):
    rows = t(spark, d, "labels").select(F.col("quality").cast("string").alias("kind"), (F.col("toxic") == 0).alias("hit"))
    return evaluate.recall(rows, ["kind"], "hit").withColumn("rate", F.round("rate", 6))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most FROM events GROUP BY event_type HAVING count(value) >= 10")
def run_spread(spark, d):
    out = evaluate.spread(t(spark, d, "events"), ["event_type"], "value", least=10)
    return out.select("event_type", *(F.round(c, 6).alias(c) for c in ("mean", "least", "most")))


_C = r"""(SELECT conv_id, turn, regexp_extract_all(lower(text), '\p{L}+') AS w, lag(regexp_extract_all(lower(text), '\p{L}+')) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)"""


def _turns(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", letters().alias("w"))
    return c.withColumn("before", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null")


@query(f"SELECT conv_id, turn, list_sort(w) <> list_sort(before) AS changed FROM {_C} WHERE before IS NOT NULL")
def multiset_change(spark, d):
    return _turns(spark, d).select("conv_id", "turn", (~X.multiset_equal(F.col("w"), F.col("before"))).alias("changed"))


@query(f"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(w, lambda x: NOT list_contains(before, x)))), ' ') AS inserted FROM {_C} WHERE before IS NOT NULL")
def inserted_words(spark, d):
    return _turns(spark, d).select("conv_id", "turn", X.inserted_key(F.col("before"), F.col("w")).alias("inserted"))


# --- text functions ---------------------------------------------------------------------------------------------

@query("SELECT doc_id, 'sha256:' || sha256(text) AS hash, substr(sha256('{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}'), 1, 16) AS id FROM documents")
def sha_identity(spark, d):
    docs = t(spark, d, "documents")
    return docs.select("doc_id", X.sha256(F.col("text")).alias("hash"), X.stable_id(F.struct("lang", "source")).alias("id"))


@query(r"SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')) AS quote FROM documents")
def normalized_quotes(spark, d):
    return t(spark, d, "documents").select("doc_id", X.normalize_quote(F.col("text")).alias("quote"))


@query(r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages
""")
def strip_markup(spark, d):
    return t(spark, d, "pages").select("page_id", markup.plain(F.col("html")).alias("text"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part".replace("\\\\", "\\"))
def slugs(spark, d):
    return t(spark, d, "part").select("p_partkey", X.slug(F.col("p_name")).alias("slug"))


@query("SELECT doc_id, (length(text) - length(replace(text, 'e', 'ee')))::INT AS delta, replace(text, 'ed ', 'ing ') AS text FROM documents")
def edit_plan_splice(spark, d):
    text = F.col("before")  # a name of its own: the result's text is another
    edits = F.transform(occurrences(text, F.lit("ed ")), lambda s: F.struct(s.alias("start"), (s + 3).alias("end"), F.lit("ing ").alias("replacement")))
    docs = t(spark, d, "documents").select("doc_id", F.col("text").alias("before"))
    return docs.select("doc_id", (F.length(text) - F.length(F.replace(text, F.lit("e"), F.lit("ee")))).alias("delta"), X.splice(text, edits).alias("text"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '^\\p{Lu}') THEN upper(p_name[1]) || p_name[2:] ELSE p_name END AS name FROM part".replace("\\\\", "\\"))
def case_preserved(spark, d):
    return t(spark, d, "part").select("p_partkey", X.like_case(F.col("p_brand"), F.col("p_name")).alias("name"))


@query(r"""
WITH s AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS scene_ord, unnest(string_split(text, chr(10))) AS s FROM documents)
SELECT doc_id, scene_ord::INT AS scene_ord, length(s)::INT AS size, s = '' AS blank FROM s WHERE s <> ''
""")
def line_scenes(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n<!-- scene: x -->\n").alias("text"))
    rows = segment.scenes_table(docs, ["doc_id"])
    line = F.regexp_replace("text", "\n$", "")
    rows = rows.select("doc_id", "scene_ord", F.length(line).alias("size"), (line == "").alias("blank"))
    return rows.where("not blank")


@query(r"""
SELECT event_type, props->>'$.k' AS k, count(*) AS n FROM events WHERE props IS NOT NULL GROUP BY ALL
""")
def parsed_json(spark, d):
    fence = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.col("props"))
    rows = t(spark, d, "events").where("props is not null").select("event_type", F.get_json_object(X.fenced(fence), "$.k").alias("k"))
    return rows.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH x AS (SELECT conv_id, turn, role, text, lag(text) OVER w AS b, lead(text) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, coalesce(right(b, 1200), '') AS before, coalesce(left(a, 1200), '') AS after FROM x
""")
def context_windows(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t(spark, d, "conversations")
    before, after = F.lag("text").over(w), F.lead("text").over(w)
    return c.select("conv_id", "turn", F.coalesce(F.right(before, F.lit(1200)), F.lit("")).alias("before"), F.coalesce(F.left(after, F.lit(1200)), F.lit("")).alias("after"))


@query(f"""
WITH RECURSIVE x AS (SELECT user_id, event_type, s, e, i.event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY i.event_id) AS k FROM {_I} i JOIN (SELECT event_id, event_type FROM events) t ON t.event_id = i.event_id),
     f AS (SELECT user_id, event_type, k, event_id, [{{'s': s, 'e': e}}] AS kept, true AS ok FROM x WHERE k = 1
           UNION ALL SELECT x.user_id, x.event_type, x.k, x.event_id, CASE WHEN len(list_filter(f.kept, lambda y: x.s < y.e AND x.e > y.s)) = 0 THEN list_append(f.kept, {{'s': x.s, 'e': x.e}}) ELSE f.kept END,
                  len(list_filter(f.kept, lambda y: x.s < y.e AND x.e > y.s)) = 0 FROM f JOIN x ON x.user_id = f.user_id AND x.event_type = f.event_type AND x.k = f.k + 1)
SELECT event_id FROM f WHERE ok
""")
def kept_findings(spark, d):
    spans = _spans(spark, d).join(t(spark, d, "events").select("event_id", "event_type"), "event_id")
    return intervals.first_kept(spans, ["user_id", "event_type"], "event_id").select("event_id")


@query("""
WITH l AS (SELECT o_orderkey AS id, o_orderstatus AS target FROM orders WHERE o_orderkey % 3 = 0), h AS (SELECT o_orderkey AS id, o_orderpriority AS target FROM orders WHERE o_orderkey % 5 = 0),
     a AS (SELECT id, target, false AS accepted FROM l WHERE id NOT IN (SELECT id FROM h) UNION ALL SELECT id, target, true FROM h)
SELECT id, target, CASE WHEN accepted THEN CASE WHEN id % 2 = 0 THEN 'accepted' WHEN id % 7 = 0 THEN 'conflict' ELSE 'stale' END WHEN id % 4 = 0 THEN 'rejected' WHEN id % 11 <> 0 THEN 'pending' ELSE 'stale' END AS status FROM a
""")
def review_states(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority")
    latest = o.where("id % 3 = 0").select("id", F.col("o_orderstatus").alias("target"))
    history = o.where("id % 5 = 0").select("id", F.col("o_orderpriority").alias("target"))
    results = o.where("id % 2 = 0 or id % 7 = 0").select("id", F.when(F.col("id") % 2 == 0, "applied").otherwise("conflict").alias("status"))
    places = o.where("id % 11 <> 0").select("id", F.lit(True).alias("found"))
    return harness.review_view(latest, history, results, o.where("id % 4 = 0").select("id"), places)


@query(f"""
WITH x AS (SELECT i.user_id AS scene, event_type AS principle, s, e, i.event_id FROM {_I} i JOIN (SELECT event_id, event_type FROM events) t ON t.event_id = i.event_id),
     h AS (SELECT * FROM x WHERE event_id % 2 = 0), g AS (SELECT * FROM x WHERE event_id % 3 = 0),
     v AS (SELECT h.event_id, CASE WHEN h.scene % 10 = 0 THEN 'k' WHEN EXISTS (SELECT 1 FROM g WHERE g.scene = h.scene AND h.s < g.e AND h.e > g.s AND g.principle = h.principle) THEN 't'
                  WHEN EXISTS (SELECT 1 FROM g WHERE g.scene = h.scene AND h.s < g.e AND h.e > g.s) THEN 'n' ELSE 'u' END AS v FROM h)
SELECT count(*) AS findings, count(*) FILTER (v = 't') AS tp, count(*) FILTER (v = 'n') AS near, count(*) FILTER (v = 'k') AS fp_on_keep, count(*) FILTER (v = 'u') AS unlabeled,
       round((SELECT count(*) FROM g WHERE EXISTS (SELECT 1 FROM h WHERE g.scene = h.scene AND h.s < g.e AND h.e > g.s AND g.principle = h.principle)) / (SELECT count(*) FROM g), 6) AS recall FROM v
""")
def guide_scores(spark, d):
    x = _spans(spark, d).join(t(spark, d, "events").select("event_id", F.col("event_type").alias("principle")), "event_id").withColumnRenamed("user_id", "scene")
    row = harness.guide_score(x.where("event_id % 2 = 0"), x.where("event_id % 3 = 0"), x.where("scene % 10 = 0").select("scene"))
    return row.select("findings", "tp", "near", "fp_on_keep", "unlabeled", F.round("recall", 6).alias("recall"))


@query("""
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
     h AS (SELECT source, n, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split('seed:' || source, ''), lambda c: ord(c)::BIGINT)), lambda a, c: (xor(a, c) * 16777619) % 4294967296) AS h FROM s)
SELECT source, h AS hash, h % n AS pick FROM h
""")
def seeded_pick(spark, d):
    per = t(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    per = per.withColumn("hash", X.fnv1a(F.concat(F.lit("seed:"), "source")))
    return per.select("source", "hash", F.pmod("hash", "n").alias("pick"))


@query("""
WITH c AS (SELECT user_id, list(CASE WHEN event_type IN ('click', 'view') THEN 'preserved' ELSE 'changed' END ORDER BY event_id) AS v, user_id % 2 = 0 AS valid, user_id % 3 = 0 AS harm FROM events GROUP BY user_id),
     a AS (SELECT *, len(v) >= 2 AND v[1] = 'preserved' AND v[2] = 'preserved' AS yes FROM c)
SELECT count(*) AS cases, count(*) FILTER (NOT valid AND harm AND yes) AS harmful_accepted, count(*) FILTER (NOT valid AND NOT harm AND yes) AS unnecessary_accepted, count(*) FILTER (valid AND NOT yes) AS valid_rejected,
       round(count(*) FILTER (valid AND yes) / count(*) FILTER (valid), 3) AS correct_acceptance_rate, round(count(*) FILTER (NOT valid AND NOT yes) / count(*) FILTER (NOT valid), 3) AS correct_rejection_rate,
       round(count(*) FILTER (NOT valid AND harm AND NOT yes) / count(*) FILTER (NOT valid AND harm), 3) AS harmful_rejection_rate, round(count(*) * 2.0, 6)::DOUBLE AS cost FROM a
""")
def pass_rates(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type").isin("click", "view"), "preserved").otherwise("changed").alias("v"))
    lists = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "v"))), lambda x: x["v"]).alias("verdicts"))
    cases = lists.withColumns({"costs": F.transform("verdicts", lambda v: F.lit(1.0)), "decision": F.when(F.col("user_id") % 2 == 0, "ACCEPT").otherwise("REJECT"), "severity": F.when(F.col("user_id") % 3 == 0, "harmful").otherwise("unnecessary")})
    return harness.pass_metrics(cases, 2)


@query("""
WITH c AS (SELECT user_id AS id, count(DISTINCT event_type) > 4 AS risky, user_id % 2 = 0 AS first, user_id % 5 = 0 AS second FROM events GROUP BY user_id),
     f AS (SELECT id, risky AND first AS escalate, CASE WHEN risky AND first THEN second ELSE first END AS final FROM c)
SELECT count(*) AS cases, count(*) FILTER (escalate) AS escalated, count(*) FILTER (final) AS accepted, round(sum(CASE WHEN escalate THEN 4.0 ELSE 1.0 END), 6)::DOUBLE AS spent FROM f
""")
def escalation(spark, d):
    word = lambda c: F.when(c, "ACCEPT").otherwise("REJECT")
    c = t(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.countDistinct("event_type").alias("kinds"))
    c = c.withColumns({"triggers": F.when(F.col("kinds") > 4, F.array(F.lit("risk"))).otherwise(F.array().cast("array<string>")), "first": word(F.col("id") % 2 == 0), "second": word(F.col("id") % 5 == 0), "cost": F.lit(1.0), "second_cost": F.lit(3.0)})
    out = harness.escalated(c, rejects_too=False)
    return out.agg(F.count(F.lit(1)).alias("cases"), F.count_if("escalate").alias("escalated"), F.count_if(F.col("final") == "ACCEPT").alias("accepted"), F.round(F.sum("spent"), 6).alias("spent"))


@query("""
WITH a AS (SELECT user_id AS id, arg_min(event_type, event_id) AS payload FROM events GROUP BY user_id), w AS (SELECT event_id, user_id AS id, event_type AS payload, value IS NULL AS unverified FROM events),
     k AS (SELECT *, count(*) OVER (PARTITION BY id) > 1 AS twice FROM w)
SELECT DISTINCT id, CASE WHEN twice THEN 'duplicate' WHEN unverified THEN 'unverified' WHEN a.payload <> k.payload THEN 'conflicting' END AS why FROM k LEFT JOIN a USING (id) WHERE twice OR unverified OR a.payload <> k.payload
""")
def acceptance_checks(spark, d):
    e = t(spark, d, "events")
    active = e.groupBy(F.col("user_id").alias("id")).agg(F.min_by("event_type", "event_id").alias("payload"))
    wanted = e.select(F.col("user_id").alias("id"), F.col("event_type").alias("payload"), F.col("value").isNull().alias("unverified"))
    return harness.acceptance_refusals(wanted, active, unverified_ok=False)


@query("""
WITH k AS (SELECT user_id, string_agg(DISTINCT event_type, '+' ORDER BY event_type) AS passes FROM events GROUP BY user_id) SELECT passes, count(*) AS n FROM k GROUP BY passes
""")
def provenance_counts(spark, d):
    merged = t(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("passes"))
    return harness.provenance(merged)


@query(r"""
WITH x AS (SELECT conv_id, turn, text AS a, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), y AS (SELECT conv_id, turn, b, a FROM x WHERE b IS NOT NULL UNION ALL SELECT conv_id, turn + 1000, a, ' ' || replace(a, ' ', '  ') FROM x)
SELECT conv_id, turn, CASE WHEN trim(regexp_replace(a, '\s+', ' ', 'g')) = trim(regexp_replace(b, '\s+', ' ', 'g')) THEN 'mechanical' ELSE 'prose' END AS impact FROM y
""")
def edit_classes(spark, d):
    c = t(spark, d, "conversations")
    turns = c.select("conv_id", "turn", F.col("text").alias("a"), F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("b"))
    spaced = c.select("conv_id", (F.col("turn") + 1000).alias("turn"), F.concat(F.lit(" "), F.replace("text", F.lit(" "), F.lit("  "))).alias("a"), F.col("text").alias("b"))
    rows = turns.where("b is not null").unionByName(spaced)
    return rows.select("conv_id", "turn", guards.classify(F.col("b"), F.col("a"), lexicon.PACKS["en"]).alias("impact"))


@query(r"""
SELECT doc_id, (len(regexp_extract_all(text, '"[^"]*"')) + len(regexp_extract_all(text, '“[^”]*”')) + len(regexp_extract_all(text, '‘[^’]*’')))::INT AS n FROM documents WHERE regexp_matches(text, '["“‘]')
""")
def dialogue_counts(spark, d):
    docs = t(spark, d, "documents").where(F.regexp_like("text", F.lit('["“‘]')))
    marked = F.filter(segment.dialogue(F.col("text"), lexicon.PACKS["en"]), lambda s: F.regexp_like(s["text"], F.lit('^["“‘]')))
    return docs.select("doc_id", F.size(marked).alias("n"))


@query("""
SELECT p_partkey, (lower(a) = lower(b) OR (length(a) = length(b) AND length(a) > 1 AND lower(a)[:-2] = lower(b)[:-2]) OR (length(a) >= 6 AND length(b) >= 6 AND lower(a)[1:6] = lower(b)[1:6])) AS same
FROM (SELECT x.p_partkey, x.p_type AS a, y.p_type AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1)
""")
def stem_pairs(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.col("p_type").alias("a"))
    following = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    return p.join(following, "p_partkey").select("p_partkey", X.same_stem(F.col("a"), F.col("b")).alias("same"))


@query("""
SELECT o_orderpriority AS severity, o_orderstatus AS kind, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus))
""")
def impact_counts(spark, d):
    return t(spark, d, "orders").groupingSets([["o_orderpriority"], ["o_orderstatus"]], "o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n")).select(F.col("o_orderpriority").alias("severity"), F.col("o_orderstatus").alias("kind"), "n")


# --- driver coverage: generic relational queries, no operators of this library -----------------------------------

@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus
""")
def dc_pricing_summary(spark, d):
    li = t(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT c_mktsegment, o_orderkey, o_totalprice FROM (SELECT c_mktsegment, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders JOIN customer ON o_custkey = c_custkey) WHERE k <= 5
""")
def dc_top_orders(spark, d):
    rows = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return rows.withColumn("k", F.row_number().over(w)).where("k <= 5").select("c_mktsegment", "o_orderkey", "o_totalprice")


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts)::DATE AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def dc_event_days(spark, d):
    return t(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query()
def rule_pipeline(spark, d):
    """All rules over all English documents: book-wide statistics, drafts, proposals."""
    from folioscope.operators.rules import Settings
    from folioscope.plans import review

    docs = t(spark, d, "documents").where("lang = 'en'").select("source", "doc_id", "text")
    found = review.mechanical_run(docs, ["source", "doc_id"], lexicon.PACKS["en"], Settings())
    return found.select("source", "doc_id", "rule", "start", "target", "replacement", "authority", "occurrence", "proposal_id")
