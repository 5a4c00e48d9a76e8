"""The mechanical run as an increment: what changed since the last one is read again, the rest is carried over.

A run leaves its scenes' hashes, their proposals, and the book's statistics as partial counts by scene. The next run
takes away the partial counts of scenes that changed or went and adds those of new texts, so the book's statistics are
those of the whole new book although only new texts are read. An unchanged scene is read again only where a rule that goes
by these statistics may say something else there: its words meet a spelling, a name or a form whose entry changed.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.matching import count
from folioscope.functions.text import normalize_text, sha256
from folioscope.operators import metrics, rules, segment
from folioscope.operators.lexicon import Pack, Regional, region_of
from folioscope.plans.review import mechanical_run


@dataclass
class Run:
    """What a run leaves: tables by scene, in a folder."""

    hashes: DataFrame  #: keys, hash
    words: DataFrame  #: keys, word, n
    names: DataFrame  #: keys, name, n, first
    quotes: DataFrame  #: keys, curly, straight
    proposals: DataFrame | None = None

    @classmethod
    def read(cls, spark: SparkSession, path: str, but: tuple[str, ...] = ()) -> Run:
        return cls(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(cls) if f.name not in but})

    def put(self, path: str) -> Run:
        """Writes the statistics and reads them back: all that follows starts from them."""
        for name in ("hashes", "words", "names", "quotes"):
            getattr(self, name).write.parquet(f"{path}/{name}")
        return Run.read(self.hashes.sparkSession, path, ("proposals",))

    def ends(self, proposals: DataFrame, path: str) -> Run:
        proposals.write.parquet(f"{path}/proposals")
        return Run.read(self.hashes.sparkSession, path)


def hashed(scenes: DataFrame, keys: list[str]) -> DataFrame:
    return scenes.select(*keys, sha256(normalize_text(F.col("text"))).alias("normal"), sha256(F.col("text")).alias("exact")).select(*keys, F.concat_ws("/", "normal", "exact").alias("hash"))


def _partials(scenes: DataFrame, keys: list[str], pack: Pack) -> tuple[DataFrame, DataFrame, DataFrame]:
    words = metrics.word_counts(scenes, segment.lower_words(F.col("text")), by=tuple(keys))
    names = metrics.proper_nouns(scenes, pack, by=tuple(keys))
    marks = scenes.select(*keys, count(F.col("text"), "[“”]").alias("curly"), count(F.col("text"), '"').alias("straight")).where("curly > 0 or straight > 0")
    return words, names, marks


def _book(words: DataFrame, names: DataFrame, quotes: DataFrame, keys: list[str], pack: Pack, settings: rules.Settings, regional: Regional | None) -> rules.Context:
    """What the rules need of the book, from the partial counts of its scenes."""
    counts = words.groupBy("word").agg(F.sum("n").alias("n"))
    all_names = names.groupBy("name").agg(F.sum("n").alias("n"), F.min(F.struct(*keys, F.col("first.pos").alias("pos"))).alias("first"))
    curly, straight = quotes.agg(F.sum("curly"), F.sum("straight")).first()
    return rules.Context(pack, settings, all_names, counts, rules.quote_style(curly or 0, straight or 0), regional or Regional())


def first_run(scenes: DataFrame, keys: list[str], pack: Pack, settings: rules.Settings, path: str, regional: Regional | None = None) -> Run:
    """A run over all scenes (keys, text) that can be carried on, in a new folder."""
    run = Run(hashed(scenes, keys), *_partials(scenes, keys, pack)).put(path)
    ctx = _book(run.words, run.names, run.quotes, keys, pack, settings, regional)
    return run.ends(mechanical_run(scenes, keys, pack, settings, ctx=ctx), path)


def _changed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has."""
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def _entries(ctx: rules.Context, pack: Pack, settings: rules.Settings) -> dict[str, DataFrame]:
    """What rules look up in the book's statistics: ``word``, in lower case, and all that a draft takes from its entry."""
    out = {}
    if pack.spelling_variants:
        forced = settings.spelling or {"us": "american", "gb": "british"}.get(region_of(settings.language) or "")
        pairs = rules.spelling_preferences(ctx.counts, pack.spelling_variants, forced)
        out["spelling"] = pairs.select(F.col("loser").alias("word"), F.col("winner").alias("entry"))
    similar = rules.similar_names(ctx.names, pack.language, pack.stopwords)
    out["names"] = similar.select(F.lower("name").alias("word"), F.to_json(F.struct("name", "n", "candidate", "candidate_n")).alias("entry"))
    if pack.language == "ru" and settings.yo == "yo":
        forms = ctx.counts.where(F.contains("word", F.lit("ё")))
        out["forms"] = forms.select(F.translate("word", "ё", "е").alias("word"), F.concat_ws(" ", "word", F.col("n").cast("string")).alias("entry"))
    return out


def next_run(last: Run, scenes: DataFrame, keys: list[str], pack: Pack, settings: rules.Settings, path: str, regional: Regional | None = None) -> tuple[Run, DataFrame]:
    """The run over ``scenes`` (keys, text) in a new folder, equal to ``first_run`` over them, and the keys of the scenes that were
    read again.

    Settings, packs and rules are those of the last run; if they change, a first run is due. Keys tell scenes apart.
    """
    now = hashed(scenes, keys)
    same = now.join(last.hashes, [*keys, "hash"], "left_semi").select(*keys)
    fresh = scenes.join(same, keys, "left_anti")
    old = (last.words, last.names, last.quotes)
    run = Run(now, *(t.join(same, keys, "left_semi").unionByName(new) for t, new in zip(old, _partials(fresh, keys, pack), strict=True))).put(path)
    before, after = (_book(*t, keys, pack, settings, regional) for t in (old, (run.words, run.names, run.quotes)))
    same = run.hashes.join(last.hashes, [*keys, "hash"], "left_semi").select(*keys)
    again = run.hashes.select(*keys).join(same, keys, "left_anti")
    was, becomes = _entries(before, pack, settings), _entries(after, pack, settings)
    for name in becomes:
        again = again.unionByName(run.words.join(_changed(was[name], becomes[name]).select("word").distinct(), "word", "left_semi").select(*keys))
    if before.quote_style != after.quote_style:  # only texts with marks of both styles can mix them
        again = again.unionByName(run.quotes.where("curly > 0 and straight > 0").select(*keys))
    again.distinct().write.parquet(f"{path}/again")
    again = scenes.sparkSession.read.parquet(f"{path}/again")
    found = mechanical_run(scenes.join(again, keys, "left_semi"), keys, pack, settings, ctx=after)
    carried = last.proposals.join(same.join(again, keys, "left_anti"), keys, "left_semi")
    return run.ends(carried.unionByName(found), path), again
