"""Language packs and term lists as data."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.matching import texts
from folioscope.functions.text import dictionary_key


@dataclass(frozen=True)
class Pack:
    """What a language's rules need to know."""

    language: str
    version: str = "1"
    stopwords: tuple[str, ...] = ()
    negation: tuple[str, ...] = ()
    modal: tuple[str, ...] = ()
    quote_pairs: tuple[tuple[str, str], ...] = (("“", "”"),)
    abbreviations: tuple[str, ...] = ()
    filter_verbs: tuple[str, ...] = ()
    adverb_suffixes: tuple[str, ...] = ()
    speech_dash: str = "—"
    word_dash: str = "—"
    spelling_variants: tuple[tuple[str, str], ...] = ()
    formal: tuple[str, ...] = ()
    informal: tuple[str, ...] = ()
    chars_per_token: float = 3.0
    derived: bool = False
    warning: str | None = None


#: Word lists and typographic signs of the two languages.
PACKS = {
    "en": Pack(
        language="en",
        version="1.0.1",
        stopwords=tuple("a an and are as at be but by for from he her his i in is it of on or she that the their there they this to was were with you".split()),
        negation=tuple("no not never none neither nor without don't didn't cannot can't".split()),
        modal=tuple("may might must probably perhaps certainly surely could would".split()),
        quote_pairs=(("“", "”"), ("‘", "’"), ('"', '"')),
        abbreviations=tuple("Mr. Mrs. Dr. Prof. St. e.g. i.e. rt. a.m. p.m. misc. Mon. Tue. Tues. Wed. Thu. Thur. Thurs. Fri. Sat. Sun. coop. Corp. Cpl. Tpr. Oct. Sept. etc. vs. No. cig. corr.".split()),
        filter_verbs=tuple("saw noticed felt heard realized seemed".split()),
        adverb_suffixes=("ly",),
        spelling_variants=(("colour", "color"), ("favour", "favor"), ("centre", "center"), ("organise", "organize")),
        formal=("however", "therefore"),
        informal=("ain't", "gonna", "yeah"),
        chars_per_token=4.0,
    ),
    "ru": Pack(
        language="ru",
        version="1.0.1",
        stopwords=tuple("а без бы был была были в во для до его ее и из как к на не но о он она они от по с со то у что это я".split()),
        negation=tuple("не ни нет никогда ничего без".split()),
        modal=tuple("может мог могла могли возможно вероятно наверное точно несомненно должен должна".split()),
        quote_pairs=(("«", "»"), ("„", "“"), ('"', '"')),
        abbreviations=tuple("г. гг. т. им. ул. др.".split()),
        filter_verbs=tuple("увидел увидела почувствовал заметил казалось".split()),
        formal=("однако", "следовательно"),
        informal=("ага", "ну"),
        chars_per_token=2.71,
    ),
}


def derived_stopwords(docs: DataFrame, text_col: str = "text", by: tuple[str, ...] = (), top: int = 60) -> DataFrame:
    """(by..., word, n, rank): the most frequent chunks of up to four letters, ties by their first appearance.

    A long word is cut into chunks of four and a rest, which is how the list is meant. The first appearance is the
    order of ``ord`` and the place in the text; ``docs`` needs ``ord`` and the columns of ``by``.
    """
    chunks = docs.select(*by, "ord", F.posexplode(texts(F.lower(F.col(text_col)), r"\p{L}{1,4}")).alias("pos", "word"))
    counts = chunks.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "pos")).alias("first"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "first")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(*by, "word", "n", "rank")


def load_pack(language: str, stopwords: tuple[str, ...] = (), packs: dict[str, Pack] | None = None) -> Pack:
    """The language's pack, or one made from the collection's own stopwords, with a warning."""
    base = language.lower().split("-")[0]
    if not (base.isalpha() and base.isascii() and 2 <= len(base) <= 3):
        raise ValueError(f"invalid language: {language}")
    known = packs or PACKS
    if base in known:
        return known[base]
    return Pack(base, "derived/1", stopwords, derived=True, warning=f"no pack for {language}; its stopwords are derived from the text")


def packs_table(spark: SparkSession, packs: dict[str, Pack] | None = None) -> DataFrame:
    """One row for each pack, to be joined by language."""
    pairs = "array<struct<a:string,b:string>>"
    rows = [(p.language, p.version, list(p.stopwords), list(p.negation), list(p.modal), list(p.quote_pairs), list(p.abbreviations), list(p.filter_verbs), list(p.adverb_suffixes), list(p.spelling_variants), p.chars_per_token) for p in (packs or PACKS).values()]
    return spark.createDataFrame(rows, f"language string, version string, stopwords array<string>, negation array<string>, modal array<string>, quote_pairs {pairs}, abbreviations array<string>, filter_verbs array<string>, adverb_suffixes array<string>, spelling_variants {pairs}, chars_per_token double")


@dataclass(frozen=True)
class Regional:
    """Forms of two regional standards; a list is loaded by the caller (it is data, and long)."""

    terms: tuple[dict[str, Any], ...] = field(default=())

    @staticmethod
    def parse(text: str) -> Regional:
        """From JSON: {"terms": [{"kind", "gb": [], "us": [], "shared": [], "polysemous": []}]}."""
        return Regional(tuple(json.loads(text)["terms"]))

    def forms(self, spark: SparkSession, side: str) -> DataFrame:
        """(key, other, kind, loose, polysemous) of one side's forms; of a form listed twice the last entry holds."""
        rows: dict[str, tuple] = {}
        for t in self.terms:
            there = t["us" if side == "gb" else "gb"]
            for i, form in enumerate(t[side]):
                key = " ".join(form.lower().replace("’", "'").split())
                loose = side in [*t.get("shared", []), *t.get("polysemous", [])]
                rows[key] = (key, there[i] if i < len(there) else there[0], t["kind"], loose, side in t.get("polysemous", []))
        return spark.createDataFrame(list(rows.values()), "key string, other string, kind string, loose boolean, polysemous boolean")

    def pattern(self, side: str) -> str:
        """All forms of a side, the longest first, as whole words; apostrophes and spaces are flexible."""
        keys = {" ".join(f.lower().replace("’", "'").split()) for t in self.terms for f in t[side]}
        alternatives = "|".join(_flexible(k) for k in sorted(keys, key=lambda k: (-len(k), k)))
        return rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{alternatives})(?![\p{{L}}\p{{N}}])"


def _flexible(key: str) -> str:
    out = "".join("\\" + c if c in r".*+?^${}()|[]\/" else c for c in key)
    return out.replace("'", "['’]").replace(" ", r"\s+")


def region_of(language: str) -> str | None:
    """'us' or 'gb' where the tag names a region of English."""
    tag = language.lower()
    return tag[3:] if tag in ("en-us", "en-gb") else None


def known_form(form: Column) -> Column:
    return dictionary_key(form)
