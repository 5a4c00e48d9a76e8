"""Rules: review-worthy spans of a scene, each with a proposed replacement.

A rule maps a table of scenes to drafts by column expressions. ``detect`` runs the rules of a language in their order
and returns one table. Authority says what a draft may do: ``mechanical`` is right by its own condition,
``contextual`` needs a decision on the spot, ``semantic`` may change the sense and is a finding only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.matching import MATCH, any_span, char, count, matches, occurrence_before, occurrences, overlaps, run_before, touches, within
from folioscope.functions.text import changed_span, like_case, one_edit_apart, same_stem, sha256, stable_id
from folioscope.operators.lexicon import Pack, Regional, region_of
from folioscope.operators.segment import WORD, dialogue, paragraphs, tokens_table

DRAFT = "array<struct<start:int,target:string,replacement:string,reason:string,authority:string,evidence:map<string,string>>>"
#: Titles and chapters of which only some rules look at.
TITLE_RULES = ("grammar.ru-sutki-numeral", "grammar.ru-pronoun-byl")


@dataclass(frozen=True)
class Settings:
    """What the author has decided beforehand."""

    language: str = "en"
    ellipsis: bool = False
    dashes: str | None = None
    quotes: str | None = None
    spelling: str | None = None  # british or american
    yo: str = "keep"  # keep, e or yo
    preserve: tuple[str, ...] = ()
    canonical_names: tuple[tuple[str, tuple[str, ...]], ...] = ()
    protected_forms: tuple[str, ...] = ()
    off: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Context:
    """Side inputs that are made once for a collection: see ``context``."""

    pack: Pack
    settings: Settings
    names: DataFrame | None = None  # name, n, first
    counts: DataFrame | None = None  # word, n
    quote_style: str | None = None
    regional: Regional = field(default_factory=Regional)


@dataclass(frozen=True)
class Rule:
    id: str
    version: str
    languages: tuple[str, ...]
    category: str
    impact: str
    authority: str
    detect: Callable[[DataFrame, Context], DataFrame]


def _draft(m: Column, replacement: Column, reason: str, authority: str = "", target: Column | None = None, start: Column | None = None, evidence: Column | None = None) -> Column:
    none = F.lit(None).cast("map<string,string>")
    return F.struct(
        (m["start"] if start is None else start).alias("start"),
        (m["text"] if target is None else target).alias("target"),
        replacement.alias("replacement"),
        F.lit(reason).alias("reason"),
        F.lit(authority or None).cast("string").alias("authority"),
        (none if evidence is None else evidence).alias("evidence"),
    )


def _each(scenes: DataFrame, drafts: Column) -> DataFrame:
    return scenes.withColumn("d", F.explode(drafts.cast(DRAFT))).drop("text").select("*", "d.*").drop("d")


def local(drafts: Callable[[Column, Context], Column]) -> Callable[[DataFrame, Context], DataFrame]:
    """A rule that looks at one text alone: its drafts are an array in the row, so all such rules share one pass."""

    def detect(scenes: DataFrame, ctx: Context) -> DataFrame:
        return _each(scenes, drafts(F.col("text"), ctx))

    detect.drafts = drafts
    detect.__doc__ = drafts.__doc__
    return detect


def _simple(text: Column, pattern: str, groups: int, replacement: Callable[[Column], Column], reason: str, authority: str = "", keep: Callable[[Column], Column] | None = None) -> Column:
    found = matches(text, pattern, groups)
    if keep is not None:
        found = F.filter(found, keep)
    return F.transform(found, lambda m: _draft(m, replacement(m), reason, authority)).cast(DRAFT)


#: Words that are doubled on purpose.
DOUBLED_ON_PURPOSE = ("that", "had", "chow", "bye", "so", "no", "yes", "very")


@local
def doubled_word(text: Column, ctx: Context) -> Column:
    found = matches(text, r"(?iu)(?<!\p{L})(\p{L}{2,})([ \t\r\n]+)\1(?!\p{L})", 2)
    if ctx.pack.language == "en":
        found = F.filter(found, lambda m: ~F.lower(m["groups"][0]).isin(*DOUBLED_ON_PURPOSE))
    if "intentional-repetition" in ctx.settings.preserve:
        spoken = dialogue(text, ctx.pack)
        found = F.filter(found, lambda m: ~any_span(spoken, lambda s: within(m, s)))
    return F.transform(found, lambda m: _draft(m, m["groups"][0], "A word is said twice in a row."))


@local
def whitespace(text: Column, ctx: Context) -> Column:
    pair = lambda m: F.concat(m["groups"][0], m["groups"][1])
    return F.concat(
        _simple(text, r"([\p{L}\p{N}]) {2,}([^\s])", 2, lambda m: F.concat_ws(" ", m["groups"][0], m["groups"][1]), "One space is enough."),
        _simple(text, r"([\p{L}\p{N}])[ \t]+([,.;:!?])(?!\p{N})", 2, pair, "No space stands before this mark."),
        _simple(text, r"([^\s])[ \t]+(?=\r?(?:\n|\z))", 1, lambda m: m["groups"][0], "The line ends in spaces."),
    )


BRACKETS = (("(", ")"), ("[", "]"), ("{", "}"))


def _surplus(text: Column, a: str, b: str) -> Column:
    return F.length(F.replace(text, F.lit(b), F.lit(""))) - F.length(F.replace(text, F.lit(a), F.lit("")))


@local
def balance(text: Column, ctx: Context) -> Column:
    pars = paragraphs(text)
    drafts = []
    for a, b in BRACKETS:
        tail = lambda p: F.regexp_extract(p["text"], r"[\p{L}\p{N}]+[.!?]?\z", 0)
        hit = F.filter(pars, lambda p: (_surplus(p["text"], a, b) == 1) & (tail(p) != ""))  # noqa: B023

        def close(p: Column, b: str = b) -> Column:
            t = tail(p)  # noqa: B023
            return F.when(F.regexp_like(t, F.lit(r"[.!?]$")), F.concat(F.substring(t, F.lit(1), F.length(t) - 1), F.lit(b), F.right(t, F.lit(1)))).otherwise(F.concat(t, F.lit(b)))

        drafts.append(_mapped(hit, lambda p: _draft(p, close(p), f"Close the unmatched {a}.", target=tail(p), start=p["end"] - F.length(tail(p)))))  # noqa: B023
    return F.concat(*drafts)


def _mapped(spans: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(spans, lambda p: f(p)).cast(DRAFT)


def balance_warnings(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, start, kind: paragraphs with unequal brackets or an odd number of quotation marks."""
    rows = docs.select(*keys, F.explode(paragraphs(F.col(text_col))).alias("p")).select(*keys, "p.start", "p.text")
    kinds = [F.when(_surplus(F.col("text"), a, b) != 0, F.lit(a + b)) for a, b in BRACKETS]
    quotes = F.when(count(F.col("text"), "[“”«»\"]") % 2 == 1, F.lit("quotes"))
    return rows.select(*keys, "start", F.explode(F.array_compact(F.array(*kinds, quotes))).alias("kind"))


@local
def quotes(text: Column, ctx: Context) -> Column:
    want = ctx.settings.quotes
    if not want or want in ("keep", '""') or len(want) != 2:
        return F.array().cast(DRAFT)
    inner_pair = ctx.pack.quote_pairs[1] if len(ctx.pack.quote_pairs) > 1 else tuple(want)
    found = matches(text, r'"([^"\r\n]+)"|“([^”\r\n]+)”', 2)
    inner = lambda m: F.regexp_replace(F.concat(m["groups"][0], m["groups"][1]), "‘([^’]+)’", f"{inner_pair[0]}$1{inner_pair[1]}")
    new = lambda m: F.concat(F.lit(want[0]), inner(m), F.lit(want[1]))
    found = F.filter(found, lambda m: new(m) != m["text"])
    return F.transform(found, lambda m: _draft(m, new(m), "Quotation marks as the settings have them."))


def dominant_quote_style(scenes: DataFrame) -> str | None:
    """curly or straight where one makes up nine tenths of ten marks and more, else nothing."""
    curly, straight = scenes.agg(F.sum(count(F.col("text"), "[“”]")), F.sum(count(F.col("text"), '"'))).first()
    return quote_style(curly or 0, straight or 0)


def quote_style(curly: int, straight: int) -> str | None:
    if curly >= 10 and straight * 9 <= curly:
        return "curly"
    return "straight" if straight >= 10 and curly * 9 <= straight else None


@local
def mixed_quotes(text: Column, ctx: Context) -> Column:
    want = ctx.settings.quotes
    style = {"“”": "curly", '""': "straight"}.get(want or "", ctx.quote_style if want in (None, "", "keep") else None)
    if not style:
        return F.array().cast(DRAFT)
    a, b = "“”" if style == "curly" else '""'
    new = lambda m: F.concat(F.lit(a), m["groups"][0], m["groups"][1], F.lit(b))
    return _simple(text, r'"([^"“”\r\n]+)”|“([^"“”\r\n]+)"', 2, new, "One quotation opens in one style and closes in another.")


@local
def dashes_ellipsis(text: Column, ctx: Context) -> Column:
    dash = ctx.settings.dashes or ctx.pack.word_dash
    parts = [_simple(text, r"\.\.\.", 0, lambda m: F.lit("…"), "An ellipsis as the settings have it.")] if ctx.settings.ellipsis else []
    parts += [
        _simple(text, r"(\p{L}) - (\p{L})", 2, lambda m: F.concat(m["groups"][0], F.lit(f" {dash} "), m["groups"][1]), "Between clauses this language writes its own dash."),
        _simple(text, r"(?<![\p{L}\p{N}])([\p{L}\p{N}]+)\.\.(?![.…])", 1, lambda m: F.concat(m["groups"][0], F.lit(".")), "Two full stops in a row: one ends the sentence.", "contextual"),
        _simple(text, r"(?m)^-[ \t]+(\p{L})", 1, lambda m: F.concat(F.lit(f"{ctx.pack.speech_dash} "), m["groups"][0]), "A line of speech opens with this language's dash.", "contextual"),
    ]
    return F.concat(*parts)


@local
def sentence_start(text: Column, ctx: Context) -> Column:
    """Lower-case words after a sentence's end, but for an ellipsis, an abbreviation, an initial, a unit after a
    number, and lines that are lower-case on purpose."""
    short = [a.lower() for a in ctx.pack.abbreviations]

    def wanted(m: Column) -> Column:
        end, gap = m["groups"][0], m["groups"][1]
        head = F.substring(text, F.lit(1), m["start"] + 1)
        before = F.substring(text, F.lit(1), m["start"])
        word = F.lower(run_before(text, m["start"] + 1, r"\p{L}."))
        line = F.element_at(F.split(before, "\n"), -1)
        first = F.regexp_extract(F.element_at(F.split(line, r"[.!?…:]\s+"), -1), r"\p{L}", 0)
        return (
            ((end == ".") | F.regexp_like(gap, F.lit(r"[\r\n]")))
            & ~((end == ".") & F.regexp_like(char(text, m["start"] - 1), F.lit("[.…]")))
            & ~(word.isin(*short) if short else F.lit(False))
            & ~F.regexp_like(F.right(head, F.least(F.lit(4), F.length(head))), F.lit(r"(?:^|[^\p{L}])\p{Lu}\.\z"))
            & ~F.regexp_like(F.right(head, F.least(F.lit(9), F.length(head))), F.lit(r"[0-9][ \t]+\p{Ll}{1,3}\.\z"))
            & ~((first != "") & (first == F.lower(first)) & (first != F.upper(first)))
        )

    new = lambda m: F.concat(m["groups"][0], m["groups"][1], F.upper(F.substring(m["groups"][2], 1, 1)), F.substring(m["groups"][2], F.lit(2), F.length(m["groups"][2])))
    return _simple(text, r"([.!?])([ \t\r\n]+)(\p{Ll}\p{L}*)", 3, new, "A sentence begins with a capital.", keep=wanted)


@local
def stray_markers(text: Column, ctx: Context) -> Column:
    none = F.array().cast(DRAFT)

    def inside(t: Column) -> Column:
        one = lambda pattern: count(t, pattern) == 1
        return F.concat(
            _simple(t, r"([^\s])\s+(#{2,})\s+(\p{L})", 3, lambda m: F.concat_ws(" ", m["groups"][0], m["groups"][2]), "Signs of a heading stand inside a paragraph."),
            F.when(one(r"\*\*"), _simple(t, r"(\p{L})\*\*(\p{L})", 2, lambda m: F.concat(m["groups"][0], m["groups"][1]), "A bold sign without its partner.")).otherwise(none),
            F.when(one("_"), _simple(t, r"(\p{L})_(?=[ \t]|\z)", 1, lambda m: m["groups"][0], "An emphasis sign without its partner.")).otherwise(none),
            _simple(t, r"(\p{L})\\([!?])", 2, lambda m: F.concat(m["groups"][0], m["groups"][1]), "This sign needs no escape."),
        )

    fields = ("target", "replacement", "reason", "authority", "evidence")
    placed = lambda p: F.transform(inside(p["text"]), lambda m: F.struct((m["start"] + p["start"]).alias("start"), *(m[c].alias(c) for c in fields)))
    # few paragraphs have a mark at all
    marked = F.filter(paragraphs(text), lambda p: F.regexp_like(p["text"], F.lit(r"[#*_\\]")))
    return F.when(F.regexp_like(text, F.lit(r"[#*_\\]")), F.flatten(F.transform(marked, placed))).otherwise(none)


def spelling_preferences(counts: DataFrame, pairs: tuple[tuple[str, str], ...], forced: str | None) -> DataFrame:
    """(loser, winner) of each pair: the forced side, else the more frequent where both occur; a tie goes to the first."""
    spark = counts.sparkSession
    rows = spark.createDataFrame(list(pairs), "a string, b string")
    c = F.broadcast(rows)  # a pack's pairs
    n = lambda side: counts.select(F.col("word").alias(side), F.col("n").alias(f"n_{side}"))
    both = c.join(n("a"), "a", "left").join(n("b"), "b", "left").fillna(0, ["n_a", "n_b"])
    first = F.lit(forced == "british") if forced else F.col("n_a") >= F.col("n_b")
    both = both if forced else both.where((F.col("n_a") > 0) & (F.col("n_b") > 0))
    return both.select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("loser"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("winner"))


def _keys(scenes: DataFrame) -> list[str]:
    return [c for c in scenes.columns if c != "text"]


def spelling_variant(scenes: DataFrame, ctx: Context) -> DataFrame:
    keys, spark = _keys(scenes), scenes.sparkSession
    region = region_of(ctx.settings.language)
    forced = ctx.settings.spelling or {"us": "american", "gb": "british"}.get(region or "")
    tokens = tokens_table(scenes, keys)
    none = F.lit(None).cast("map<string,string>")
    shape = [*keys, "start", F.col("text").alias("target"), "replacement", "reason", "authority", "evidence"]
    empty = spark.createDataFrame([], "word string, n long")
    out = []
    if ctx.pack.spelling_variants:
        wanted = spelling_preferences(ctx.counts if ctx.counts is not None else empty, ctx.pack.spelling_variants, forced)
        hit = tokens.join(F.broadcast(wanted), tokens["lower"] == wanted["loser"])
        out.append(hit.withColumn("replacement", like_case(F.col("text"), F.col("winner"))).withColumn("reason", F.lit("The book, or its settings, spell this word otherwise.")).withColumn("authority", F.lit("mechanical" if ctx.settings.spelling else "contextual")).withColumn("evidence", none).select(*shape))
    if ctx.pack.language == "ru" and ctx.settings.yo != "keep":
        to_e = ctx.settings.yo == "e"
        changed = F.translate("text", "ёЁ", "еЕ") if to_e else F.translate("text", "еЕ", "ёЁ")
        hit = tokens.withColumn("replacement", changed).where(F.col("replacement") != F.col("text")).withColumn("reason", F.lit("The letters ё and е as the settings have them."))
        if to_e:
            hit = hit.withColumn("authority", F.lit("mechanical")).withColumn("evidence", none)
        else:
            known = (ctx.counts if ctx.counts is not None else empty).select(F.col("word").alias("known"), "n")
            hit = hit.join(known, F.lower("replacement") == F.col("known")).withColumn("authority", F.lit("semantic"))
            hit = hit.withColumn("evidence", F.create_map(F.lit("basis"), F.lit("е→ё form present in the book"), F.lit("form_in_book"), F.col("known"), F.lit("count_in_book"), F.col("n").cast("string")))
        out.append(hit.select(*shape))
    if not out:
        return _each(scenes, F.array().cast(DRAFT))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def region_variant(scenes: DataFrame, ctx: Context) -> DataFrame:
    """Forms of the other region of English. In dialogue, or where this region writes them too, they are findings."""
    region = region_of(ctx.settings.language)
    if not region or not ctx.regional.terms:
        return _each(scenes, F.array().cast(DRAFT))
    side = "gb" if region == "us" else "us"
    text, keys = F.col("text"), _keys(scenes)
    rows = scenes.select(*keys, dialogue(text, ctx.pack).alias("spoken"), F.explode(matches(text, ctx.regional.pattern(side))).alias("m"))
    forms = ctx.regional.forms(scenes.sparkSession, side)
    key = F.regexp_replace(F.translate(F.lower("m.text"), "’", "'"), r"\s+", " ")
    hit = rows.withColumn("key", key).join(F.broadcast(forms), "key").where(~F.col("polysemous"))
    pairs = [w for pair in ctx.pack.spelling_variants for w in pair]
    if pairs:
        hit = hit.where(~F.lower("m.text").isin(*pairs))
    finding = F.col("loose") | any_span(F.col("spoken"), lambda s: within(F.col("m"), s))
    basis = F.when(F.col("loose"), "this region of English has the form as well").otherwise("a character says it and may speak so")
    return hit.select(
        *keys, F.col("m.start").alias("start"), F.col("m.text").alias("target"), like_case(F.col("m.text"), F.col("other")).alias("replacement"),
        F.concat(F.when(F.col("kind") == "spelling", "Spelling").otherwise("Usage"), F.lit(f" of the other English region; the book is {ctx.settings.language}.")).alias("reason"),
        F.when(finding, "semantic").otherwise("contextual").alias("authority"),
        F.when(finding, F.create_map(F.lit("basis"), basis, F.lit("region_form"), F.col("other"))).alias("evidence"),
    )


def similar_names(names: DataFrame, language: str, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """(name, n, candidate, candidate_n): of the names one letter away that are more frequent, the first that was seen.

    ``names`` has (name, n, first). Candidates are found by an equi-join on what one edit leaves: names of one stem
    that are one edit apart share all but the last letter or their first six letters.
    """
    plain = names.where((F.length("name") >= 4) & F.regexp_like("name", F.lit(r"^\p{L}+$")))
    if stopwords:
        plain = plain.where(~F.lower("name").isin(*stopwords))
    low = F.lower("name")
    stems = F.array_distinct(F.array_compact(F.array(F.concat(F.length("name").cast("string"), F.lit(":"), F.substring(low, F.lit(1), F.length("name") - 1)), F.when(F.length("name") >= 6, F.concat(F.lit("6:"), F.substring(low, 1, 6))))))
    keyed = plain.withColumn("stem", F.explode(stems))
    a = keyed.select("stem", "name", "n")
    b = keyed.select("stem", F.col("name").alias("candidate"), F.col("n").alias("candidate_n"), F.col("first").alias("candidate_first"))
    x, y = F.lower("name"), F.lower("candidate")
    met = a.join(b, "stem").where((F.col("name") != F.col("candidate")) & (F.col("candidate_n") > F.col("n")) & same_stem(F.col("name"), F.col("candidate")) & one_edit_apart(x, y))
    met = met.where(~((F.startswith(x, y) | F.startswith(y, x)) & (F.abs(F.length("name") - F.length("candidate")) == 1)))
    if language == "ru":
        met = met.where(F.substring(x, F.lit(1), F.length("name") - 1) != F.substring(y, F.lit(1), F.length("candidate") - 1))
    best = met.groupBy("name", "n").agg(F.min(F.struct("candidate_first", "candidate", "candidate_n")).alias("c"))
    return best.select("name", "n", F.col("c.candidate").alias("candidate"), F.col("c.candidate_n").alias("candidate_n"))


def name_variant(scenes: DataFrame, ctx: Context) -> DataFrame:
    keys, spark = _keys(scenes), scenes.sparkSession
    tokens = tokens_table(scenes, keys)
    shape = [*keys, "start", F.col("text").alias("target"), "replacement", "reason", "authority", "evidence"]
    canon: dict[str, list[str]] = {}
    for name, variants in ctx.settings.canonical_names:
        for v in variants:
            if name not in canon.setdefault(v, []):
                canon[v].append(name)
    known = spark.createDataFrame([(v, names, len(names)) for v, names in canon.items()], "variant string, names array<string>, k int")
    mapped = tokens.join(F.broadcast(known), tokens["text"] == known["variant"])  # the author's list
    one = F.col("k") == 1
    mapped = mapped.withColumn("replacement", F.col("names")[0]).withColumn("authority", F.when(one, "contextual").otherwise("semantic"))
    mapped = mapped.withColumn("reason", F.when(one, F.concat(F.lit("The author's canonical name list marks this spelling as a variant of "), F.col("replacement"), F.lit("."))).otherwise(F.concat(F.lit("The author's canonical name list maps this spelling to several names ("), F.array_join("names", ", "), F.lit("); decide which, if any."))))
    mapped = mapped.withColumn("evidence", F.when(one, F.create_map(F.lit("basis"), F.lit("canonical names"), F.lit("canonical"), F.col("replacement"))).otherwise(F.create_map(F.lit("basis"), F.lit("canonical names (ambiguous)"), F.lit("candidates"), F.array_join("names", ", "))))
    out = mapped.select(*shape)
    if ctx.names is None:
        return out
    settled = [*canon, *(name for name, _ in ctx.settings.canonical_names)]
    similar = similar_names(ctx.names, ctx.pack.language, ctx.pack.stopwords)
    found = tokens.where(~F.col("text").isin(*settled)) if settled else tokens
    found = found.join(similar, found["text"] == similar["name"])
    found = found.withColumn("replacement", F.col("candidate")).withColumn("authority", F.lit("semantic"))
    found = found.withColumn("reason", F.concat(F.lit('One letter sets "'), F.col("text"), F.lit('" apart from "'), F.col("candidate"), F.lit('", which is more frequent; only the author can tell whether it is the same name.')))
    found = found.withColumn("evidence", F.create_map(F.lit("basis"), F.lit("names one letter apart, the other in more places"), F.lit("spelling"), F.col("text"), F.lit("spelling_count"), F.col("n").cast("string"), F.lit("candidate"), F.col("candidate"), F.lit("candidate_count"), F.col("candidate_n").cast("string")))
    return out.unionByName(found.select(*shape))


#: Collective numerals, compound numerals, and past forms that agree with a pronoun.
COLLECTIVE = {"два": "двое", "две": "двое", "три": "трое", "четыре": "четверо"}
COMPOUND = r"(?iu)(?<!\p{L})(?:\p{L}*дцать|\p{L}+десят|сорок|девяносто|сто|двести|триста|четыреста|\p{L}+сот)\s+\z"
AGREES = {"он": "был", "она": "была", "оно": "было", "они": "были"}


def _lookup(table: dict[str, str], word: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), F.lower(word))


@local
def ru_numeral(text: Column, ctx: Context) -> Column:
    spoken = dialogue(text, ctx.pack)
    before = lambda m: F.substring(text, F.greatest(m["start"] - 24, F.lit(0)) + 1, F.least(m["start"], F.lit(24)))
    found = matches(text, r"(?iu)(?<![\p{L}\p{N}])(два|две|три|четыре)((?:\s+[\p{L}-]+(?:ых|их)){0,3})\s+суток(?!\p{L})", 2)
    found = F.filter(found, lambda m: ~any_span(spoken, lambda s: within(m, s)) & ~F.regexp_like(before(m), F.lit(COMPOUND)))
    number = lambda m: m["groups"][0]
    new = lambda m: F.concat(like_case(number(m), _lookup(COLLECTIVE, number(m))), F.substring(m["text"], F.length(number(m)) + 1, F.length(m["text"])))
    return F.transform(found, lambda m: _draft(m, new(m), "Перед «суток» ставится собирательное числительное."))


@local
def ru_pronoun(text: Column, ctx: Context) -> Column:
    spoken = dialogue(text, ctx.pack)
    found = matches(text, r"(?iu)(?<!\p{L})(он|она|оно|они)([ \t]+)(был|была|было|были)(?!\p{L})", 3)
    right = lambda m: _lookup(AGREES, m["groups"][0])
    verb = lambda m: F.lower(m["groups"][2])
    found = F.filter(found, lambda m: ~any_span(spoken, lambda s: within(m, s)) & (verb(m) != right(m)) & (verb(m) != "было"))
    new = lambda m: F.concat(m["groups"][0], m["groups"][1], right(m))
    return F.transform(found, lambda m: _draft(m, new(m), "Глагол «быть» не согласован с местоимением."))


BOTH = ("en", "ru")
#: In their order; of drafts with one id the first holds.
RULES = (
    Rule("repetition.doubled-word", "3", BOTH, "repetition", "mechanical", "contextual", doubled_word),
    Rule("typography.whitespace", "1", BOTH, "typography", "mechanical", "mechanical", whitespace),
    Rule("punctuation.balance", "2", BOTH, "punctuation", "mechanical", "contextual", balance),
    Rule("typography.quotes", "2", BOTH, "typography", "mechanical", "mechanical", quotes),
    Rule("typography.mixed-quotes", "1", ("en",), "typography", "mechanical", "mechanical", mixed_quotes),
    Rule("typography.dashes-ellipsis", "5", BOTH, "typography", "mechanical", "mechanical", dashes_ellipsis),
    Rule("capitalization.sentence-start", "5", BOTH, "capitalization", "mechanical", "contextual", sentence_start),
    Rule("markdown.stray-marker", "2", BOTH, "typography", "mechanical", "mechanical", stray_markers),
    Rule("consistency.spelling-variant", "2", BOTH, "consistency", "mechanical", "contextual", spelling_variant),
    Rule("consistency.region-variant", "1", ("en",), "consistency", "prose", "contextual", region_variant),
    Rule("terminology.name-variant", "4", BOTH, "terminology", "prose", "semantic", name_variant),
    Rule("grammar.ru-sutki-numeral", "2", ("ru",), "grammar", "mechanical", "contextual", ru_numeral),
    Rule("grammar.ru-pronoun-byl", "2", ("ru",), "grammar", "mechanical", "contextual", ru_pronoun),
)


def enabled(settings: Settings, pack: Pack, titles: bool = False) -> list[Rule]:
    return [r for r in RULES if pack.language in r.languages and r.id not in settings.off and (not titles or r.id in TITLE_RULES)]


def detect(scenes: DataFrame, ctx: Context, titles: bool = False, with_text: bool = False) -> DataFrame:
    """Drafts of all rules that are on: the scenes' columns but the text, rule_ord, rule, version, category, impact,
    authority, start, target, replacement, reason, evidence; and the text with ``with_text``.

    Rules that look at one text alone share one pass over the scenes. Those that need the book's words go by its tokens.
    """
    on = list(enumerate(enabled(ctx.settings, ctx.pack, titles)))
    if not on:
        raise ValueError("no rule is on")
    keys = [c for c in scenes.columns if c != "text"]
    fields = ("start", "target", "replacement", "reason", "authority", "evidence")
    shape = [*keys, *(["text"] if with_text else []), "rule_ord", *fields]
    numbered = lambda i: lambda m: F.struct(F.lit(i).alias("rule_ord"), *(m[c].alias(c) for c in fields))
    inner = [F.transform(r.detect.drafts(F.col("text"), ctx).cast(DRAFT), numbered(i)) for i, r in on if hasattr(r.detect, "drafts")]
    found = [scenes.select(*keys, "text", F.explode(F.concat(*inner)).alias("d")).select(*shape[: -len(fields) - 1], "d.*").select(*shape)] if inner else []
    for i, rule in on:
        if not hasattr(rule.detect, "drafts"):
            own = rule.detect(scenes, ctx).withColumn("rule_ord", F.lit(i))
            found.append((own.join(scenes.select(*keys, "text"), keys) if with_text else own).select(*shape))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    said = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("rule_ord") + 1)
    rules = [r for _, r in on]
    out = out.withColumns({"authority": F.coalesce("authority", said([r.authority for r in rules])), "rule": said([r.id for r in rules]), "version": said([r.version for r in rules]), "category": said([r.category for r in rules])})
    return out.withColumn("impact", F.when(F.col("authority") == "mechanical", said([r.impact for r in rules])).otherwise("prose"))


def widen(text: Column, start: Column, end: Column, replacement: Column) -> Column:
    """(start, end, target, replacement) with target and replacement widened to whole words on both sides."""
    left = run_before(text, start, r"\p{L}\p{N}")
    inside = lambda c: F.regexp_like(c, F.lit(r"[\p{L}\p{N}]"))
    left = F.when(inside(char(text, start)) & (end > start), left).otherwise(F.lit(""))
    right = F.regexp_extract(F.substring(text, end + 1, F.length(text)), r"^[\p{L}\p{N}]*", 0)
    right = F.when(inside(char(text, end - 1)) & (end > start), right).otherwise(F.lit(""))
    s, e = start - F.length(left), end + F.length(right)
    return F.struct(s.alias("start"), e.alias("end"), F.substring(text, s + 1, e - s).alias("target"), F.concat(left, replacement, right).alias("replacement"))


def touches_form(text: Column, change: Column, forms: tuple[str, ...]) -> Column:
    """Whether a change (start, end) touches an occurrence of a protected form."""
    met = F.lit(False)
    for f in forms:
        spans = F.transform(occurrences(text, F.lit(f)), lambda s: F.struct(s.alias("start"), (s + len(f)).alias("end")))  # noqa: B023
        met = met | any_span(spans, lambda s: touches(change, s) | ((change["start"] == change["end"]) & (change["start"] == s["start"])))
    return met


def without_protected(drafts: DataFrame, forms: tuple[str, ...]) -> DataFrame:
    """Drops drafts whose changed part touches a protected form; ``drafts`` carries the scene's text as ``text``."""
    if not forms:
        return drafts
    change = changed_span(F.col("target"), F.col("start"), F.col("replacement"))
    return drafts.withColumn("_change", change).where(~touches_form(F.col("text"), F.col("_change"), forms)).drop("_change")


def proposals(drafts: DataFrame, scenes: DataFrame, keys: list[str], forms: tuple[str, ...] = ()) -> DataFrame:
    """Proposals from drafts: widened, unprotected, with context, occurrence ordinal and stable id; of one id the first.

    Drafts that carry their scene's text are worked on as they are, others are joined to it.
    """
    rows = drafts if "text" in drafts.columns else drafts.join(scenes.select(*keys, "text"), keys)
    wide = widen(F.col("text"), F.col("start"), F.col("start") + F.length("target"), F.col("replacement"))
    rows = rows.withColumn("_w", wide).withColumns({c: F.col(f"_w.{c}") for c in ("start", "end", "target", "replacement")}).drop("_w")
    rows = without_protected(rows, forms)
    text = F.col("text")
    rows = rows.withColumns(
        {
            "before": F.substring(text, F.greatest(F.col("start") - 60, F.lit(0)) + 1, F.least(F.col("start"), F.lit(60))),
            "after": F.substring(text, F.col("end") + 1, F.lit(60)),
            "occurrence": occurrence_before(text, F.col("target"), F.col("start")),
            "target_hash": sha256(F.col("target")),
            "unverified": F.col("authority") == "semantic",
        }
    )
    place = [F.col(k).cast("string").alias(k) for k in sorted(keys)]
    identity = F.struct("category", *place, "occurrence", "rule", "target")
    rows = rows.withColumn("proposal_id", stable_id(identity)).withColumn("evidence_hash", sha256(F.to_json(F.struct("after", "before", "replacement", "target")))).drop("text")
    first = Window.partitionBy("proposal_id").orderBy("rule_ord", "start")
    return rows.withColumn("_k", F.row_number().over(first)).where(F.col("_k") == 1).drop("_k")


def rule_set_version() -> str:
    """Changes with any rule's id or version."""
    import hashlib
    import json

    return "sha256:" + hashlib.sha256(json.dumps([{"id": r.id, "version": r.version} for r in RULES], separators=(",", ":")).encode()).hexdigest()


__all__ = ["MATCH", "RULES", "WORD", "Context", "Rule", "Settings", "balance_warnings", "detect", "dominant_quote_style", "overlaps", "proposals", "similar_names", "widen"]
