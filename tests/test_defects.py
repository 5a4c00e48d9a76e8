"""Defects, what rules repair of them, and traps, against a walk over the places one after the other."""

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import __spark_entry__ as entry
from folioscope.operators import defects, ranks, rules
from folioscope.operators.lexicon import PACKS
from folioscope.plans.review import context

EN = ["Lanterns glimmer over harbour stones, perhaps", "Mr. Hyde wandered, and he walked", "She seemed tired, they were quiet.", "The Captain said nothing;", "“Bring lanterns, please,” said Utterson.", "Morning arrived slowly. Sailors carried timber, rope", "were\nwaiting"]
KEYS = ["work", "chapter", "scene"]


def book(spark, works=("alpha", "beta"), n=12, seed=0):
    r = np.random.default_rng(seed)
    rows = [(w, c, s, " ".join(EN[i] for i in r.integers(0, len(EN), 5)) + ("\nLast line." if s else "")) for w in works for c in range(n // 3) for s in range(3)]
    return spark.createDataFrame(rows, "work string, chapter int, scene int, text string").repartition(5), sorted(rows)


def fnv(text):
    h = 2166136261
    for c in text:
        h = (h ^ ord(c)) * 16777619 % 2**32
    return h


def walked(rows, work, generator, seed, blocked=(), control=None):
    """Kinds one after the other, each over all scenes: what is picked of what is left."""
    picks, out = [], []
    abbreviations = "|".join(regex.escape(a) for a in PACKS["en"].abbreviations)
    agreed = {"was": "were", "were": "was", "has": "have", "have": "has", "is": "are", "are": "is"}
    typo = "[A-Za-z]{6,}" if generator == 1 else "[a-z]{6,}"
    shapes = {
        "typo": (rf"(?a:\b){typo}(?a:\b)", lambda w: w[:2] + w[3] + w[2] + w[4:]), "doubled-word": (r"(?a:\b)[A-Za-z]{4,}(?a:\b)", lambda w: f"{w} {w}"), "punctuation": (r",(?=\s+\p{L})", lambda w: ""),
        "agreement": (r"\b(?:was|were|has|have|is|are)\b", lambda w: agreed[w]), "redundancy": (r"\b(?:said|was|were|became|looked)\b", lambda w: f"{w} again again"), "qualifier": (r"(?i)\b(?:seemed|perhaps|possibly)\b", lambda w: f"somewhat {w}"),
        "dialogue-format": ("[“”]", lambda w: '"'), "terminology": (r"\bHyde\b", lambda w: "Hide"), "sentence-frame": (r"(?i)\b(?:he|she|Mr\. Hyde|Utterson)\s+\p{L}{4,}", lambda w: f"{w}. {w}"),
        "formulaic": (r"(?m)(?<=[.!?]\s|^)[A-Z][a-z]{3,}\s+[a-z]{3,}", lambda w: f"At the end of the day, {w}"),
    }
    for kind in defects.KINDS:
        pattern, change = shapes[kind]
        left = []
        for w, chapter, scene, text in rows:
            if w != work or (chapter, scene) == control:
                continue
            talk = [(m.start(), m.end()) for m in regex.finditer("“[^”]*”", text)]
            for m in regex.finditer(pattern, text):
                a, b, new = m.start(), m.end(), change(m[0])
                over = lambda spans, a=a, b=b: any(a < y and b > x for x, y in spans)
                said = over(talk)
                if new == m[0] or (generator == 2 and "\n" in m[0] + new) or over([(x, y) for c, s, x, y in blocked if (c, s) == (chapter, scene)]):
                    continue
                if said and (kind == "formulaic" if generator == 1 else kind not in ("dialogue-format", "doubled-word")):
                    continue
                if generator == 2 and kind == "formulaic" and regex.search(rf"(?i)(?:^|\s)(?:{abbreviations})\s*$", text[max(0, a - 12) : a]):
                    continue
                if not over([(x, y) for c, s, x, y in picks if (c, s) == (chapter, scene)]):
                    left.append((chapter, scene, a, b, m[0], new, said))
        if left:
            one = left[fnv(f"{seed}:{work}:{kind}") % len(left)]
            picks.append(one[:4])
            out.append((work, one[0], one[1], kind, *one[2:]))
    return sorted(out)


@pytest.mark.parametrize(("generator", "seed"), [(1, "s"), (2, "s"), (2, "t"), (2, "u")])
def test_picks(spark, generator, seed):
    scenes, rows = book(spark)
    spans = [("alpha", 0, 0, 0, 60), ("alpha", 1, 1, 5, 9), ("beta", 0, 0, 0, 300)]
    blocked = spark.createDataFrame(spans, "work string, chapter int, scene int, start long, end long")
    control = (scenes["chapter"] == 1) & (scenes["scene"] == 2)
    got = defects.inject(scenes, "work", KEYS, PACKS["en"], seed=seed, generator=generator, blocked=blocked, control=control).collect()
    for w in ("alpha", "beta"):
        want = walked(rows, w, generator, seed, [s[1:] for s in spans if s[0] == w], (1, 2))
        assert sorted(tuple(r[:9]) for r in [(*r[:8], r.in_dialogue) for r in got if r.work == w]) == want
    assert len(got) >= 18


def test_few_places(spark):
    """Earlier picks take the only places of later kinds; a work without any place has no row."""
    rows = [("a", 0, 0, "He walked."), ("b", 0, 0, "x, y"), ("c", 0, 0, "1 2 3"), ("d", 0, 0, None), ("e", 0, 0, "whispered were perhaps, perhaps")]
    scenes = spark.createDataFrame(rows, "work string, chapter int, scene int, text string")
    got = sorted((r.work, r.kind) for r in defects.inject(scenes, "work", KEYS, PACKS["en"], seed="x").collect())
    assert got == sorted((x[0], x[3]) for w in "abce" for x in walked([r for r in rows if r[3]], w, 2, "x"))
    assert defects.inject(scenes.where("false"), "work", KEYS, PACKS["en"]).count() == 0


def test_texts_policies_and_rules(spark):
    scenes, rows = book(spark, ("alpha",))
    picks = defects.inject(scenes, "work", KEYS, PACKS["en"], seed="q").cache()
    texts = {r[:3]: r[3] for r in rows}
    done = {tuple(r[k] for k in KEYS): r.text for r in defects.mutated_texts(scenes, picks, KEYS).collect()}
    assert done.keys() == texts.keys()
    for p in picks.collect():
        assert texts[tuple(p[k] for k in KEYS)][p.start : p.end] == p.original
        assert done[tuple(p[k] for k in KEYS)][p["at"] : p["at"] + len(p.mutated)] == p.mutated
    ctx = context(scenes, PACKS["en"], rules.Settings())
    fixes = {r.kind: r.rules for r in defects.rule_fixes(scenes, picks, KEYS, "kind", ctx).collect()}
    tried = [p for p in picks.collect() if p.kind in ("typo", "doubled-word", "redundancy", "dialogue-format", "formulaic")]
    for p in tried:  # one at a time: the rules over the scene with this defect alone
        text = texts[tuple(p[k] for k in KEYS)]
        text = text[: p.start] + p.mutated + text[p.end :]
        own = spark.createDataFrame([(*(p[k] for k in KEYS), text)], scenes.schema)
        good = set()
        for d in rules.detect(own, ctx).collect():
            a, b = d.start, d.start + len(d.target)
            if a <= p.start + len(p.mutated) and b >= p.start:
                x, y = min(a, p.start), max(b, p.start + len(p.mutated))
                now = text[x:a] + d.replacement + text[b:y]
                if now in [text[x : p.start] + t + text[p.start + len(p.mutated) : y] for t in [p.original, *p.alternatives]]:
                    good.add(d.rule)
        assert set(fixes.get(p.kind, [])) == good, p
    assert fixes["doubled-word"] == ["repetition.doubled-word"] and "redundancy" in fixes
    said = {r.kind: r.policy for r in defects.labelled(picks, spark.createDataFrame([(k,) for k in fixes], "kind string"), "kind").collect()}
    assert "rule-fixable" in said["doubled-word"] and said["terminology"] == ["blocked-by-policy"] and said["punctuation"] == ["proofread-only"]


def test_traps(spark):
    scenes, rows = book(spark)
    samples = {"number": [("There were two letters.", "There were three letters."), ("He paid.", "He did not pay.")], "name": [("Ann left.", "Eva left.")]}
    got = {r.id: r for r in defects.traps(scenes, "work", KEYS, samples).collect()}
    assert len(got) == 2 * 3 * 2
    for w in ("alpha", "beta"):
        listed = [(c, s, x) for v, c, s, text in rows if v == w for x in (" ".join(y.split()) for y in regex.split(r"(?<=[.!?])\s+", text)) if 45 <= len(x) <= 180 and not set(x) & set("“”«»")]
        for at, (kind, i) in ((0, ("number", 0)), (1, ("number", 1)), (2, ("name", 0))):
            c, s, x = listed[at % len(listed)]
            r = got[f"{w}:{kind}:fixture:{i}"]
            assert (r.chapter, r.scene, r.before, r.after) == (c, s, f"{x} {samples[kind][i][0]}", f"{x} {samples[kind][i][1]}")
            assert got[f"{w}:{kind}:hand:{i}"].before == samples[kind][i][0]


def test_places_of_a_hot_key(spark):
    r = np.random.default_rng(1)
    rows = [("hot" if i % 10 else None, int(v), i, int(r.integers(0, 9))) for i, v in enumerate(r.integers(0, 500, 3000))]
    df = spark.createDataFrame(rows, "k string, a int, b int, v int").repartition(7)
    got = {x.b: x for x in ranks.before(df, ["k"], ["a", "b"], {"s": df["v"], "n": df["b"] * 0 + 1}, {"m": df["v"]}).collect()}
    for key in ("hot", None):
        total, n, most = 0, 0, None
        for _, _, b, v in sorted((x for x in rows if x[0] == key), key=lambda x: (x[1], x[2])):
            assert (got[b].s, got[b].n, got[b].m) == (total, n, most)
            total, n, most = total + v, n + 1, v if most is None else max(most, v)
    assert ranks.placed(df.where("false"), ["k"], ["a"], "p").count() == 0
    assert sorted(x.p for x in ranks.placed(df, [], ["a", "b"], "p").collect()) == list(range(3000))


def test_parts_of_words_are_not_fixable(spark, tmp_path):
    """A long run of ASCII letters inside of a word, with and without the same word behind it, against the query's SQL."""
    texts = ["Queétion tion tion éenelleen", "Queétion tion éenelleen", "Le éeux équepa quepa", "abcdé abcd", "abcd abcdé", "éabcd", "word word word", "that that", "Ende", "été", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.fixable for r in entry.queries()["rule_fixable_defects"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(c.execute(entry.oracle_sql()["rule_fixable_defects"]).fetchall())
    assert [got[i] for i in (0, 1, 4, 6)] == [False, False, True, True] and 10 not in got


def test_places_are_counted_without_being_laid_out(spark):
    """Counting gives as many places as laying them out."""
    scenes, _ = book(spark)
    none = F.array().cast("array<struct<start:int,end:int,text:string,groups:array<string>>>")
    for kind, generator in (("typo", 1), ("doubled-word", 2), ("sentence-frame", 1)):
        n, m = defects.how_many(F.col("text"), kind, PACKS["en"], generator), F.size(defects.possible(F.col("text"), kind, PACKS["en"], generator, spoken=none))
        rows = scenes.union(spark.sql("select 'x', 0, 9, cast(null as string)")).select(n.alias("n"), m.alias("m")).collect()
        assert sum(r.n for r in rows) > 10 and all(r.n == r.m for r in rows)


def test_first_place_from_the_head_of_a_text(spark):
    """Where only the first place is asked for, the text behind it isn't looked at: all of its places would be laid out."""
    from pyspark.sql import functions as F

    from folioscope.functions.matching import MATCH
    from folioscope.operators import defects, lexicon

    texts = ["one two three four " * 3000, "a b\n\nc_word wörterbuch ice some more", "é" * 50 + "\nabcd", "no it is", "", None, "abcdé abcd1 abcd", "😀 Word word"]
    en, none = lexicon.PACKS["en"], F.array().cast(MATCH)
    first = lambda text: F.get(defects.possible(text, "doubled-word", en, 1, spoken=none), 0)
    head = defects.up_to_first(F.col("text"), "doubled-word", en, 1)
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select("text", first(F.col("text")).alias("want"), first(head).alias("got"), head.alias("head")).collect()
    assert all(x.got == x.want for x in rows) and sum(x.got is not None for x in rows) == 5
    assert max(len(x.head or "") for x in rows) < 60
