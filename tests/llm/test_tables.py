"""Operators that return whole tables: rows are told apart without their ids, and no column name is in the way."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import common, decontaminate, exact_dedup, language_id, lm_score, mixing, queries, secrets, simhash, substring_dedup, token_store, url_filter
from tests.llm.test_operators import prose, unlike

#: Names that operators use inside.
ODD = ["_gone", "_again", "_spans", "_copies", "_copy", "_id", "_x", "_s", "_hits", "_rows", "_k", "_n", "_c0", "_c1", "row", "base", "tested", "spans", "t", "hits", "h4", "copies", "deal", "cell", "`odd` name."]


@pytest.fixture(scope="module")
def docs(spark):
    a, b = prose(1, 60), unlike(2, 60)
    rows = [(1, "my password=hunter22 is here", "s"), (1, "a clean hello friend of mine", "s"), (1, "x token: abcdefgh y token: zyxwvuts", "s"), (None, "token=abcdefgh", None), (None, None, None), (None, "", "s"), (2, a, "s"), (2, a, "s"), (2, b, "s"), (3, a, "r"), (4, a + " " + b, "r"), (5, None, "r"), (6, "one", None)]
    rows = [(*r, *[k] * len(ODD)) for k, r in enumerate(rows)]
    kinds = "doc_id long, text string, source string, " + ", ".join(f"`{c.replace('`', '``')}` int" for c in ODD)
    return spark.createDataFrame(rows, kinds).repartition(3, "_n")


def told(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def place(row):
    return row["_n"]


def test_masking(docs):
    got = secrets.mask_secrets(docs)
    assert got.columns == docs.columns
    texts = {place(r): r.text for r in got.collect()}
    assert len(texts) == 13 and got.count() == 13
    assert texts[0] == "my [secret] is here" and texts[1] == "a clean hello friend of mine" and texts[2] == "x [secret] y [secret]" and texts[3] == "[secret]"
    before = {place(r): r.text for r in docs.collect()}
    assert all(texts[k] == before[k] for k in texts if k not in (0, 2, 3))
    assert secrets.mask_secrets(docs.where("false")).count() == 0


def test_overlapping_spans_are_masked_together(spark):
    docs = spark.createDataFrame([("secret=AKIA" + "A" * 16 + "_" + "f" * 30 + " tail",), ("secret=abcdef" + "é" + "0" * 24,)], "text string")
    assert [r.text for r in secrets.mask_secrets(docs).collect()] == ["[secret] tail", "[secret]é[secret]"]


def test_many_matches_take_linear_time(spark):
    text = " ".join(f"token=abc{i:05d}" for i in range(20_000))
    row = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert len(row.base) == 20_000 and row.base[-1].end == len(text) and row.base[1].start == 15


def test_spans_are_cut_in_their_rows(spark, docs):
    bench = spark.createDataFrame([("i", "hello FRIEND"), ("j", "one")], "item_id string, text string")
    got = decontaminate.remove_spans(docs, bench)
    assert got.columns == docs.columns
    texts, before = ({place(r): r.text for r in x.collect()} for x in (got, docs))
    assert got.count() == 13 and texts[1] == "a clean   of mine" and texts[12] == ""
    assert all(texts[k] == before[k] for k in texts if k not in (1, 12))
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {place(r) for r in kept.collect()} == set(range(12)) - {1}
    assert decontaminate.remove_spans(docs, bench.where("false")).count() == 13 and decontaminate.drop_contaminated(docs.where("false"), bench).count() == 0


def test_one_of_each_group_stays(docs):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(place(r) for r in rows if r.doc_id is None) == [3, 4, 5]
    assert Counter(r.doc_id for r in rows if r.doc_id is not None)[2] == 1 and 3 not in {r.doc_id for r in rows}
    assert simhash.drop_near_duplicates(docs.where("false")).count() == 0


def test_mix_takes_what_is_planned(docs):
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    plan = mixing.mix_plan(docs).collect()
    want = Counter()
    for r in plan:
        want[r.doc_id, r["size"]] += r["copies"]
    size = lambda t: len((t or "").split())
    took = Counter((r.doc_id, size(r.text)) for r in got.collect())
    assert took == +want
    assert told(got) == told(mixing.mix(docs.repartition(5))) or took == Counter((r.doc_id, size(r.text)) for r in mixing.mix(docs.repartition(5)).collect())
    assert mixing.mix(docs.where("false")).count() == 0


def test_language_stage(docs):
    kept = language_id.keep_identified(docs.withColumn("lang", F.when(F.col("doc_id") == 2, "aa")))
    assert kept.columns == [*docs.columns, "lang"] and {place(r) for r in kept.collect()} == set(range(13)) - {4, 5, 11}


def test_exact_groups(docs):
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == 13 and {(r.doc_id, r.keep_id, r.group_size) for r in got if r.doc_id in (2, 3)} >= {(2, 2, 3), (3, 2, 3)}
    deep = exact_dedup.exact_groups(docs, capacity=1, depth=13).collect()
    assert told_rows(deep) == told_rows(got)


def told_rows(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


def test_letters(spark):
    docs = spark.createDataFrame([(i, t, "aa") for i, t in enumerate(["kala", "²", "½ 12", "Ⅳ", "é", "日本", "_ 5"])], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()}
    assert {i for i, (lang, _) in got.items() if lang == "und"} == {1, 2, 3, 6} and got[1] == ("und", 0.0)


@pytest.mark.parametrize("enc", ["hex", "base32", "base64"])
def test_battery(spark, enc):
    """p-values against numpy, and planted random tokens of every length among ordinary ones."""
    r = np.random.default_rng(4)
    abc = secrets.ALPHABETS[enc]
    sizes = [20, 28, 40, 64, 120]
    upper = (lambda t: t.upper()) if enc == "hex" else (lambda t: t)
    planted = {1000 * k + i: upper("".join(r.choice([*abc], n))) for k, n in enumerate(sizes) for i in range(120)}
    syllables = ["ment", "tion", "ing", "the", "and", "er", "est", "ous"]
    plain = {5000 + i: "".join(r.choice(syllables, 5 + i % 20)) for i in range(100)}
    plain = {i: t.upper() if enc == "base32" else t for i, t in plain.items() if len(t) >= 20}
    docs = spark.createDataFrame([(i, f"see {t} there") for i, t in (planted | plain).items()], "doc_id long, text string")
    found = {x.doc_id for x in secrets.find_secrets(docs).collect() if any(s.kind == "random" for s in x.spans)}
    for k, n in enumerate(sizes):
        own = {i for i in planted if i // 1000 == k}
        assert len(found & own) >= 0.9 * len(own), (enc, n, len(found & own))
    assert len(found - set(planted)) <= 0.05 * max(1, len(found)) + 1
    lone = spark.createDataFrame([(1, "".join(r.choice([*abc], 300)) if enc != "hex" else upper("".join(r.choice([*abc], 300)))), (2, "mention" * 43)], "doc_id long, text string")
    assert {x.doc_id for x in secrets.find_secrets(lone).collect() if x.spans} <= {1}
    tested = secrets._scanned(docs, "text").select(F.col("row.doc_id").alias("id"), F.explode("tested").alias("c")).select("id", "c.*").collect()
    for x in tested[:40]:
        w = (planted | plain)[x.id].rstrip("=")
        w = w.lower() if x.enc == "hex" else w
        own = secrets.ALPHABETS[x.enc]
        codes, n, a = np.array([own.index(ch) for ch in w]), len(w), len(own)
        z1 = (a / n * (np.bincount(codes, minlength=a) ** 2).sum() - n - (a - 1)) / np.sqrt(2 * (a - 1) * (1 - 1 / n))
        half = codes >= a // 2
        z2 = abs((half[1:] != half[:-1]).sum() - (n - 1) / 2) / np.sqrt((n - 1) / 4)
        flat = codes - (a - 1) / 2
        z3 = abs((flat[1:] * flat[:-1]).sum()) / ((a * a - 1) / 12 * np.sqrt(n - 1))
        from math import erfc, exp, log, sqrt

        tail = lambda z: erfc(z / sqrt(2)) / 2
        joint = -log(max(tail(z1), 1e-300)) - log(max(min(1, 2 * tail(z2)), 1e-300)) - log(max(min(1, 2 * tail(z3)), 1e-300))
        assert abs(x.p - exp(-joint) * (1 + joint + joint * joint / 2)) < 1e-5


def test_listed_urls_are_blocked(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x?q"), (2, "http://A.org/x#f"), (3, "http://a.org/xy"), (4, "http://b.a.org/x"), (5, "http://a.org/fr/x"), (6, None)], "page_id long, url string")
    rules = spark.createDataFrame([("allow", "org", "/fr/")] + [("block", f"h{i}.com", "/" + "p" * i) for i in range(40)], "action string, host string, path string")
    listed = spark.createDataFrame([("http://a.org/x",), ("http://a.org/fr/x",), (None,)], "url string")
    got = {r.page_id: (r.verdict, r.listed) for r in url_filter.judge_urls(pages, rules, listed).collect()}
    assert got == {1: ("block", True), 2: ("block", True), 3: ("allow", False), 4: ("allow", False), 5: ("allow", True), 6: ("allow", False)}
    none = url_filter.judge_urls(pages, rules.where("false"), listed.where("false")).collect()
    assert {r.verdict for r in none} == {"allow"}


def test_shared_folder(spark, monkeypatch):
    class Far:
        master, applicationId = "spark://far:7077", "far"

    class Session:
        sparkContext = Far()

        class conf:
            get = staticmethod(lambda name, other=None: other)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_dir(Session())


def test_digests(spark, tmp_path):
    """The queries' digest columns, from their operators' results."""
    import hashlib
    import zlib

    d = str(tmp_path)
    rows = [(0, "token=abcdefg and AKIA" + "B" * 16, "aa", "s"), (1, None, None, None), (2, "kala laki kali", "aa", "s"), (3, "kala laki kali", "aa", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    found = {r.doc_id: r for r in secrets.op10(spark, d).collect()}
    said = "assign:0:13,access:18:38"
    assert found[0].spans == said and found[0].base_sha256 == hashlib.sha256(said.encode()).hexdigest() and (found[0].n_assign, found[0].n_access, found[0].n_hex) == (1, 1, 0)
    assert found[1].spans == "" and found[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    prints = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op4(spark, d).collect()}
    assert prints[2] == (f"{simhash.fingerprint(b'kala laki kali'):016x}", 2) == prints[3] and prints[1] == ("0" * 16, 1)
    tokens = {r.doc_id: r for r in token_store.op3(spark, d).collect()}
    ids = np.append(token_store.Encoder(token_store.vocabulary()).encode_many([rows[0][1]])[0], 2).astype("<u4")
    assert (tokens[0].start, tokens[0].n_tokens, tokens[0].ids_crc32) == (0, len(ids), zlib.crc32(ids.tobytes())) and tokens[1].start == len(ids) and tokens[1].n_tokens == 1
    langs = {r.doc_id: r for r in language_id.op9(spark, d).collect()}
    assert langs[1].lang_pred == "und" and langs[2].lang_pred == "aa" and langs[0].held_out == (zlib.crc32(b"0") % 4 == 2)
    scores = {r.doc_id: r for r in lm_score.op6(spark, d).collect()}
    assert scores[1].n_tokens == 1 and scores[2].n_tokens == 4 and all(r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2) for i, r in scores.items())
    assert substring_dedup.op8(spark, d).count() == 0 and set(queries.QUERIES) >= {"op8_substring_dedup"}
