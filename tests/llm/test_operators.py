"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from folioscope.llm import decontaminate, exact_dedup, language_id, lm_score, mixing, secrets, simhash, substring_dedup, token_store, url_filter
from folioscope.llm.common import components, lower_ascii, materialize

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
#: Columns whose names operators use inside.
ODD = "doc_id long, text string, source string, lang string, id string, key string, words string, uid string, n long, fp long, cell int, t string"


def prose(seed, n, words=WORDS):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(words, n))


@pytest.fixture(scope="module")
def docs(spark):
    long = prose(5, 30_000)
    texts = [None, "", "   \n", "One", "one", prose(1, 80), prose(1, 80), prose(1, 80).upper(), prose(2, 120) + " é", long, "x y z", "x  y\tz", "pi " * 400]
    rows = [(i, t, f"s{i % 3}" if i % 4 else None, "en", "a", "b", "c", "d", 1, 2, 3, "e") for i, t in enumerate(texts)]
    rows += [(5, prose(1, 80), "s2", "en", "a", "b", "c", "d", 1, 2, 3, "e"), (None, "one", None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, ODD).repartition(3, "n")


def empty(docs):
    return docs.where("false")


def rows_of(docs):
    return docs.select("doc_id", "text", "source").collect()


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_lower_ascii(spark):
    row = spark.createDataFrame([("AÉİz",), ("ABC",), (None,)], "t string").select(lower_ascii(F.col("t")).alias("x")).collect()
    assert [r.x for r in row] == ["aÉİz", "abc", None]


def test_components(spark):
    r = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 90, (60, 2))] + [(i, i + 1) for i in range(200, 260)]
    got = {x.node: x.root for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {n: n for p in pairs for n in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in root if any(n in p and p[0] != p[1] for p in pairs)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- exact deduplication -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [256, 4])
def test_exact(docs, bits):
    rows = rows_of(docs)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for r in rows:
        groups.setdefault(norm(r.text), []).append((-len(r.text or ""), r.doc_id is None, r.doc_id))
    got = exact_dedup.exact_groups(docs, capacity=2, depth=3, key_bits=bits).collect()
    want = sorted(((r.doc_id, min(groups[norm(r.text)], key=lambda x: (x[0], x[1], x[2] or 0))[2], len(groups[norm(r.text)]), hashlib.sha256(norm(r.text).encode()).hexdigest()) for r in rows), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_exact_edges(docs):
    assert exact_dedup.exact_groups(empty(docs)).count() == 0
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and {3, 4} <= {r.doc_id for r in kept.collect()} and 6 not in {r.doc_id for r in kept.collect()}


def test_directory(spark):
    counts = spark.createDataFrame([(0, 9), (1, 1), (7, 1)], "slot int, n long")
    d = exact_dedup.directory(counts, 5, 3)
    assert d == {0: 3, 1: 3, 2: 2, 3: 2, 4: 1, 5: 1, 6: 1, 7: 1}


# --- decontamination ---------------------------------------------------------------------------------------------


def test_decontaminate(spark, docs):
    a, b = prose(1, 80), prose(2, 120)
    bench = spark.createDataFrame([("i1", " ".join(a.split()[20:40]), 1), ("i2", "X, y; Z!", 1), ("i3", None, 1), ("i4", "...", 1), ("i5", "one", 1), ("i5", " ".join(b.split()[3:16]), 1), (None, " ".join(b.split()[50:64]), 1)], "item_id string, text string, pos int")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = [(r.item_id, pattern.findall(low(r.text))) for r in bench.collect()]
    want = []
    for r in rows_of(docs):
        w = pattern.findall(low(r.text))
        hit, names = set(), set()
        for name, words in items:
            n = min(13, len(words))
            grams = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    names |= {name} - {None}
        want.append((r.doc_id, len(w), len(hit), sorted(names), len(hit) > 0 and 20 * len(hit) >= len(w)))
    for limit in (1_000_000, 0):  # broadcast and shuffled
        found = decontaminate.judged(decontaminate.contamination(docs, bench, broadcast_windows=limit)).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in found), key=str) == sorted(want, key=str)
    bad = {w[0] for w in want if w[4] and w[0] is not None}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == {r.doc_id for r in rows_of(docs)} - bad
    assert decontaminate.contamination(empty(docs), bench).count() == 0
    none = decontaminate.judged(decontaminate.contamination(docs, bench.where("false"))).collect()
    assert len(none) == len(want) and not any(r.contaminated for r in none)


def test_remove_spans(spark):
    docs = spark.createDataFrame([(1, "Keep, this! One two three. Rest é"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([("a", "one two THREE")], "item_id string, text string")
    got = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench).collect()}
    assert got == {1: "Keep, this!   . Rest é", 2: None}


# --- mixing ------------------------------------------------------------------------------------------------------


def test_mixing(spark, docs):
    rows = rows_of(docs)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = {}
    for r in rows:
        per[r.source] = per.get(r.source, 0) + size(r.text)
    names = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    while open_:
        left = sum(per.values()) - sum(target[s] for s in names if s not in open_)
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * per[s]}
        for s in full or open_:
            target[s] = 3.0 * per[s] if full else level * weight[s]
        open_ = open_ - full if full else set()
    got = mixing.mix_plan(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.source for r in rows if r.doc_id is not None}
    for r in got:
        assert r["copies"] <= 3
        if r.doc_id in by and r.doc_id != 5:
            assert r["source_size"] == per[by[r.doc_id]] and abs(r["target"] - target[by[r.doc_id]]) < 1e-6 * (1 + r["target"])
    again = mixing.mix_plan(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix_plan(empty(docs)).count() == 0
    assert mixing.mix(docs).columns == docs.columns


def test_mixing_hits_targets(spark):
    r = np.random.default_rng(1)
    rows = [(i, prose(i, int(r.integers(1, 60))), "big" if i % 3 else f"s{i % 5}") for i in range(1500)]
    plan = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    source = {i: s for i, _, s in rows}
    taken = {}
    for p in plan:
        t = taken.setdefault(source[p.doc_id], [p.target, 0])
        t[1] += p["copies"] * p["size"]
    assert all(abs(t - got) <= max(180, 0.02 * t) for t, got in taken.values()), taken


# --- tokens ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2**32 - 1], list(range(0, 70_000, 7))])
def test_codes(ids):
    c = token_store.Codes(token_store.pack(np.array(ids, np.uint32)))
    assert len(c) == len(ids) and c.read(0, len(ids)).tolist() == ids
    for i in {0, 1, len(ids) // 2, len(ids) - 1} & set(range(len(ids))):
        assert c[i] == ids[i] and c.read(i, len(ids)).tolist() == ids[i:]
    with pytest.raises(IndexError):
        c[len(ids)]


TRICKY = ["", " ", "a", " a  b", "a\nb", "a \n b.", "Hi.\nYou, b.", "x\ty z", "é, ñ. b", "it's, don't. 1,000.5", "a,,b c,. d", "a.%%% b, c?. d", 'x",y "z", w', "<|endoftext|> q", "tail\n", "日本 語、x", "1/2, ½, x"]


def test_encoder():
    from tokenizers import Tokenizer

    path = token_store.vocabulary()
    plain = Tokenizer.from_file(path)
    enc, tight = token_store.Encoder(path), token_store.Encoder(path, cached=3)
    r = np.random.default_rng(11)
    signs = [*"abXY01 .,;:'\"!?-_(\n\n  \t\r\x0b\x1c\x1f\x00\x01", "é", "½", "²", "日", "İ", "ß", "\u0301", "\u0085", "\u00a0", "\u2003", "\u3000", "\u200b", "😀", "'s", " the", "\n\n", "   ", "<|endoftext|>"]
    texts = TRICKY + [prose(i, 50) + ". " + prose(i, 9).title() + "," for i in range(40)]
    texts += ["".join(r.choice(signs, r.integers(0, 30))) for _ in range(4000)]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    for e in (enc, enc, tight):
        assert [x.tolist() for x in e.encode_many(texts)] == want
    assert enc.encode_many([]) == [] and [50256] in [x.tolist() for x in enc.encode_many(["<|endoftext|>"])]
    long = "z" * 30_000 + " " + "é," * 2000
    assert enc.encode_many([long])[0].tolist() == plain.encode(long, add_special_tokens=False).ids


def test_words_go_to_the_library_together():
    """Thousands of new words are a few calls, with the ids that each word has alone."""
    enc, calls = token_store.Encoder(token_store.vocabulary()), []
    model = enc.model
    enc.model = type("Counted", (), {"encode_batch_fast": lambda self, texts, **k: calls.append(1) or model.encode_batch_fast(texts, **k), "tokenize": lambda self, w: calls.append(1) or model.tokenize(w)})()
    words = [f"{a}{b}{c}{m}" for a in ("the", "na\u00efve", "Stra\u00dfe", "\u0451\u0436") for b in "abcdefghijkl" for c in ("er", "ing", "z\u00e9q", "X") for m in ("", ".", ",", ";", ":", "!", "?")]
    assert enc.encode_many([" ".join(words)])[0].tolist() == enc.tokenizer.encode(" ".join(words), add_special_tokens=False).ids
    assert 0 < len(calls) <= len(words) // token_store.TOGETHER + 1


def test_pieces_asked_for_again_are_kept():
    enc = token_store.Encoder(token_store.vocabulary(), cached=8)
    plain, new = enc.tokenizer, (f"z{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(500))
    for _ in range(30):
        texts = [f"the thing, na\u00efvet\u00e9. {next(new)} {next(new)}", f"the  thing, {next(new)}\n{next(new)} "]
        assert [x.tolist() for x in enc.encode_many(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(enc.known) <= 8 + 8 and len(enc.again) == len(enc.ends) - 1
    assert {"thing,", "na\u00efvet\u00e9."} <= {*enc.known} and enc.again[enc.known["thing,"]]


def test_token_store(spark, docs, tmp_path):
    enc = token_store.Encoder(token_store.vocabulary())
    rows = sorted(rows_of(docs), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    want, start, every = [], 0, []
    for r in rows:
        ids = np.append(enc.encode_many([r.text or ""])[0], 2).astype("<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
        every += ids.tolist()
    path = str(tmp_path / "store")
    token_store.write_tokens(docs, path, shards=3, segment=500)
    assert sorted(map(str, (tuple(r) for r in token_store.read_documents(spark, path).collect()))) == sorted(map(str, want))
    assert token_store.tokens_of(spark, path, 10, 2000).tolist() == every[10:2000]
    token_store.write_tokens(empty(docs), str(tmp_path / "none"))
    assert token_store.read_documents(spark, str(tmp_path / "none")).count() == 0


def test_token_portions():
    """However large its batches are, little text is encoded at once: what that takes grows with it."""
    import pyarrow as pa

    r, met = np.random.default_rng(3), []
    words = ["".join(r.choice([*"abcdefgh"], 5)) for _ in range(20_000)]
    texts = [" ".join(r.choice(words, 600)) for _ in range(1024)] + ["", " ".join(r.choice(words, 200_000))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["id", "text"])

    class Counting(token_store.Encoder):
        def encode(self, texts):
            met.append((len(texts), sum(len(t) for t in texts.to_pylist())))
            return super().encode(texts)

    enc = Counting(token_store.vocabulary())
    got = [(i, ids[a:b].tolist()) for names, ids, ends in token_store.encoded(enc, iter([batch, batch.slice(0, 3)])) for i, a, b in zip(names.to_pylist(), [0, *ends[:-1]], ends, strict=True)]
    assert all(size <= (1 << 20) + 8192 + (size > len(texts[-1])) * len(texts[-1]) for _, size in met) and len(met) > 4
    want = enc.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert got == [(i, want[i].ids) for i in [*range(len(texts)), 0, 1, 2]]


# --- simhash -----------------------------------------------------------------------------------------------------


def slow_print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxh64_intdigest(x.encode(), 42) for x in s]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


@pytest.mark.parametrize("dense", [48, 1])
def test_simhash(docs, dense):
    rows = [r for r in rows_of(docs) if len(r.text or "") < 5000]
    prints = [slow_print(r.text) for r in rows]
    got = {(r.doc_id, r.fp & (2**64 - 1)): r.component_id for r in simhash.near_duplicates(docs.where("length(text) < 5000 or text is null"), dense=dense).collect()}
    for r, p in zip(rows, prints, strict=True):
        near = {r2.doc_id for r2, q in zip(rows, prints, strict=True) if (p ^ q).bit_count() <= 2 and r2.doc_id is not None}
        assert got[(r.doc_id, p)] == min(near)
    assert simhash.near_duplicates(empty(docs)).count() == 0


@pytest.mark.parametrize("dense", [48, 2])
def test_simhash_links(spark, dense):
    r = np.random.default_rng(4)
    base = [int(x) for x in r.integers(0, 2**63, 30)]
    prints = sorted({b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in r.integers(0, 64, (12, 2))} | set(base))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    groups = materialize(spark.createDataFrame([(p, i) for i, p in enumerate(signed)], "fp long, rep long"), "t")
    links = components(simhash.near_links(groups, dense=dense))
    got = {x.node: x.root for x in links.collect()}
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= 2:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert all(got.get(i, i) == find(i) for i in range(len(prints)))


def test_simhash_drop(docs):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 1 and 6 not in ids and 7 not in ids and ids.count(None) == 2


# --- URLs --------------------------------------------------------------------------------------------------------


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://A.NET/x?y#z", "http://a.net", "https://m.example.net/en/1", "http://example.net/de/", "http://x.example.com/de/q", "http://example.com/fr", "ftp://b.org/fr/1", "http://borg/fr/1", "http://listed.io/a?b=1", "http://listed.io/b", "http://a.net/x?y#z"]
    pages = spark.createDataFrame([(i, u, "odd", "odd") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    rules = spark.createDataFrame(list(url_filter.RULES), "action string, host string, path string")
    listed = spark.createDataFrame([(f"http://listed{i}.io/a",) for i in range(3000)] + [("https://listed.io/a#frag",), (None,)], "url string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, rules, listed).collect()}
    assert len(got) == len(urls)
    want = {4: ("a.net", "/x", "net/", "block"), 5: ("a.net", "", None, "allow"), 6: ("m.example.net", "/en/1", "example.net/en/", "allow"), 7: ("example.net", "/de/", "net/", "block"), 8: ("x.example.com", "/de/q", "example.com/de/", "block"), 9: ("example.com", "/fr", None, "allow"), 10: ("b.org", "/fr/1", "org/fr/", "allow"), 11: ("borg", "/fr/1", None, "allow"), 12: ("listed.io", "/a", None, "block"), 13: ("listed.io", "/b", None, "allow")}
    for i, w in want.items():
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == w
    assert all((got[i].host, got[i].path, got[i].verdict) == ("", "", "allow") for i in range(4))
    assert url_filter.judge_urls(pages.where("false"), rules).count() == 0
    assert url_filter.judge_urls(pages, rules.where("false")).count() == len(urls)


def test_bloom(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(2000)], "key string")
    other = spark.createDataFrame([(f"x{i}",) for i in range(20000)], "key string")
    blocks = 2000 * 16 // 256 + 1
    bloom = url_filter.blocked_bloom(keys, blocks)
    assert url_filter.probe(keys, bloom, blocks).count() == 2000
    assert url_filter.probe(other, bloom, blocks).count() < 400


# --- language model ----------------------------------------------------------------------------------------------


def test_lm(spark, docs):
    train = docs.where("doc_id % 2 = 1")
    got = lm_score.score_documents(docs, train, vocab=12, shapes=4, classes=3, hidden=6, frequent=16).collect()
    from collections import Counter

    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", low(t).encode()) + [b"\n"]
    c = Counter(w for r in rows_of(train) for w in split(r.text))
    n, v = sum(c.values()), len(c)
    want = sorted((str(r.doc_id), len(split(r.text)), sum(w in c for w in split(r.text)), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in split(r.text)), 4)) for r in rows_of(docs))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert lm_score.score_documents(empty(docs), train, vocab=12, shapes=4, classes=3, hidden=6).count() == 0
    none = lm_score.score_documents(docs, empty(docs), vocab=12, shapes=4, classes=3, hidden=6).collect()
    assert len(none) == len(got) and all(r.n_known == 0 and r.train_tokens == 0 for r in none)


def test_network_is_fitted_on_every_training_row(spark, monkeypatch):
    rows = [(i, prose(600 + i // 3, 20)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    seen, fit = [], lm_score.fit
    monkeypatch.setattr(lm_score, "fit", lambda seqs, *a, **k: seen.extend(bytes(r.seq) for r in seqs.select("seq").collect()) or fit(seqs, *a, **k))
    monkeypatch.setattr(lm_score, "table", lambda *_: docs.drop("held_out"))
    got = lm_score.op6(spark, "").collect()
    assert {r.doc_id: r.held_out for r in got} == {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(60)}
    learned = docs.where("not held_out").collect()
    counts = sorted({w: sum(r.text.split().count(w) for r in learned) for w in WORDS}.items(), key=lambda x: (-x[1], x[0]))
    ids = {w: i for i, (w, n) in enumerate(counts) if n}
    assert sorted(seen) == sorted(np.array([ids[w] for w in r.text.split()], np.int16).tobytes() for r in learned)
    as_table = lm_score.score_documents(docs, docs.where("not held_out")).collect()
    assert sorted((r.doc_id, round(r.base_score, 6), round(r.score, 3)) for r in got) == sorted((r.doc_id, round(r.base_score, 6), round(r.score, 3)) for r in as_table)


def test_frequent_words(spark):
    counts = [1] * 50 + [2] * 20 + [3, 3, 700, 5000, 5100, 90_000]
    words = spark.createDataFrame([(f"w{i}".encode(), n) for i, n in enumerate(counts)], "word binary, n long")
    for most in (0, 1, 2, 3, 4, 6, 20, 26, 75, 76, 1000):
        top, least = lm_score.frequent_words(words, most)
        kept = top["n"].tolist()
        assert len(kept) <= most and kept == sorted(kept, reverse=True) and kept == [n for n in sorted(counts, reverse=True) if n >= least]
    assert len(lm_score.frequent_words(words, 26)[0]) == 26 and len(lm_score.frequent_words(words, 25)[0]) == 6


def test_network_is_a_distribution():
    lay = lm_score.layout([b"a", b"b", b"c", b"d", b"e"], [5, 4, 3, 2, 1], 3, 2)
    net = lm_score.Network(lay, 4)
    h = np.random.default_rng(0).standard_normal((1, 4)).astype(np.float32)
    total = sum(np.exp(net.output(h, np.array([i]))[0][0]) for i in range(len(lay)))
    assert abs(total - 1) < 1e-4


def test_network_state_is_carried():
    lay = lm_score.layout([b"a", b"b", b"c"], [3, 2, 1], 2, 2)
    net = lm_score.Network(lay, 4)
    seq = np.random.default_rng(1).integers(0, len(lay), 77).astype(np.int32)
    h, last, total = np.zeros((1, 4), np.float32), lay.end, 0.0
    for i in [*seq, lay.end]:
        after = np.empty((1, 4), np.float32)
        net.step(net.p["x"][np.array([last])], h, np.empty((1, 8), np.float32), np.empty((1, 4), np.float32), np.empty((1, 4), np.float32), after)
        h = after
        total += net.output(h, np.array([i]))[0][0]
        last = i
    others = [seq[:5], seq[:40], np.zeros(0, np.int32)]
    for window in (3, 32, 100):
        assert abs(net.score([*others, seq], window=window)[3] - total / np.log(10)) < 1e-3


def test_network_gradients():
    """The gradient of one window against differences of the loss, for every parameter, and a cycle that is learned."""
    lay = lm_score.layout([b"a", b"b", b"c", b"d"], [4, 3, 2, 1], 4, 2)
    r = np.random.default_rng(2)
    docs = [r.integers(0, len(lay), n).astype(np.int32) for n in (5, 0, 7)]
    docs = [np.where(d == lay.end, 0, d) for d in docs]

    def double():
        net = lm_score.Network(lay, 3)
        net.load((net.flat * 3).astype(np.float64))
        net.p["wb"][...] = np.where(net.p["wb"] < -100, -1e4, r.standard_normal(net.p["wb"].shape))
        return net

    net = double()
    start, tokens = net.flat.copy(), sum(len(d) + 1 for d in docs)
    grads = {}

    class Kept(lm_score.Network):
        def views(self, flat):
            if hasattr(self, "flat") and flat is not self.flat:
                grads["flat"] = flat
            return super().views(flat)

    got = Kept(lay, 3)
    got.load(start.astype(np.float32))
    got.train(docs, 1, 64, 0.0)

    def loss(flat):
        own = lm_score.Network(lay, 3)
        own.load(flat.astype(np.float32))
        return -own.score(docs).sum() * np.log(10) / tokens

    checked = 0
    for i in np.flatnonzero(start > -100):
        up, down = start.copy(), start.copy()
        up[i] += 1e-2
        down[i] -= 1e-2
        slope = (loss(up) - loss(down)) / 2e-2
        assert abs(slope - grads["flat"][i]) < 2e-3 + 0.03 * abs(slope), (i, slope, grads["flat"][i])
        checked += abs(slope) > 1e-3
    assert checked > 80
    seq = [np.array([0, 1, 2, 0, 1, 2, 0, 1, 2, 0] * 6, np.int32)]
    net = lm_score.Network(lay, 8)
    before = net.score(seq)[0]
    for _ in range(30):
        net.train(seq, 1, 10, 0.02)
    assert net.score(seq)[0] > before / 3


# --- substring deduplication -------------------------------------------------------------------------------------


def test_passages(spark):
    shared, other = prose(100, 70), prose(101, 55)
    near = shared.split()
    near[30] = "changed"
    texts = {1: prose(1, 90) + " " + shared + " " + prose(2, 60), 2: shared + " " + prose(3, 40), 3: prose(4, 200), 4: prose(5, 30) + " " + " ".join(near) + " " + prose(6, 30), 5: other + " " + prose(7, 100), 6: prose(8, 20) + " " + other, 7: " ".join(shared.split()[:40]) + " " + prose(9, 100), 8: prose(4, 200), 9: None, 10: "", 11: "a b " * 300, 12: prose(12, 10), 13: prose(12, 10)}
    rows = [(i, t, "x") for i, t in texts.items()] + [(None, shared, "x"), (3, texts[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid string")
    got = substring_dedup.repeated_passages(docs).collect()
    classes = {}
    for r in got:
        assert r.end - r.start >= 50 and r.similarity >= 0.8
        classes.setdefault(r.class_id, set()).update((r.doc_id, r.partner_id))
    assert classes == {1: {1, 2, 4}, 3: {3, 8}, 5: {5, 6}}
    assert substring_dedup.repeated_passages(docs.where("false")).count() == 0


def unlike(seed, n):
    """Words of which no two texts share a stretch by chance."""
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 20_000, n))


@pytest.mark.parametrize(("few", "block"), [(8, 256), (1000, 12), (2, 5)])
def test_crowded_passages(spark, few, block):
    """Postings too long to be paired off at once: all holders of a passage meet, holders of a common line don't."""
    r = np.random.default_rng(5)
    passage, edited, line = unlike(200, 64), unlike(201, 60), unlike(202, 17)
    said = [f"{unlike(1000 + i, 30)} {passage} {unlike(2000 + i, 30)}" for i in range(40)]

    def changed(text, i):
        out = text.split()
        out[int(r.integers(len(out)))] = f"changed{i}"
        return " ".join(out)

    said += [f"{unlike(3000 + i, 25)} {changed(passage, i)} {unlike(4000 + i, 25)}" for i in range(40)]
    said += [f"{unlike(5000 + i, 25)} {changed(edited, 100 + i)} {unlike(6000 + i, 25)}" for i in range(60)]
    said += [f"{unlike(7000 + i, 60)} {line} {unlike(8000 + i, 60)}" for i in range(40)]
    said += [f"{unlike(9000, 30)} {unlike(9001 + i, 100)}" for i in range(5)] + ["same " * 300, "same " * 200, "a b " * 150, f"a b {'a b ' * 100}end"]
    got = substring_dedup.repeated_passages(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string"), few=few, block=block).collect()
    classes = {}
    for x in got:
        classes.setdefault(x.class_id, set()).update((x.doc_id, x.partner_id))
    assert classes[0] >= set(range(40)) and len(classes[0] & set(range(80))) >= 78
    own = [c & set(range(80, 140)) for c in classes.values()]
    assert max(map(len, own)) >= 54
    assert not any(c & set(range(140, 185)) for c in classes.values())
    assert {185, 186} in classes.values() and {187, 188} in classes.values()


@pytest.mark.parametrize("few", [4, 24])
def test_every_holder_of_a_passage_has_a_row(spark, few):
    """The representative of a crowded passage stands anywhere among its holders, and the least id of a pair is one too."""
    groups = [(range(0, 20), 300), (range(20, 22), 301), (range(22, 25), 302)]
    rows = [(i, f"{unlike(400 + i, 30)} {unlike(seed, 56)} {unlike(500 + i, 30)}") for ids, seed in groups for i in ids]
    rows += [(25, rows[24][1]), (26, unlike(600, 90))]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), few=few).collect()
    assert {r.doc_id for r in got} == set(range(26))
    links = {(r.doc_id, r.start, r.end, r.partner_id, r.partner_start, r.partner_end, r.similarity, r.class_id) for r in got}
    assert {(*x[3:6], *x[:3], *x[6:]) for x in links} == links and len(links) == len(got)


def test_edited_copies_of_a_crowded_passage(spark):
    """Copies changed in the middle share 22 words on no side with most others, and aren't like each other."""
    passage = prose(300, 50).split()
    rows = [(0, f"{prose(4000, 30)} {' '.join(passage)} {prose(5000, 30)}")]
    for i in range(1, 17):
        copy = [*passage]
        copy[23 + i % 4] = f"changed{i}"
        rows.append((i, f"{prose(4000 + i, 30)} {' '.join(copy)} {prose(5000 + i, 30)}"))
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {frozenset((r.doc_id, r.partner_id)) for r in got} >= {frozenset((0, i)) for i in range(1, 17)}
    assert {r.class_id for r in got} == {0}


def test_pairs_are_met_once(spark):
    rows = [(1, i % 7, 0, 0, 50 + i, 120, 11) for i in range(11)] + [(2, i, 1, 0, 60, 120, 2) for i in range(2)]
    found = spark.createDataFrame(rows, "key long, uid long, f int, l int, c int, r int, count long")
    said = lambda df: sorted((x.a, x.ca, x.b, x.cb) for x in df.collect())
    want = sorted((x[1], x[4], y[1], y[4]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1])
    assert said(substring_dedup.all_pairs(found, 46)) == want and substring_dedup.all_pairs(found, 500).isEmpty()
    rooted = lambda sets: spark.createDataFrame([(x[0], x[1], sets.get(x[1], x[1]), x[4]) for x in rows], "key long, uid long, root long, w int")
    for block in (1, 3, 100):
        for sets in ({}, {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}, dict.fromkeys(range(7), 0)):
            over = [w for w in want if sets.get(w[0], w[0]) != sets.get(w[2], w[2])]
            met = substring_dedup.across(rooted(sets), block).collect()
            assert sorted((x.x.uid, x.x.w, x.y.uid, x.y.w) if x.x.uid < x.y.uid else (x.y.uid, x.y.w, x.x.uid, x.x.w) for x in met) == over
    stars = {(x.a, x.b) for x in substring_dedup.star_pairs(found, 46).collect()}
    assert {n for p in stars for n in p} == set(range(7)) and len(stars) <= 7


def test_passage_with_a_phrase_that_comes_again():
    r = np.random.default_rng(7)
    new = lambda n: r.integers(0, 1 << 30, n).astype(np.int32)
    p, q = new(56), new(60)
    for far in (90, 300):
        edited = np.concatenate([p[:25], new(5), p[30:]])
        other = np.concatenate([q[:28], new(5), q[33:]])
        x = np.concatenate([p, new(40), q])
        y = np.concatenate([edited, new(40), other, new(far), p[10:11], new(3), q[3:4]])
        got = substring_dedup.matching(x, y, 46, 0.8)
        assert sorted(g[:4] for g in got) == [(0, 56, 0, 56), (96, 156, 96, 156)]
        assert sorted(g[:2] for g in substring_dedup.matching(y, x, 46, 0.8)) == [(0, 56), (96, 156)]
        assert all(g[4] >= 0.8 for g in got)


def test_windows():
    r = np.random.default_rng(0)
    top = np.uint64(1) << np.uint64(30)
    for values in (r.integers(0, 9, 60), r.permutation(60), np.arange(60)[::-1]):
        valid = np.ones(51, bool)
        valid[[7, 8, 30]] = False
        got = list(zip(*substring_dedup.windows(values.astype(np.uint64) * top, valid, 10), strict=True))
        cover = {i: c for a, c, b in got for i in range(a, b - 8)}
        assert sorted(cover) == np.flatnonzero(valid).tolist()
        for i, c in cover.items():  # every subsequence of that width is in one window, at the first of its minima
            assert c - i == values[i : i + 10].argmin()
    a, c, b = substring_dedup.windows(np.zeros(400, np.uint64), np.ones(355, bool), 46)
    assert len(c) < 50 and a[0] == 0 and b[-1] == 399


def test_shingles():
    import pyarrow as pa

    texts = ["One two three four five six", None, "", "two three four five six seven", "x"]
    s, ends = substring_dedup.Shingles.of(pa.array(texts))
    assert ends.tolist() == [6, 6, 6, 12, 13]
    every = s.shingles(0, s.n)
    assert every[1] == every[6] and len(set(every.tolist())) == len(every) - 1
    assert s.stretch(np.array([1]), 5)[0] == every[1] and s.shingles(3, 3).tolist() == []
    assert substring_dedup.range_minima(np.array([3, 1, 2, 5, 4]), 3).tolist() == [1, 1, 2]


def test_windows_of_two_functions_cross(spark):
    """Texts share a crowded key of one function and a small key of another: neither posting alone shows both votes."""
    rows = [(1, i, 0, 0, 20, 60, 30) for i in range(30)] + [(10 + i // 2, i, 1, 0, 30, 60, 2) for i in range(6)] + [(50, i, 1, 300, 330, 360, 2) for i in (8, 9)]
    found = spark.createDataFrame(rows, "key long, uid long, f int, l int, c int, r int, count long")
    roots = spark.createDataFrame([(0, 0), (1, 0)], "node long, root long")
    got = sorted((x.a, x.b, x.f) for x in substring_dedup.cross_pairs(found, roots, 46, 24, 4).collect())
    assert got == [(2, 3, 0), (2, 3, 1), (4, 5, 0), (4, 5, 1)]


def test_crossed_windows_come_once(spark):
    """Three functions give three pairs of keys; each pair of windows comes once all the same, those of two texts together."""
    rows = [(10 + f, i, f, 0, 20 + 10 * f, 60, 30) for i in range(30) for f in range(3)]
    found = spark.createDataFrame(rows, "key long, uid long, f int, l int, c int, r int, count long")
    roots = spark.createDataFrame([(0, 0), (1, 0)], "node long, root long")
    got = [(x.a, x.b, x.f) for x in substring_dedup.cross_pairs(found, roots, 46, 24, 4).collect()]
    want = [(a, b, f) for a in range(30) for b in range(a + 1, 30) for f in range(3) if (a, b) != (0, 1)]
    assert sorted(got) == want
    assert 1 + sum(x[:2] != y[:2] for x, y in zip(got, got[1:], strict=False)) == len(want) // 3


def test_windows_that_meet_no_other_are_not_written(spark, monkeypatch):
    """Disk goes by what repeats: neither all windows nor a text's stretches for each of its partners are written."""
    r = np.random.default_rng(3)
    say = lambda n: " ".join(f"w{i}" for i in r.integers(0, 1 << 40, n))
    passage, ids = say(60), [-(1 << 63), -5, 0, (1 << 63) - 1]
    rows = [(i, f"{say(400)} {passage} {say(400)}") for i in ids] + [(i, say(300)) for i in range(1, 100)]
    written, whole = {}, substring_dedup.materialize

    def counted(df, label):
        out = whole(df, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(substring_dedup, "materialize", counted)
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {x.doc_id for x in got} == set(ids) and {x.class_id for x in got} == {ids[0]} and len(got) == 12
    assert all(x.start == x.partner_start == 400 and x.end == x.partner_end == 460 for x in got)
    assert max(n for label, n in written.items() if label != "passage-found") == len(rows) and written["passage-found"] < 4 * 60


def test_windows_of_a_text_that_overlap(spark):
    r = np.random.default_rng(4)
    rows = []
    for k in range(600):
        c, left, right = (int(r.integers(0, n)) for n in (900, 46, 46))
        rows.append((k, int(r.integers(0, 3)), int(r.integers(0, 4)), c - left, c, c + right, 7, bool(k % 3), k % 5 == 0 or None))
    df = spark.createDataFrame(rows, "key long, uid long, f int, l int, c int, r int, root long, crowded boolean, crossed boolean")
    got = sorted((x.key1, x.key2) for x in substring_dedup._together(df.repartition(2), 46).collect())
    crossed = {x[0] for x in rows if x[7] and x[8]}
    want = [(x[0], y[0]) for x in rows for y in rows if x[1] == y[1] and x[2] < y[2] and {x[0], y[0]} & crossed and min(x[5], y[5]) - max(x[3], y[3]) + 1 >= 46]
    assert got == sorted(want) and len(want) > 50


def test_many_windows_of_two_texts():
    """A line that both texts repeat: windows put together cover the same stretches as one by one."""
    r = np.random.default_rng(5)
    for _ in range(20):
        n = int(r.integers(65, 300))
        ca, cb = r.integers(60, 400, n), r.integers(60, 400, n)
        cb[: n // 2] = ca[: n // 2] + r.choice([0, 4, -9], n // 2)
        rows = np.stack([r.integers(0, 6, n), *(x + r.integers(0, 60, n) * k for x in (ca, cb) for k in (-1, 0, 1))], axis=1)
        parts = list(substring_dedup.laid_over(rows))
        laid = sorted((a - b, f, a - min(a - la, b - lb), a + min(ra - a, rb - b) + 1) for f, la, a, ra, lb, b, rb in rows.tolist())
        for part in parts:
            own = [x for x in laid if part[0][0] <= x[0] <= part[-1][0]]
            points = lambda some: {(f, i) for _, f, s, e in some for i in range(s, e)}
            assert points(part) == points(own)
            laid = laid[len(own) :]
        assert not laid and all(y[0][0] - x[-1][0] > 6 for x, y in zip(parts, parts[1:], strict=False))
    x = np.array([5, 5, 6, 7, 5, 6, 6])
    assert [substring_dedup.fewest(x, w) for w in (1, 2, 3, 7)] == [1, 1, 2, 3]


def test_tokens_without_collections():
    """Encoding makes a list for each new piece; the collector isn't to look over them, and is as it was afterwards."""
    import gc

    import pyarrow as pa

    enc = token_store.Encoder(token_store.vocabulary())
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(300)) for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(texts)], ["id", "text"])
    said = []
    gc.collect()
    gc.callbacks.append(note := lambda phase, info: said.append(phase))
    try:
        ((_, ids, ends),) = token_store.encoded(enc, iter([batch]))
    finally:
        gc.callbacks.remove(note)
    assert len(said) <= 4 and gc.isenabled()
    want = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()


# --- languages ---------------------------------------------------------------------------------------------------


def slow_forward(word, probs, other):
    alpha = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(j):
            piece = word[i:j]
            alpha[j] += alpha[i] * probs.get(piece, other if j - i == 1 else 0.0)
    return np.log(alpha[-1])


def test_marginals():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "abab"]
    probs = np.random.default_rng(0).dirichlet(np.ones(len(pieces)), 2)
    m = language_id.Model(["x", "y"], pieces, probs)
    words = ["ab", "abab", "a", "", "ba", "zab", "bbbbbb"]
    got = m.log_words(words)
    for g in range(2):
        table = dict(zip(pieces, probs[g], strict=True))
        assert np.allclose(got[:, g], [slow_forward("▁" + w, table, m.other) for w in words])


def test_language(spark):
    kinds = {"aa": ["kala", "kali", "laki", "alak"], "bb": ["mono", "nomo", "omno", "onom"]}
    rows = [(i, prose(i, 30, kinds[k]), k, "odd") for i, k in enumerate(["aa", "bb"] * 30)]
    rows += [(100, None, "aa", "odd"), (101, "123 ...", "bb", "odd"), (102, "", None, "odd"), (103, "kala " * 5000, None, "odd"), (None, "mono nomo", None, "odd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").withColumn("held", language_id.held_out())
    model = language_id.train(docs.where("not held"), per_language=10)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert all(got[i].lang_pred == k and got[i].score > 0.9 for i, _, k, _ in rows[:60])
    assert [got[i].lang_pred for i in (100, 101, 102, 103, None)] == ["und", "und", "und", "aa", "bb"]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in docs.where("doc_id is not null").collect())
    nothing = language_id.train(docs.where("false"))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(docs.where("false"), model).count() == 0
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*range(60), 103, None}


# --- secrets -----------------------------------------------------------------------------------------------------


def test_secrets(spark):
    r = np.random.default_rng(2)
    b64 = secrets.ALPHABETS["base64"]
    keys = ["".join(r.choice(list(b64), 40)) for _ in range(40)]
    texts = [None, "", 'password = "hunter22"', "PassWD:abc", "é token: abcdef=; api_key='Zz_9.x-y'", "secret:token:abcdefgh", "AKIA" + "A1" * 8 + " AKIA123", "f" * 24 + " " + "0" * 23, "word " * 3000 + "secret=" + "q" * 30]
    texts += [prose(i, 40) + " " + k + " " + prose(i + 90, 20) for i, k in enumerate(keys)]
    texts += ["plain " + "mentemente" * 3, "x" * 50, "abc" * 30] + [("internationalisation" * 2 + " ") * 3 for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "odd") for i, t in enumerate(texts)] + [(None, "token=abcdefg", "odd")], "doc_id long, text string, spans string")
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")

    def base(t):
        t = t or ""
        out = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        return [(a, secrets.KINDS[k], b) for a, k, b in sorted(out)]

    got = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    for i, t in enumerate(texts):
        assert [tuple(s) for s in got[i].base] == base(t)
        assert {tuple(s) for s in got[i].base} <= {tuple(s) for s in got[i].spans}
    added = {i for i in got if any(s.kind == "random" for s in got[i].spans)}
    assert len(added & set(range(9, 49))) >= 34 and not added - set(range(9, 49))
    assert secrets.find_secrets(docs.where("false")).count() == 0
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(docs).collect()}
    assert masked[2] == "[secret]\"" and masked[0] is None
