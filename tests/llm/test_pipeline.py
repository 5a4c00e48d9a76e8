"""The pipeline's stages over a small folder of tables, against what each has to do."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    kinds = {"aa": ["kala", "kali", "laki", "alak", "kaal", "ilka"], "bb": ["mono", "nomo", "omno", "onom", "moon", "nono"]}
    say = lambda seed, n, k: " ".join(np.random.default_rng(seed).choice(kinds[k], n))
    item = say(999, 40, "aa")
    rows = [(i, say(i, 60, k), k, f"s{i % 2}") for i, k in enumerate(["aa", "bb"] * 25)]
    rows += [(60, rows[0][1], "aa", "s0"), (61, "12 34 ..", "aa", "s0"), (62, None, "aa", "s1"), (63, say(63, 20, "aa") + " " + item, "aa", "s1")]
    spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids, steps = docs.columns, {}, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        steps.append(name)
    assert set(range(50)) | {60, 63} == set(ids["language_id"])
    assert {0, 63} <= set(ids["simhash_near_dedup"]) and 60 not in ids["simhash_near_dedup"]
    assert 63 not in ids["benchmark_decontamination"] and set(ids["benchmark_decontamination"]) == set(ids["simhash_near_dedup"]) - {63}
    assert set(ids["mixing"]) <= set(ids["benchmark_decontamination"])
    assert sorted(ids["token_output"]) == sorted(ids["mixing"])
    got = docs.orderBy("start").collect()
    assert got[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    assert len(ids["language_id"]) == 52 and len(ids["simhash_near_dedup"]) == len(set(ids["simhash_near_dedup"]))
    size = lambda df, s: sum(len(r.text.split()) for r in df.where(f"source = '{s}'").collect())
    before, mixed = (spark.read.parquet(str(tmp_path / n)) for n in ("benchmark_decontamination", "mixing"))
    one, two = size(before, "s0"), size(before, "s1")
    for s, want in (("s0", (one + two) / 3), ("s1", (one + two) * 2 / 3)):
        assert abs(size(mixed, s) - min(want, 3 * size(before, s))) <= 100


def test_run(spark, folder):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) for _ in range(2))
    assert a == b and len(a) > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_texts_go_to_python_a_few_at_a_time(spark, folder):
    """A batch of the engine's default size would be held whole by each task; a smaller setting is left as it is."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    rows = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 50").repartition(1)
    docs = rows.crossJoin(spark.range(40)).drop("id")  # 2,000 rows in one task
    try:
        for own, want in (("10000", "512"), ("0", "512"), ("100", "100")):
            spark.conf.set(name, own)
            kept = corpus_pipeline.language(spark, docs, folder)
            assert spark.conf.get(name) == want and kept.count() == 2000
            sizes = kept.select("text").mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [len(b)]}) for b in bs), "n long").collect()
            assert 0 < max(r.n for r in sizes) <= int(want) and sum(r.n for r in sizes) == 2000
    finally:
        spark.conf.set(name, before)
