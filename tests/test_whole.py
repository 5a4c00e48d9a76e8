"""Queries over whole tables, on small tables."""

from folioscope import queries as core


def rows(spark, path, name, data, schema, query):
    spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")
    return sorted(tuple(r) for r in core.QUERIES[query](spark, str(path)).collect())


def test_splice_past_the_first_ids(spark, tmp_path):
    data = [(7, "he mended it"), (200, "ended, ended "), (5000, "ed ed no")]
    got = rows(spark, tmp_path, "documents", data, "doc_id long, text string", "edit_plan_splice")
    assert got == sorted((i, -s.count("e"), s.replace("ed ", "ing ")) for i, s in data)


def test_ledger_of_all_users(spark, tmp_path):
    data = [(3, "click", 1.5), (4, "click", 2.0), (15, "view", 1.0), (13, "view", None), (20, "signup", 0.25)]
    got = rows(spark, tmp_path, "events", data, "user_id long, event_type string, value double", "ledger_totals")
    assert got == [("click", 3.5, 2), ("signup", 0.25, 1), ("view", None, 2)]  # a type with an open cost has no total


def test_neighbours_past_the_first_keys(spark, tmp_path):
    data = [(1, "PROMO A"), (2, "PROMO A"), (500, "plated"), (501, "plates"), (502, "brushed"), (9000, "tin"), (9001, "tin")]
    got = rows(spark, tmp_path, "part", data, "p_partkey long, p_type string", "stem_pairs")
    assert got == [(1, True), (500, True), (501, False), (9000, True)]


def test_every_event_is_checked(spark, tmp_path):
    data = [(1, 1, "view", 1.0), (7, 2, "view", None), (3, 3, "view", 1.0), (9, 3, "click", 1.0)]
    got = rows(spark, tmp_path, "events", data, "event_id long, user_id long, event_type string, value double", "acceptance_checks")
    assert got == [(2, "unverified"), (3, "duplicate")]


def test_ordinals_of_every_match(spark, tmp_path):
    data = [(1, "the"), (2, "no"), (3, "x" * 300 + "the\n" + "y" * 300 + "thethe\n\nother \U0001f600 the")]
    got = rows(spark, tmp_path, "documents", data, "doc_id long, text string", "occurrence_ordinals")
    want = []
    for i, s in data:
        starts = [k for k in range(len(s)) if s.startswith("the", k)]
        want += [(i, k, n, 1 + s[:k].count("\n")) for n, k in enumerate(starts)]
    assert got == want
