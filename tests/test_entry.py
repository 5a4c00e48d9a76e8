"""The driver's contract: queries against their SQL, and imports without the optional parts."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from folioscope import queries as core

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def same(spark, sql, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str)
    q = sql.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in q.description]
    assert sorted(names) == columns
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in q.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query(spark, sql, name):
    same(spark, sql, name)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_without_the_optional_parts(tmp_path):
    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; n = list(e.queries()); assert n and not [x for x in n if x[:2] == 'op' and x[2].isdigit() or x == 'pipeline'], n; assert set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")})
