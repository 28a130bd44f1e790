"""The driver's entry points, with and without the optional subpackage; catalog queries against DuckDB."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

TOP = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def rows(df):
    return sorted(tuple(str(v) for _, v in sorted(r.items())) for r in df)


def catalog():
    from millrace.plans.catalog import QUERIES

    return sorted(QUERIES)


@pytest.mark.parametrize("name", catalog())
def test_catalog_equals_sql(spark, name):
    import duckdb

    from millrace.plans.catalog import QUERIES, SQL

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    got = [r.asDict() for r in QUERIES[name](spark, DATA).collect()]
    want = con.sql(SQL[name])
    assert rows(got) == rows([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()])


def test_works_without_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(TOP, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".*"))
    shutil.rmtree(copy / "millrace" / "llm", ignore_errors=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'top_month' in q and not [k for k in q if k.startswith('op')]; assert set(s) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)


def test_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
