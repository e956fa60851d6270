"""Every registered query against its SQL on the smallest tables, and what must hold of the registry."""

import math
import os
import pathlib
import subprocess
import sys

import duckdb
import pytest

from passplane import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
ROOT = pathlib.Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in pathlib.Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def shown(v):
    return "null" if v is None or isinstance(v, float) and math.isnan(v) else repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(shown(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() > 0 and "score" in df.columns and df.where("score is null or score < 0 or score > 1").count() == 0


def test_no_query_is_lost_between_modules():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 70


def test_the_rest_works_without_the_llm_folders(tmp_path):
    """The entry imports when the subpackage and the pipeline are gone."""
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    (tmp_path / "passplane").mkdir()
    for p in (ROOT / "passplane").iterdir():
        if p.name != "llm":
            (tmp_path / "passplane" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 70 and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})

