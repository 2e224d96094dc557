"""Every query with SQL gives the rows that DuckDB gives; the others give rows."""

import os
import re

import duckdb
import pytest

from sentograph.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def comparable(rows):
    return sorted(tuple((x is None, str(float(x)) if isinstance(x, float) else str(x)) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, oracle, name):
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    # A window without a partition would hold all rows in one task.
    for first in re.findall(r"windowspecdefinition\(([^,]*)", df._jdf.queryExecution().optimizedPlan().toString()):
        assert not re.search(" (ASC|DESC) NULLS|^specifiedwindowframe", first), first
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in catalog.ORACLES:
        assert got
        return
    found = oracle.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert comparable(got) == comparable([tuple(r[k] for k in at) for r in found.fetchall()])


def test_entry_imports_without_the_subpackage(tmp_path):
    """The entry works in a copy without the llm folder and the pipeline."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/sentograph", tmp_path / "sentograph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), sorted(set(e.oracle_sql()) - set(e.queries())))"], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split(maxsplit=1)[1].strip() == "[]"
