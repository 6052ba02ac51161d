"""Every registered network query against its SQL, and the contract's shape."""

from pathlib import Path

import duckdb
import pytest

from fluxloom.plans import catalog

CHEAP = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_its_sql(spark, db, sf_dir, name):
    got, want = catalog.queries()[name](spark, sf_dir).toPandas(), db.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (d[columns].sort_values(columns).reset_index(drop=True) for d in (got, want))
    assert len(a) == len(b)
    for c in columns:
        assert a[c].dtype == b[c].dtype or not len(a), c
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_imports_without_the_training_data_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "fluxloom", tmp_path / "fluxloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(root / "jobs", tmp_path / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert {'flux', 'job1_firing_ledger'} <= set(e.queries()) and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
