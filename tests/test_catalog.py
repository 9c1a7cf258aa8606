"""Every registered query of the matcher against DuckDB."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from ontoloom.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        p = f"{sf}/{f}"
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def _key(row):
    return repr([round(v, 9) if isinstance(v, float) else v for v in row])


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    want = duck.sql(ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(_key([r[c] for c in cols]) for r in got.collect()) == sorted(_key([r[i] for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"ensemble_sweep", "mlp", "link_prediction"}))
def test_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).limit(5).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("gone", [["ontoloom/llm", "tests/llm"], ["ontoloom/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_the_optional_parts(tmp_path, gone):
    """A copy of the repository without them still registers all queries of the matcher."""
    top = Path(__file__).resolve().parents[1]
    copy = tmp_path / "copy"
    shutil.copytree(top, copy, ignore=lambda folder, names: [n for n in names if n in (".git", "__pycache__") or str((Path(folder) / n).relative_to(top)) in gone])
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.stdout.split() == [str(len(QUERIES)), "False"]
