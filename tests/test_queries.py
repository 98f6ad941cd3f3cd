"""Every registered query against its SQL, or its columns where SQL has none."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest
from jobs import queries as jobs
from labelscope import plans

QUERIES, ORACLE = plans.QUERIES | jobs.QUERIES, plans.ORACLE | jobs.ORACLE

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, (float, np.floating)) and np.isnan(v)):
            return "NULL"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float, np.integer, np.floating)) else str(v)

    return sorted(map(tuple, frame[sorted(frame.columns)].map(one).values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, small, duck, name):
    got, want = QUERIES[name](spark, small).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"oof_predictions"}))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


@pytest.mark.parametrize("kept", [False, True])
def test_queries_do_not_need_the_llm_subpackage(tmp_path, kept):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "labelscope", tmp_path / "labelscope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(root / "jobs", tmp_path / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if kept and (root / "corpus_pipeline.py").exists():  # its own imports fail without the subpackage
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'window_grid' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, check=False).returncode == 0


def test_modules_are_sent_to_other_machines():
    import zipfile

    import __spark_entry__ as entry

    names = zipfile.ZipFile(entry._archive()).namelist()
    assert "labelscope/__init__.py" in names and "labelscope/plans/registry.py" in names and not any(n.startswith("/") for n in names)
