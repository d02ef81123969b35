"""Every query against its SQL on the smallest tables."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from voxmill.plans import more as plans

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(round(x, 5) if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    assert plain(plans.QUERIES[name](spark, str(SF)).toPandas()) == plain(db.sql(plans.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["q05_upscale", "w05_upscale"])
def test_fields_are_not_broadcast(spark, name):
    got = plans.QUERIES[name](spark, str(SF))
    assert got.collect()
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()  # as it ran: only single rows are broadcast


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_the_llm_folders(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in ("corpus_pipeline.py", ".git", "tests"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "voxmill").unlink()
    (tmp_path / "voxmill").mkdir()
    for p in (ROOT / "voxmill").iterdir():
        if p.name != "llm":
            (tmp_path / "voxmill" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q01_voxelize' in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
