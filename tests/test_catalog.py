"""Every query against its SQL twin on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from lodestar.plans import catalog

DATA = Path("/root/testdata/sf0.001")


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    # recall is no matter of equality; test_vectors holds it
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == {"vector_search"}


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_twins_agree(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(catalog.ORACLE[name])
    columns = [c[0] for c in want.description]
    df = catalog.QUERIES[name](spark, str(DATA))
    assert sorted(columns) == sorted(df.columns)
    clean = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(map(repr, map(clean, df.select(*columns).collect()))) == sorted(map(repr, map(clean, want.fetchall())))


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_executors_need_no_copy_of_the_repository(tmp_path):
    """Queries that run Python on executors, from a folder and with a path from which workers cannot import this package."""
    import os
    import subprocess
    import sys

    root = str(Path(__file__).resolve().parents[1])
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", {str(tmp_path / "ck")!r}).getOrCreate()
assert not s.range(1).rdd.map(lambda r: __import__("importlib.util").util.find_spec("lodestar") is not None).first()
from lodestar.plans import catalog
for name in ("xlang_detect", "dockerfile_parse", "shell_parse", "powershell_parse", "msbuild_parse", "dotnet_tools_parse", "workflow_parse", "xmldoc_parse", "vector_search"):
    assert catalog.QUERIES[name](s, {str(DATA)!r}).count() > 0, name
print("all")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "all" in done.stdout, done.stderr[-3000:]
