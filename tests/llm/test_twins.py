"""The registered queries against their SQL twins on the smallest tables."""

from pathlib import Path

import pytest

from lodestar.llm import registry

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_twins_agree(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(registry.ORACLE[name])
    columns = [c[0] for c in want.description]
    df = registry.QUERIES[name](spark, str(DATA))
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_every_operator_is_registered():
    assert [n for n in registry.QUERIES if n.startswith("op")] == sorted((n for n in registry.QUERIES if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert len(registry.QUERIES) == 14
