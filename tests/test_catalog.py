"""Every registered query of the market part against its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from quantloom.plans import ORACLES, QUERIES

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name, tmp_path):
    out = str(tmp_path / "out")
    QUERIES[name](spark, str(SF)).write.parquet(out)
    con.execute(f"create or replace table o as {ORACLES[name]}")
    con.execute(f"create or replace table s as select * from '{out}/*.parquet'")
    cols = ", ".join(sorted(f'"{c[0]}"' for c in con.execute("describe o").fetchall()))
    assert sorted(c[:2] for c in con.execute("describe s").fetchall()) == sorted(c[:2] for c in con.execute("describe o").fetchall())
    for a, b in (("s", "o"), ("o", "s")):
        assert con.execute(f"select {cols} from {a} except all select {cols} from {b} limit 3").fetchall() == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(SF)).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
