"""All registered queries of the library against their DuckDB oracles on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from oracle_check import TABLES, rows_of  # noqa: E402
from tradelens.registry import queries as _library  # noqa: E402

SF = "/root/testdata/sf0.001"
LIBRARY = set(_library())
SELECTED = sorted(k for k in oracle_sql() if k in LIBRARY)

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = Path(SF) / f"{t}.parquet"
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_library_query_has_an_oracle():
    from tradelens.registry import queries as library_queries

    assert set(library_queries()) <= set(oracle_sql())


@pytest.mark.parametrize("name", SELECTED)
def test_query_matches_oracle(spark, duck, name):
    df = queries()[name](spark, SF)
    rel = duck.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(
        rel.columns, rel.fetchall()
    )


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() >= 0
    assert "seller_id" in df.columns
