"""The stand-in tables built with the DataFrame API equal their SQL text in DuckDB."""

import duckdb
import pytest

from conftest import SF001
from pinprice.sources.fixtures import BUILDERS, fixture_cte, fixture_tables
from tools.check_oracle import TABLES, _hash, _norm


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(BUILDERS))
def test_stand_in_table_matches_sql(spark, duck, name):
    got = _norm(fixture_tables(spark, SF001)[name].toPandas())
    want = _norm(duck.execute(fixture_cte() + f"SELECT * FROM {name}").fetchdf())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want) > 0
    assert _hash(got) == _hash(want)
