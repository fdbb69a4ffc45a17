"""Driver contract: entry smoke, query/oracle keys, and Spark vs DuckDB at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001
from tools.check_oracle import TABLES, _hash, _norm


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["product", "zone", "pincode", "finalPrice", "quantity"]
    assert df.count() > 0


OWN = {f.__name__ for f in E._QUERIES}


def test_every_query_has_an_oracle():
    assert OWN == set(E._SQL)
    assert OWN <= set(E.queries())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


DUCK_TYPES = {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double"}


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF001)
    rel = duck.sql(E.oracle_sql()[name])
    assert dict(df.dtypes) == {c: DUCK_TYPES.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    got = _norm(df.toPandas())
    want = _norm(duck.execute(E.oracle_sql()[name]).fetchdf())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert _hash(got) == _hash(want)
