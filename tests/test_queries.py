"""Each query of the engine against its SQL, on the smallest driver tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from rowloom.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        yield con


def canonical(rows):
    return sorted(repr([float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    if name == "interleaved":
        pytest.skip("the smallest table has too few conversations for five batches")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(columns).collect()]
    assert rows
    if name in SQL:
        found = duck.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
        assert canonical(rows) == canonical(found)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["_pos", "_exec_pos"] and __spark_entry__.entry(spark).count() == 1500
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
