"""The queries that SQL can express, against it, on the smallest driver tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from rowloom.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages".split()
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no driver tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(columns).collect()]
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        found = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, rows)) == sorted(map(repr, found))


def test_every_number_has_one_query():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()
