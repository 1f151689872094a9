"""Every registered query runs; those with SQL give its rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from wavetable.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(table):
    shown = lambda v: "None" if v is None or v != v else repr(round(v, 9)) if isinstance(v, float) else repr(v)
    return sorted(tuple(map(shown, r)) for r in zip(*[table.column(c).to_pylist() for c in sorted(table.column_names)]))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toArrow(), duck.execute(ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
