import duckdb
import pytest

import __spark_entry__ as entry
from strata import catalog

SF = "/root/testdata/sf0.001"


def rows(frame, columns):
    return sorted(tuple("" if x is None else str(x) for x in r) for r in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    found, expected = catalog.QUERIES[name](spark, SF).toPandas(), db.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    columns = sorted(found.columns)
    assert rows(found, columns) == rows(expected, columns)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() == 12
    assert set(entry.oracle_sql()) <= set(entry.queries())
