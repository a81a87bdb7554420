"""Every registered core query against its SQL on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

from circlet.plans import catalog, more  # noqa: F401  (more registers its queries with the catalog)
from circlet.plans.adapters import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame):
    return sorted(str([None if x is pd.NA or x != x else int(x) if isinstance(x, float) and x == int(x) else x for x in r]) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))  # the others are in test_plain.py
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry():
    import __spark_entry__

    assert catalog.FLAGSHIP in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
