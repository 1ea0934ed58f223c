import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import queries as core
from tessera.testing import plain

D = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(core.queries()))
def test_query_equals_sql(spark, name):
    df = core.queries()[name](spark, D)
    names = sorted(df.columns)
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        p = f"{D}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    want = c.sql(f"SELECT {', '.join(names)} FROM ({core.oracle_sql()[name]})").fetchall()
    assert plain(df.select(*names).collect()) == plain(want)
