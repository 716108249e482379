import os
from collections import Counter

import duckdb
import pytest

from cloakframe.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def counted(frame, columns):
    return Counter(tuple(str(float(x)) if isinstance(x, float) else str(x) for x in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, tables, name):
    got, want = QUERIES[name](spark, SF).toPandas(), tables.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert counted(got, sorted(got.columns)) == counted(want, sorted(got.columns))
