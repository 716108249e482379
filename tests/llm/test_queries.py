import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.llm.queries import QUERIES, SQL

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, name):
    tables = duckdb.connect()
    for file in os.listdir(SF):
        tables.sql(f"create view {file.split('.')[0]} as select * from '{SF}/{file}'")
    got, want = QUERIES[name](spark, SF), tables.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    plain = lambda x: round(x, 6) if isinstance(x, float) else str(x)
    assert sorted([tuple(map(plain, r)) for r in got.collect()], key=repr) == sorted([tuple(plain(r[k]) for k in at) for r in want.fetchall()], key=repr)


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="needs the test tables")
def test_recall_on_the_embeddings(spark):
    """Against brute force over all vectors: at least 0.9 of the ten nearest, and every score exact."""
    rows = spark.read.parquet(f"{LARGER}/embeddings.parquet").where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).collect()
    rows = [(r.vec_id, np.array(r.v, float)) for r in rows if all(x is not None and np.isfinite(x) for x in r.v) and any(r.v)]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    got: dict[int, dict[int, float]] = {}
    for r in QUERIES["op9_nearest"](spark, LARGER).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = wanted = 0
    for i, v in rows:
        if i % 100 == 0:
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
            best = [j for j in np.lexsort((ids, d)) if ids[j] != i][:10]
            wanted += len(best)
            hits += len({int(ids[j]) for j in best} & got[i].keys())
            assert all(s == pytest.approx(float(d[np.flatnonzero(ids == o)[0]]), rel=1e-12) for o, s in got[i].items())
    print("recall", hits / wanted, "of", len(rows), "vectors")
    assert hits >= 0.9 * wanted
