import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cloakframe.llm import vectors


def brute(rows, is_query, k=10):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 16]
    ids, x = np.array([i for i, _ in ok]), np.stack([v for _, v in ok])
    out = {}
    for i, v in ok:
        if is_query(i):
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def rows_of(seed, n, hot):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16)).astype(np.float32)
    x[rng.permutation(n)[:hot]] = x[0]
    return [(i, v) for i, v in enumerate(x.tolist())]


def ask(spark, rows, monkeypatch=None):
    docs = spark.createDataFrame([Row(vec_id=i, embedding=v, label=0, uid="clash", list=1) for i, v in rows], "vec_id long, embedding array<float>, label int, uid string, list int").repartition(6)
    got = {}
    for r in vectors.nearest_neighbours(docs, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 100)
    rows = rows_of(0, 4000, 1300)
    got, want = ask(spark, rows), brute(rows, lambda i: i % 20 == 0)
    assert got.keys() == want.keys()
    hits = 0
    for q in want:
        assert len(got[q]) == 10 and [s for _, s in got[q]] == sorted(s for _, s in got[q])
        truth = dict(rows)
        for v, s in got[q]:
            assert s == pytest.approx(np.linalg.norm(np.float64(np.float32(truth[v])) - np.float64(np.float32(truth[q]))), abs=1e-12)
        hits += len({v for v, _ in got[q]} & {v for v, _ in want[q]})
    assert hits >= 0.9 * 10 * len(want)
    hot = [q for q in want if want[q][9][1] == 0]
    assert hot and all(got[q] == want[q] for q in hot)


def test_odd_rows(spark):
    good = rows_of(1, 6, 0)
    bad = [(20, None), (40, [0.0] * 16), (60, [float("nan")] + [1.0] * 15), (80, [float("inf")] * 16), (100, [None] + [1.0] * 15), (120, [1.0] * 3), (None, [2.0] * 16), (140, [])]
    twins = [(160, good[2][1]), (160, good[2][1]), (7, good[2][1])]
    rows = good + bad + twins
    got, want = ask(spark, rows), brute(good + twins[1:], lambda i: i % 20 == 0)
    assert {q: [v for v, _ in x] for q, x in got.items()} == {q: [v for v, _ in x] for q, x in want.items()}
    assert ask(spark, []) == {} and ask(spark, bad[:1]) == {}


def test_doubles_stay_doubles(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=8)
    rows = [(i, (base + (i * 1e-12 if i < 30 else rng.normal(size=8))).tolist()) for i in range(200)]
    docs = spark.createDataFrame([Row(vec_id=i, embedding=v) for i, v in rows], "vec_id long, embedding array<double>")
    for how in ({}, {"exact": True}):
        got = vectors.nearest_neighbours(docs, F.col("vec_id") == 0, **how).orderBy("rank").collect()
        assert [r.vec_id for r in got] == list(range(1, 11))
        assert [r.score for r in got] == [pytest.approx(np.linalg.norm(np.array(rows[i][1]) - np.array(rows[0][1])), rel=1e-12) for i in range(1, 11)]


def test_a_query_id_with_several_vectors(spark):
    rows = rows_of(7, 50, 0)
    twice = [(0, rows[9][1]), *rows]
    want = min((np.array(v, "<f4").tobytes(), v) for i, v in twice if i == 0)[1]
    for part in (twice, twice[::-1]):
        got = ask(spark, part)[0]
        x = {i: np.float64(np.float32(v)) for i, v in rows if i}
        assert [v for v, _ in got] == sorted(x, key=lambda i: (np.linalg.norm(x[i] - np.float64(np.float32(want))), i))[:10]


def test_exact_is_brute_force(spark):
    rows = rows_of(8, 600, 40)
    docs = spark.createDataFrame([Row(vec_id=i, embedding=v) for i, v in rows], "vec_id long, embedding array<float>")
    got = {}
    for r in vectors.nearest_neighbours(docs, F.col("vec_id") % 20 == 0, exact=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [v for v, _ in x] for q, x in brute(rows, lambda i: i % 20 == 0).items()}
