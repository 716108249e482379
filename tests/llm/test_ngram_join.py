import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from cloakframe.llm import ngram_join as nj

LOWER = {i: i + 32 for i in range(65, 91)}


def gram_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """(doc_id, text) -> sorted (doc_id, size, component)."""
    sets, up = [gram_set(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def family(rng, n, size, steps):
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(3000)]
    text = list(rng.choice(vocabulary, size))
    out = []
    for _ in range(n):
        t = list(text)
        for _ in range(rng.integers(0, steps)):
            t[rng.integers(len(t))] = rng.choice(vocabulary)
        out.append(" ".join(t))
    return out


@given(st.lists(st.text(alphabet="aAbÄé \t\n\x0b\x1c c", max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_shingles_against_sets(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    h, at = nj.shingles(data, offsets)
    seen = {}
    for i, t in enumerate(texts):
        own = set(h[at[i] : at[i + 1]].tolist())
        want = gram_set(t)
        assert len(own) == len(want)
        assert seen.setdefault(frozenset(want), own) == own


@pytest.mark.parametrize(("small", "leaders", "block", "hot", "part", "bits"), [(8, 8, 512, 72, 4096, 1 << 26), (2, 1, 3, 72, 6, 1), (2, 1, 3, 1, 6, 1 << 26)])
def test_components_against_brute_force(spark, monkeypatch, small, leaders, block, hot, part, bits):
    monkeypatch.setattr(nj, "HOT_LEVEL", hot)
    monkeypatch.setattr(nj, "PART", part)
    monkeypatch.setattr(nj, "MOST_BITS", bits)
    monkeypatch.setattr(nj, "SMALL", small)
    monkeypatch.setattr(nj, "LEADERS", leaders)
    monkeypatch.setattr(nj, "BLOCK", block)
    monkeypatch.setattr(nj, "GUESTS", 5)
    rng = np.random.default_rng(small)
    texts = [None, "", "  \n", "one", "one", "ONE\ttwo three four", "one two three four", *family(rng, 40, 120, 8), *family(rng, 25, 300, 14), *family(rng, 6, 40, 3), *family(rng, 30, 60, 1), *family(rng, 1, 3000, 1)]
    line = "this very line stands in every one of these texts and is not what they are"
    texts += [line + " " + t for t in family(rng, 30, 25, 30)]
    rows = [(None if i in (9, 10) else i // 2 if i > 150 else i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, node="clash", host=1, did="x") for i, t in rows]).repartition(4)
    got = sorted(map(tuple, nj.document_components(docs).collect()), key=str)
    assert got == brute(rows)
    groups = [r for r in got if r[1] > 20]
    assert len({r[2] for r in groups}) < len(groups)


def test_representatives(spark):
    rng = np.random.default_rng(5)
    rows = [(i, t) for i, t in enumerate([*family(rng, 10, 200, 4), "alone here", None, ""])]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, did="clash") for i, t in rows])
    out = nj.representatives(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {c for _, _, c in brute(rows)}


def test_representatives_decide_by_row(spark):
    """Null and repeated ids: one row of each component stays, and no row goes for the id it shares."""
    rng = np.random.default_rng(6)
    near, nulls, shared = family(rng, 4, 200, 4), family(rng, 5, 200, 4), family(rng, 3, 200, 4)
    clean = [f"{w} is an unrelated text of its own kind number {w}" for w in ("alpha", "beta", "gamma", "delta")]
    rows = [(7, near[0]), (None, near[1]), (8, near[2]), (7, near[3]), *((None, t) for t in nulls), (20, shared[0]), (21, shared[1]), (21, clean[0])]
    rows += [(None, clean[1]), (None, clean[2]), (None, clean[2]), (None, clean[2].upper()), (30, clean[3]), (30, clean[3]), (None, None), (None, ""), (None, "")]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, extra={"n": k}) for k, (i, t) in enumerate(rows)], "doc_id long, text string, extra map<string,int>").repartition(3)
    sets = [gram_set(t) for _, t in rows]
    up = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    up[i] = up[j] = min(up[i], up[j])
    out = nj.representatives(docs)
    assert out.columns == docs.columns
    got = [r.extra["n"] for r in out.collect()]
    assert sorted(up[k] for k in got) == sorted(set(up))
    for k in got:
        ids = [rows[i][0] for i in range(len(rows)) if up[i] == up[k] and rows[i][0] is not None]
        assert rows[k][0] == (min(ids) if ids else None)


def test_filters_lose_nothing():
    rng = np.random.default_rng(0)
    for _ in range(300):
        universe = np.sort(rng.choice(1000, 60, replace=False)).astype(np.uint64)
        x, y = (np.sort(rng.choice(universe, rng.integers(1, 60), replace=False)) for _ in range(2))
        assert nj.suffix_filter(x, y, 10**6) <= len(np.setxor1d(x, y))


def test_empty_table(spark):
    assert nj.document_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_of_a_bucket_are_spread(spark):
    """Equal texts, null ids and equal set sizes don't meet in one bucket."""
    docs = spark.createDataFrame([(None, "one and the same text of eight words")] * 4000, "doc_id long, text string").repartition(4)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    made = rows.mapInArrow(nj._prefixes(50, np.zeros(nj.CELLS, np.uint8), 5, 80), nj.ROUTED).where("kind = 1")
    most = made.groupBy("bucket").count().agg(F.max("count"), F.count("*")).first()
    assert most[0] < 160 and most[1] == 50
