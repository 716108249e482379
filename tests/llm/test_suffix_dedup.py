import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from cloakframe.llm import suffix_dedup as sd


def brute(rows):
    """(doc_id, text) in order -> covered flags of each."""
    seen, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        out.append(gone)
    return out


def passages(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 9))) for _ in range(vocabulary)]
    say = lambda k: " ".join(rng.choice(words, k))
    shared = [say(rng.integers(5, 60)) for _ in range(6)]
    texts = []
    for i in range(n):
        kind = i % 7
        if kind == 0 and texts:
            texts.append(texts[rng.integers(len(texts))])
        elif kind == 1 and texts:
            t = (texts[rng.integers(len(texts))] or "").split(" ")
            for _ in range(rng.integers(1, 5)):
                t[rng.integers(len(t))] = say(1)
            texts.append(" ".join(t))
        elif kind == 2:
            texts.append(say(20) + " " + shared[rng.integers(6)] + " " + say(30) + shared[rng.integers(6)])
        elif kind == 3:
            texts.append("ab" * int(rng.integers(0, 200)) + shared[0] + "x" * int(rng.integers(0, 300)))
        else:
            texts.append(say(rng.integers(1, 150)))
    return texts


def check(got, rows):
    want = sorted((i, len((t or "").encode()), int(g.sum()), int((np.diff(g.astype(int), prepend=0) == 1).sum()), hashlib.sha256(bytes(np.frombuffer((t or "").encode(), np.uint8)[~g])).hexdigest()) for (i, t), g in zip(rows, brute(rows), strict=True))
    assert sorted(map(tuple, got)) == want


def test_operator_against_brute_force(spark):
    texts = [None, "", *passages(0, 160), "a" * 3000, "a" * 100, "a" * 99]
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, tie=1, did="clash", spans=0, row="") for i, t in reversed(rows)]).repartition(5)
    check(sd.removal_report(docs).collect(), rows)
    out = {r.doc_id: r for r in sd.deduplicated(docs).collect()}
    assert len(out) == len(rows) and sd.deduplicated(docs).columns == docs.columns
    for (i, t), g in zip(rows, brute(rows), strict=True):
        if t is not None and t.isascii():
            assert out[i].text.encode() == bytes(np.frombuffer(t.encode(), np.uint8)[~g])
        assert (out[i].text is None) == (t is None)


def test_crowded_anchors(spark, monkeypatch):
    monkeypatch.setattr(sd, "CROWDED", 1)
    monkeypatch.setattr(sd, "UNIT", 3000)
    rows = list(enumerate(passages(3, 90)))
    docs = spark.createDataFrame([Row(doc_id=i, text=t) for i, t in rows])
    check(sd.removal_report(docs).collect(), rows)


@given(st.integers(0, 10_000), st.integers(1, 6))
@settings(max_examples=25, deadline=None)
def test_merged_transforms_against_brute_force(seed, n_shards):
    rng = np.random.default_rng(seed)
    base = rng.integers(97, 99, 260).astype(np.uint8)
    texts = []
    for _ in range(rng.integers(1, 12)):
        t = base[rng.integers(0, 60) :][: rng.integers(100, 180)].copy()
        if rng.random() < 0.5:
            t[rng.integers(len(t))] = 65
        texts.append(t)
    cnt = np.array([len(t) - 99 for t in texts])
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[:-1]
    rank = rng.permutation(len(texts))
    shard = rng.integers(0, n_shards, len(texts)).astype(np.int32)
    text, window = sd.repeated_windows(np.concatenate(texts), starts, cnt, rank, shard)
    least = {}
    for t, r in zip(texts, rank, strict=True):
        for p in range(len(t) - 99):
            w = t[p : p + 100].tobytes()
            least[w] = min(least.get(w, 99), r)
    want = {(i, p) for i, t in enumerate(texts) for p in range(len(t) - 99) if least[t[p : p + 100].tobytes()] < rank[i]}
    assert set(zip(text.tolist(), window.tolist(), strict=True)) == want


def test_merging_sorts_by_common_prefixes():
    rng = np.random.default_rng(1)
    symbol, before = rng.integers(0, 3, 400).astype(np.int32), np.arange(400) - 1
    ends = np.arange(19, 400, 20)
    symbol[ends], before[ends + 1 - 20] = -1, -1
    positions = np.arange(400)
    shard = np.repeat(np.array([0, 1, 2], np.int32), [140, 160, 100])
    merged, common = sd.merge(sd.Transforms(positions, shard, symbol, before, 5))
    key = lambda p: tuple(symbol[p : p + 5].tolist()[: (symbol[p : p + 5].tolist() + [-1]).index(-1)])
    keys = [key(p) for p in merged.tolist()]
    assert sorted(merged.tolist()) == list(range(400)) and [k for k in keys if len(k) == 5] == sorted(k for k in keys if len(k) == 5)
    for a, b, c in zip(keys, keys[1:], common[1:].tolist(), strict=False):
        if len(a) == len(b) == 5:
            assert c == next((i for i in range(5) if a[i] != b[i]), 5)


@given(st.integers(0, 10_000), st.integers(1, 7))
@settings(max_examples=60, deadline=None)
def test_merged_blocks_against_sorting(seed, n_shards):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 60))
    key, content = (rng.integers(0, 6, n).astype(np.uint64) * np.uint64(3) for _ in range(2))
    order, anchor, whole = sd.merged_blocks(key, content, rng.integers(0, n_shards, n).astype(np.int32))
    pairs = list(zip(key[order].tolist(), content[order].tolist(), strict=True))
    assert sorted(order.tolist()) == list(range(n)) and pairs == sorted(pairs)
    for same, cut in ((anchor, 1), (whole, 2)):
        assert [a == b for a, b in zip(same, same[1:], strict=False)] == [a[:cut] == b[:cut] for a, b in zip(pairs, pairs[1:], strict=False)]


def test_repeats_between_shards_of_different_tasks(spark):
    """Every row in a task of its own: all repeats are found by the merge."""
    rows = [(i, "x" * 20 + t) for i, t in enumerate(passages(5, 24))]
    docs = spark.createDataFrame([Row(doc_id=i, text=t) for i, t in rows]).repartition(24, "doc_id")
    check(sd.removal_report(docs).collect(), rows)


@pytest.mark.parametrize("rows", [[], [(None, None)], [(None, "z" * 150), (None, "z" * 150), (1, "z" * 120)]])
def test_ties_and_empty(spark, rows):
    docs = spark.createDataFrame([Row(doc_id=i, text=t) for i, t in rows], "doc_id long, text string")
    got = sd.removal_report(docs).collect()
    assert len(got) == len(rows)
    if len(rows) == 3:  # the row with an id comes first, then the repeated document, whose rows get one result
        assert sorted((r.doc_id is None, r.n_removed) for r in got) == [(False, 119), (True, 150), (True, 150)]
