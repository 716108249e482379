import re
from collections import defaultdict

import pytest
from pyspark.sql import Row

from cloakframe.llm.mixing import mix_counts, mixed, source_targets


def fill(sizes, weights, total):
    """Targets by reference: reshare the excess until none is above twice its size."""
    free, out, left = dict(weights), {}, total
    while free:
        lam = left / sum(free.values())
        over = [s for s in free if lam * free[s] >= 2 * sizes[s]]
        if not over:
            return out | {s: lam * w for s, w in free.items()}
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
            del free[s]
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 70}, {"x": 1}, {"a": 0, "b": 4}, {f"s{i:02}": i * i for i in range(14)}])
def test_targets(spark, sizes):
    rows = [Row(source=s, size=z) for s, z in sizes.items()]
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    assert got == pytest.approx(want)


def test_mix_is_near_its_targets_and_reruns_agree(spark):
    rows = [Row(doc_id=i, source=["hot", "hot", "b", None, "d"][i % 5], text=None if i % 97 == 0 else "w  \t" * (i % 41) + "é x", size="clash", target=i, prefix="") for i in range(3000)]
    docs = spark.createDataFrame(rows + rows[:3])
    got = mix_counts(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mix_counts(docs).collect()))
    assert len(got) == len(rows) + 3
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    taken, total, target, by = defaultdict(int), defaultdict(int), {}, {r.doc_id: r.source for r in rows}
    for r in got:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size
        taken[by[r.doc_id]] += r.taken
        total[by[r.doc_id]] += r.size
        target[by[r.doc_id]] = r.target
    for s in total:
        assert abs(taken[s] - target[s]) <= 41
    out = mixed(docs)
    assert out.columns == docs.columns
    assert sum(size[r.doc_id] for r in out.collect()) == sum(taken.values())


def test_empty_and_wordless(spark):
    schema = "doc_id long, source string, text string"
    assert mix_counts(spark.createDataFrame([], schema)).count() == 0
    got = mix_counts(spark.createDataFrame([(1, "a", None), (None, None, " ")], schema)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
