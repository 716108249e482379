import os

import pytest

import corpus_pipeline
from cloakframe.llm.common import scratch, scratch_paths, scratch_root, shrink_heaps

SF = "/root/testdata/sf0.001"


def test_blocks_of_scratch_paths_with_equal_lists(spark):
    with scratch_paths() as outer:
        with scratch_paths() as inner:
            first = scratch(spark, "first")
        second = scratch(spark, "second")
        with scratch_paths() as empty:
            pass
        third = scratch(spark, "third")
    scratch(spark, "outside")
    assert (outer, inner, empty) == ([first, second, third], [first], [])


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_run_gives_what_its_stages_give_and_drops_their_tables(spark):
    root = scratch_root(spark).removeprefix("file://")
    before = set(os.listdir(root))
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before}
    assert "stage-mixing" in left and not left & {"stage-language", "stage-near_duplicates", "stage-repeats"}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert got == sorted(map(tuple, docs.collect())) and got


def test_stages_start_with_heaps_given_back(spark, monkeypatch):
    calls, shrink = [], corpus_pipeline.shrink_heaps
    monkeypatch.setattr(corpus_pipeline, "shrink_heaps", lambda s: calls.append(shrink(s)))
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, empty, "")
        assert len(calls) == k + 1


def test_shrink_heaps(spark):
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    held = [spark._jvm.java.nio.ByteBuffer.allocate(300 << 20) for _ in range(4)]
    grown = runtime.totalMemory()
    for x in held:
        spark.sparkContext._gateway.detach(x)
    del held, x
    shrink_heaps(spark)
    assert runtime.totalMemory() < grown - (600 << 20)
