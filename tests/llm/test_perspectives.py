from collections import defaultdict

from pyspark.sql import Row

from cloakframe.llm.perspectives import rotate_perspectives


def test_renderings_and_masks(spark):
    rows = [Row(conv_id=1, turn=t, role=r, text=x, block="clash", perspective=0) for t, r, x in [(0, "system", "be kind"), (1, "ann", "hi <|end|>"), (2, "bob", None), (3, "ann", "é" * 9), (3, "ann", "é" * 9)]]
    rows += [Row(conv_id=None, turn=None, role=None, text="x", block="", perspective=1), Row(conv_id=2, turn=0, role="system", text="alone", block="", perspective=1)]
    rows += [Row(conv_id=3, turn=t, role=f"p{t % 3}", text="w" * (t % 7), block="", perspective=1) for t in range(700)]
    by = defaultdict(list)
    for r in rotate_perspectives(spark.createDataFrame(rows), block=16).collect():
        by[r.conv_id, r.perspective].append(r)
    assert set(by) == {(1, "ann"), (1, "bob"), (None, "unknown"), (3, "p0"), (3, "p1"), (3, "p2")}
    for (_, who), segments in by.items():
        segments.sort(key=lambda r: r.position)
        whole = "".join(r.segment for r in segments)
        at = 0
        for k, r in enumerate(segments):
            assert (r.position, r.start, r.n_chars) == (k, at, len(r.segment))
            trained = whole[r.mask_start : r.mask_end]
            assert trained == (r.segment.split("\n", 1)[1][:-1] if r.speaker == who else "")
            assert r.segment.startswith("<|assistant|>" if r.speaker == who else "<|system|>" if r.speaker == "system" else f"<|user name={r.speaker}|>")
            at += r.n_chars
    assert [r.segment for r in by[1, "bob"]][:3] == ["<|system|>\nbe kind<|end|>\n", "<|user name=ann|>\nhi < |end|><|end|>\n", "<|assistant|>\n<|end|>\n"]
    assert len(by[1, "ann"]) == 5 and len(by[3, "p0"]) == 700


def test_empty_table(spark):
    assert rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
