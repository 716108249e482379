import os
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cloakframe.llm.language import CONTEXT, SEGMENT, WINDOW, ByteTagger, learn, op3_language, pieces, predict

SF = "/root/testdata/sf0.001"


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    net = ByteTagger(["a", "b", "c"], hidden=3, seed=5)
    for group in net.groups():
        for k in group:
            group[k] = group[k].astype(np.float64)
    x, y, w = rng.integers(0, 256, (6, 4)).astype(np.uint8), np.array([0, 1, 2, 1]), np.array([1.0, 2.0, 1.0, 0.5])
    _, grads = net.gradients(x, y, w)
    for group, grad in zip(net.groups(), grads, strict=True):
        for name, values in group.items():
            spots = [(int(x[2, 1]), 1), (int(x[0, 0]), 7)] if name == "T" else [tuple(int(rng.integers(0, s)) for s in values.shape) for _ in range(3)]
            for at in spots:
                old, step, loss = values[at], 3e-2, []
                for sign in (1, -1):
                    values[at] = old + sign * step
                    loss.append(net.gradients(x, y, w)[0])
                values[at] = old
                assert (loss[0] - loss[1]) / (2 * step) == pytest.approx(grad[name][at], rel=0.05, abs=2e-4)


def slow_positions(net, raw):
    """Labels of one row, direction by direction."""
    x = np.frombuffer(raw, np.uint8)[:, None]
    f, b = net.forward.run(x)[0][:, 0], net.backward.run(x[::-1])[0][::-1, 0]
    p = np.concatenate([f, b], axis=1) @ net.out["V"] + net.out["c"]
    p = np.exp(p - p.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def test_every_position_counts_once():
    net = ByteTagger(["a", "b"], seed=1)
    texts = [b"", b"x", b"abc" * 300, bytes(range(256)) * 3, b"y" * SEGMENT, bytes(range(255, 0, -1)) * 7]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for t, g in zip(texts, net.documents(data, offsets), strict=True):
        want = np.zeros(2)
        for k in range(0, len(t), SEGMENT):
            lead = min(k, CONTEXT)
            p = slow_positions(net, t[k - lead : k + SEGMENT + CONTEXT])
            want += p[lead : lead + SEGMENT].sum(axis=0)
        assert g == pytest.approx(want / max(len(t), 1), abs=1e-5)
        assert g.sum() == pytest.approx(1 if t else 0, abs=1e-4)


def test_a_text_is_the_same_alone_and_in_any_batch():
    net, rng = ByteTagger(["a", "b", "c"], seed=2), np.random.default_rng(0)
    texts = [rng.integers(0, 256, n).astype(np.uint8) for n in [*range(1, 601), 5000]]
    read = lambda ts: net.documents(np.concatenate(ts), np.concatenate([[0], np.cumsum([len(t) for t in ts])]))
    alone = np.concatenate([read([t]) for t in texts]).round(6)
    for order in (np.arange(len(texts)), rng.permutation(len(texts)), rng.permutation(len(texts))[:70]):
        assert (read([texts[i] for i in order]).round(6) == alone[order]).all()


def test_gradients_of_rows_of_unlike_length():
    rng = np.random.default_rng(4)
    net = ByteTagger(["a", "b"], hidden=3, seed=5)
    x, y, n = rng.integers(0, 256, (7, 3)).astype(np.uint8), np.array([0, 1, 1]), np.array([7, 2, 5])
    _, grads = net.gradients(x, y, np.ones(3), n)
    total = [{k: np.zeros_like(v) for k, v in g.items()} for g in net.groups()]
    for i in range(3):
        for group, part in zip(total, net.gradients(x[: n[i], i : i + 1], y[i : i + 1], np.ones(1))[1], strict=True):
            for k in group:
                group[k] += part[k] / 3
    for a, b in zip(grads, total, strict=True):
        for k in a:
            assert a[k] == pytest.approx(b[k], abs=1e-5)


def test_pieces_are_whole_characters():
    for text in ("a" * 64, "é" * 64, "中" * 64, "a😀" * 32, ""):
        got = pieces(text)
        assert b"".join(got).decode() == text and all(len(p) <= WINDOW and p.decode() for p in got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_held_out_accuracy(spark):
    rows = op3_language(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.9 * len(held)
    short = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 50 and text rlike '[a-z]{4}'").collect()}
    short = [r for r in rows if r.doc_id in short]
    print("texts under 50 characters:", len(short), sum(r.lang_pred == lang[r.doc_id] for r in short))
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    texts = [None, "", "12 34 ...", "the and of " * 9, "the and of " * 9, "der und die " * 900]
    docs = spark.createDataFrame([Row(doc_id=None if i == 3 else i, text=t, lang=None if i == 1 else "de" if i == 5 else "en", lang_pred="clash", score="x") for i, t in enumerate(texts)])
    model = learn(docs, F.lit(True))
    got = predict(docs, model, "doc_id").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, i) for i in (0, 1, 2, 4, 5)] + [(True, 0)]
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and by[0].score == 0
    assert (by[None].lang_pred, by[None].score) == (by[4].lang_pred, by[4].score)
    assert learn(docs.limit(0), F.lit(True)) is None
    kept = predict(docs.select(F.struct("lang_pred", "score").alias("row"), "text"), model, "row").select("row.*")  # clashing names travel in a struct
    assert kept.columns == ["lang_pred", "score"] and kept.count() == 6
    assert [r.lang_pred for r in predict(docs, None, "doc_id").collect()] == ["und"] * 6
    assert predict(docs.limit(0), model, "doc_id").count() == 0
