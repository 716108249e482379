import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

from cloakframe.llm import cotraining
from cloakframe.llm.common import flat_text
from cloakframe.llm.cotraining import Logistic, meta_view, op8_quality, quality_scores, text_view

SF = "/root/testdata/sf0.01"


def test_logistic_and_calibration():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(4000, 3)), np.ones((4000, 1))], axis=1)
    p = 1 / (1 + np.exp(-(x @ np.array([2.0, -1.0, 0.0, 0.5]))))
    y = (rng.random(4000) < p).astype(float)
    model = Logistic.fit(x[:3000], y[:3000])
    assert model.w == pytest.approx([2, -1, 0, 0.5], abs=0.25)
    got = 1 / (1 + np.exp(-model.calibrate(x[3000:], y[3000:]).log_odds(x)))
    for lo in (0.1, 0.4, 0.7):
        at = (got >= lo) & (got < lo + 0.2)
        assert abs(got[at].mean() - y[at].mean()) < 0.06


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_scores_follow_held_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    own = {r.doc_id: r.quality for r in labels.collect()}
    hidden = {i for i in own if i % 5 == 0}
    got = {r.doc_id: r for r in quality_scores(docs, labels.where("doc_id % 5 != 0")).collect()}
    assert len(got) == docs.count()
    right = [(got[i].score >= 0.5) == bool(own[i]) for i in hidden if i in got]
    assert len(right) > 30 and np.mean(right) >= 0.9
    again = {r.doc_id: r.score for r in quality_scores(docs, labels.where("doc_id % 5 != 0")).collect()}
    assert all(again[i] == pytest.approx(got[i].score, abs=1e-9) for i in got)


def test_features_are_finite_and_know_no_length():
    texts = ["", "a", "w" * 700_000, "a b " * 100_000, "\n" * 1000, "é" * 70_000, "one two three " * 5]
    data, offsets = flat_text(pa.array(texts))
    x = text_view(texts, data, offsets).astype("<f2")
    assert np.isfinite(x).all()
    twice = [t + t for t in texts[3:4]]
    assert text_view(twice, *flat_text(pa.array(twice)))[0] == pytest.approx(x[3].astype(float), abs=2e-3)


def test_one_long_word_spoils_no_score(spark):
    rows = [Row(doc_id=i, text=("fine words " if i % 2 else "## %% ") * (i % 9 + 1), lang="en", source="s") for i in range(60)]
    docs = spark.createDataFrame([*rows, Row(doc_id=60, text="w" * 700_000, lang="en", source="s")])
    labels = spark.createDataFrame([Row(doc_id=i, quality=i % 2) for i in [*range(40), 60]])
    got = {r.doc_id: r.score for r in quality_scores(docs, labels).collect()}
    assert len(got) == 61 and np.isfinite(list(got.values())).all() and min(got[i] for i in range(41, 60, 2)) > max(got[i] for i in range(40, 60, 2))


def test_a_round_against_brute_force(spark, monkeypatch):
    """Who teaches whom, with which rows: plain sorting over all rows on one machine, then the operator's scores."""
    monkeypatch.setattr(cotraining, "PSEUDO", 3)
    monkeypatch.setattr(cotraining, "SURE", 0.6)
    rng = np.random.default_rng(3)
    words = [["plain", "story", "about", "rivers"], ["buy", "###", "now", "%%%"]]
    rows = [(i, " ".join(rng.choice(words[i % 2] if rng.random() < 0.9 else words[1 - i % 2], 6 + i % 5)), "en" if i % 4 else "de", f"s{i % 2 if rng.random() < 0.8 else 2}") for i in range(90)]
    rows += [(100 + i, rows[41][1], rows[41][2], rows[41][3]) for i in range(5)]  # copies count once
    docs = spark.createDataFrame([Row(doc_id=i, text=t, lang=g, source=s) for i, t, g, s in rows])
    known = {i: i % 2 for i in range(40)}
    labels = spark.createDataFrame([Row(doc_id=i, quality=q) for i, q in known.items()])
    hashes = {r.doc_id: (r.h, r.s, r.g) for r in docs.selectExpr("doc_id", "xxhash64(text, source, lang) AS h", "cast(pmod(xxhash64(source), 64) AS int) AS s", "cast(pmod(xxhash64(lang), 64) AS int) AS g").collect()}
    texts = [t for _, t, _, _ in rows]
    x = text_view(texts, *flat_text(pa.array(texts))).astype("<f2").astype(np.float32)
    m = meta_view(*(np.array([hashes[i][c] for i, *_ in rows]) for c in (1, 2)), np.array([len(t) for t in texts]))
    h, y = np.array([hashes[i][0] for i, *_ in rows]), np.array([known.get(i, -1) for i, *_ in rows])
    order = sorted(np.flatnonzero(y >= 0), key=lambda k: h[k])
    held = np.array([k for k in order if h[k] % 4 == 0], int)
    taught = [[(k, y[k]) for k in order if h[k] % 4] for _ in (0, 1)]
    views, given = (x, m), (set(), set())

    def fit():
        made = []
        for v, rows_ in zip(views, taught, strict=True):
            at = [k for k, _ in rows_]
            made.append(Logistic.fit(v[at], np.array([float(c) for _, c in rows_])).calibrate(v[held], y[held].astype(float)))
        return made

    models = fit()
    for _ in range(2):
        lessons = []
        for v in (0, 1):
            p = 1 / (1 + np.exp(-models[v].log_odds(views[v])))
            for c in (0, 1):
                sure = p if c else 1 - p
                best = {}
                for k in sorted(np.flatnonzero((y < 0) & (sure >= 0.6)), key=lambda k: (-sure[k], h[k])):
                    if h[k] not in given[v]:
                        best.setdefault((x[k].tobytes(), *hashes[rows[k][0]][1:], len(texts[k])), k)
                lessons.append((v, c, list(best.values())[:3]))
        for v, c, at in lessons:
            given[v].update(h[k] for k in at)
            taught[1 - v] += [(k, c) for k in at]
        models = fit()
    share = y[y >= 0].mean()
    odds = models[0].log_odds(x) + models[1].log_odds(m) - np.log(share / (1 - share))
    assert any(at for _, _, at in lessons)
    got = {r.doc_id: r for r in quality_scores(docs, labels, rounds=2).collect()}
    for k, (i, *_) in enumerate(rows):
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-odds[k])), abs=1e-4)


def test_odd_rows(spark):
    texts = [None, "", "good words here " * 20, "### $$$ ### %%% " * 20, "good words there " * 30, "%%% ### " * 90]
    docs = spark.createDataFrame([Row(doc_id=None if i == 1 else i, text=t, lang=None, source="s", label="clash", hash=1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, label string, hash int")
    labels = spark.createDataFrame([(2, 1), (3, 0), (4, 1), (5, 0), (0, None), (0, 1), (0, 0)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality_scores(docs, labels).collect()}
    assert len(got) == 6 and got[2] > got[3] and got[4] > got[5] and all(0 <= s <= 1 for s in got.values())
    assert {r.score for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality_scores(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert quality_scores(docs.limit(0), labels).count() == 0
    assert op8_quality
