"""Quality scores by co-training a text view and a metadata view.

The text view sees the whole text: byte shares, hashed words and word pairs, and layout ratios, but not its length; the
metadata view sees source, language and length, never the text. Both are logistic regressions. They start from
labelled documents; in each round each view scores all unlabelled documents, and those it is surest of are given, with
its labels, to the other view: the PSEUDO surest of each class that it hasn't given yet, rows that are alike
in both views once. At the end both are calibrated on labelled documents that neither was fitted on (Platt scaling), and their
calibrated log odds are added (less the prior, which both hold).

Bounds: LABELLED labelled documents (smallest hash) and PSEUDO pseudo-labels of a class, view and round reach the
driver; features, scores and the choice of the surest cover all documents.
Defined cases: null text is an empty text; words of any length count alike (features are shares, ratios and logarithms,
all finite); null metadata is a value of its own; labels that are null or contradict each other in equal numbers don't
count; without labels of both classes every score is the share of good labels (0.5 without any); repeated rows stay; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat_text, prepare, release_memory, settled, stored, table
from .ngram_join import shingles

LABELLED, PSEUDO, ROUNDS, SURE = 6000, 200, 3, 0.95
BINS, WORDS, PAIRS, SHAPE = 64, 192, 192, 8
TEXT_SIZE, META_SIZE = 128 + SHAPE + WORDS + PAIRS, 2 * BINS + 8
RESULT = "doc_id long, text_score double, meta_score double, score double, good boolean"
FEATURES = "doc_id long, hash long, source_bin int, lang_bin int, chars long, text_vec binary"
SUREST = "view int, class int, sure double, hash long, source_bin int, lang_bin int, chars long, text_vec binary"


def _hashed(data: np.ndarray, offsets: np.ndarray, n: int, bins: int) -> np.ndarray:
    """(texts, bins): square roots of the shares of hashed n-grams of words."""
    grams, at = shingles(data, offsets, n)
    count = np.diff(at)
    owner = np.repeat(np.arange(len(count)), count)
    out = np.bincount(owner * bins + (grams % np.uint64(bins)).astype(np.int64), minlength=len(count) * bins).reshape(-1, bins)
    return np.sqrt(out / np.maximum(count, 1)[:, None])


def layout(text: str) -> tuple[float, ...]:
    """Ratios of words and lines; none of them grows with the text."""
    words, lines = text.split(), text.split("\n")
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return len(set(words)) / max(len(words), 1), again / max(len(words), 1), np.log1p(lengths.mean()), np.log1p(lengths.std()), len(set(lines)) / len(lines)


def text_view(texts: list[str | None], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, TEXT_SIZE) features of texts that lie one after the other in data; shares, ratios and logarithms, so half precision holds them."""
    out = np.zeros((len(texts), TEXT_SIZE), np.float32)
    for i, (text, a, b) in enumerate(zip(texts, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b > a:
            share = np.bincount(data[a:b], minlength=256) / (b - a)
            letters, beyond = share[65:91].sum() + share[97:123].sum() + share[128:].sum(), share[128:].sum()
            out[i, :128] = np.sqrt(share[:128])
            out[i, 128 : 128 + SHAPE] = (*layout(text), letters, np.sqrt(beyond), 1)
    out[:, 128 + SHAPE : 128 + SHAPE + WORDS] = _hashed(data, offsets, 1, WORDS)
    out[:, 128 + SHAPE + WORDS :] = _hashed(data, offsets, 2, PAIRS)
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = [c.split()[0] for c in FEATURES.split(", ")][:-1]
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            vectors = text_view(part.column("text").to_pylist(), *flat_text(part.column("text")))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array([v.astype("<f2").tobytes() for v in vectors], pa.binary())], names=[*kept, "text_vec"])
    release_memory()


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(batch.column("text_vec").to_pylist()), "<f2").reshape(batch.num_rows, TEXT_SIZE).astype(np.float32)
    return x, meta_view(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("source_bin", "lang_bin", "chars")))


def meta_view(source: np.ndarray, lang: np.ndarray, chars: np.ndarray) -> np.ndarray:
    m, at = np.zeros((len(source), META_SIZE), np.float32), np.arange(len(source))
    m[at, source] = m[at, BINS + lang] = 1
    size = np.log1p(np.maximum(chars, 0).astype(float))
    for k in range(7):  # soft bins of the length
        m[:, 2 * BINS + k] = np.exp(-((size - 1.5 * (k + 1)) ** 2))
    m[:, -1] = 1
    return m


@dataclass
class Logistic:
    """Logistic regression by Newton steps on standardized features, with a ridge; then a Platt scale."""

    w: np.ndarray
    a: float = 1.0
    b: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> Logistic:
        x = x.astype(np.float64)
        spread = x.std(axis=0)
        scale = np.where(spread > 1e-9, 1 / np.maximum(spread, 1e-9), 1.0)
        z, w = x * scale, np.zeros(x.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (p - y) + ridge * w
            hess = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        return cls(w * scale)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        if len(set(y.tolist())) == 2:
            s = np.clip(x.astype(np.float64) @ self.w, -30, 30)
            scale = Logistic.fit(np.stack([s, np.ones(len(s))], axis=1), y, ridge=1e-2).w
            self.a, self.b = float(max(scale[0], 0.0)), float(scale[1])
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.a * np.clip(x.astype(np.float64) @ self.w, -30, 30) + self.b, -30, 30)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _surest(models: tuple[Logistic, Logistic], given: list[np.ndarray]):
    """The PSEUDO surest rows of each view and class in a partition that the view hasn't given yet; rows alike in both views count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], dict[tuple, tuple]] = {(v, c): {} for v in (0, 1) for c in (0, 1)}
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes, same = batch.column("hash").to_numpy(), list(zip(*(batch.column(c).to_pylist() for c in ("source_bin", "lang_bin", "chars", "text_vec")), strict=True))
            for v, (model, x) in enumerate(zip(models, _views(batch), strict=True)):
                p, new = _sigmoid(model.log_odds(x)), ~np.isin(hashes, given[v])
                for c in (0, 1):
                    sure, best = p if c else 1 - p, kept[v, c]
                    at = np.flatnonzero((sure >= SURE) & new)
                    for i in at[np.lexsort((hashes[at], -sure[at]))].tolist():
                        rank = (-float(sure[i]), int(hashes[i]))
                        if len(best) >= PSEUDO and rank > max(best.values()):
                            break
                        best[same[i]] = min(best.get(same[i], rank), rank)
                        if len(best) > PSEUDO:
                            del best[max(best, key=best.__getitem__)]
        out = [(v, c, -rank[0], rank[1], *row) for (v, c), rows in kept.items() for row, rank in rows.items()]
        if out:
            types = (pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["view", "class", "sure", "hash", "source_bin", "lang_bin", "chars", "text_vec"])

    return run


def _score(models: tuple[Logistic, Logistic], prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t, m = (model.log_odds(x) for model, x in zip(models, _views(batch), strict=True))
            p = _sigmoid(t + m - prior)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_sigmoid(t)), pa.array(_sigmoid(m)), pa.array(p), pa.array(p >= 0.5)], names=["doc_id", "text_score", "meta_score", "score", "good"])

    return run


def _stack(rows: list) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(r.text_vec for r in rows), "<f2").reshape(len(rows), TEXT_SIZE).astype(np.float32)
    return x, meta_view(*(np.array([r[c] for r in rows], np.int64) for c in ("source_bin", "lang_bin", "chars")))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", rounds: int = ROUNDS) -> DataFrame:
    prepare(docs.sparkSession)
    bin_ = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0"))), F.lit(BINS)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text", "source", "lang").alias("hash"), bin_("source").alias("source_bin"), bin_("lang").alias("lang_bin"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), "text")
    made = rows.mapInArrow(_features, FEATURES)
    votes = labels.where(F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.when(F.col(label) > 0, 1.0).otherwise(0.0)).alias("share"))
    votes = votes.where("share != 0.5").select("doc_id", (F.col("share") > 0.5).cast("int").alias("label"))
    feats = stored(made.join(votes, "doc_id", "left"), "quality-features")
    known = feats.where("label is not null")
    least = known.select("hash").orderBy("hash").limit(LABELLED).agg(F.max("hash")).first()[0]
    sample = known.where(F.col("hash") <= least).orderBy("hash", "label", "text_vec").limit(LABELLED).collect() if least is not None else []
    y = np.array([r.label for r in sample], np.float64)
    if len(set(y.tolist())) < 2:
        flat = F.lit(float(y.mean()) if len(y) else 0.5)
        return feats.select("doc_id", flat.alias("text_score"), flat.alias("meta_score"), flat.alias("score"), (flat >= 0.5).alias("good"))
    views = _stack(sample)
    held = np.array([r.hash % 4 == 0 for r in sample])
    if len(set(y[~held].tolist())) < 2:
        held[:] = False
    tests = [(x[held], y[held]) for x in views]
    train = [[(x[~held], y[~held])] for x in views]

    def fitted() -> tuple[Logistic, Logistic]:
        return tuple(Logistic.fit(*(np.concatenate(c) for c in zip(*parts, strict=True))).calibrate(*test) for parts, test in zip(train, tests, strict=True))

    models, given = fitted(), [np.empty(0, np.int64), np.empty(0, np.int64)]
    for k in range(rounds):
        sure = stored(feats.where("label is null").mapInArrow(_surest(models, given), SUREST), f"quality-round-{k}")
        alike = ["view", "class", "source_bin", "lang_bin", "chars", "text_vec"]
        sure = sure.groupBy(*alike).agg(F.max("sure").alias("sure"), F.min_by("hash", F.struct(-F.col("sure"), "hash")).alias("hash"))
        for v in (0, 1):
            for c in (0, 1):  # at most PSEUDO rows each
                got = sure.where((F.col("view") == v) & (F.col("class") == c)).orderBy(F.desc("sure"), "hash").limit(PSEUDO).collect()
                if got:
                    given[v] = np.append(given[v], [r.hash for r in got])
                    train[1 - v].append((_stack(got)[1 - v], np.full(len(got), float(c))))
        models = fitted()
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    return feats.mapInArrow(_score(models, float(np.log(share / (1 - share)))), RESULT)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "quality")
