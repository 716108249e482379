"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

Two gated recurrent units read bytes forwards and backwards; a softmax over both states labels every position,
and a document's probabilities are the mean over all its positions. Training is backpropagation through time with
Adam on a bounded sample: windows of about TRAIN_DOCS documents, the same number for each language, taken by
the smallest hashes among those that may be learned from; the LABELS most frequent languages are learned.

Prediction labels every byte of every text. Long texts are read in segments of SEGMENT bytes; each unit starts
CONTEXT bytes before its segment (inside the text), so the states at a segment's edge know what comes before and
after it. What follows a row's end in a group of rows never reaches its states.

Defined cases: null text or a text without a letter is `und` with score 0; so is every text if nothing can be
learned from; a null doc_id is neither held out nor learned from; a text's label and score are the same alone, in any
batch and in any partitioning (scores are rounded to six decimals); repeated rows stay; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, flat_text, prepare, release_memory, table

#: Bounds of what is learned from, and the network's sizes.
TRAIN_DOCS, LABELS, WINDOWS, WINDOW, HIDDEN, EPOCHS, BATCH = 2000, 256, 4, 64, 8, 4, 256
SEGMENT, CONTEXT, ROWS = 448, 32, 1024
#: A small sample is gone over more often, for at least so many steps.
STEPS = 150
UNKNOWN = "und"


def turned(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(time, rows, ...) with the first lengths[row] entries of each row in reverse order; what follows stays behind them."""
    if len(lengths) and int(lengths.min()) == len(x):
        return x[::-1]
    t = np.arange(len(x))[:, None]
    at = np.where(t < lengths, lengths - 1 - t, t)
    return x[at, np.arange(x.shape[1])]


class Direction:
    """One gated recurrent unit; its input weights are a row for each byte."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.p = {
            "T": rng.normal(0, 0.1, (256, 3 * hidden)).astype(np.float32),
            "U": rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32),
            "b": np.zeros(3 * hidden, np.float32),
        }
        self.h = hidden

    def run(self, x: np.ndarray, keep: bool = False, inside: np.ndarray | None = None) -> tuple[np.ndarray, list]:
        """x: (time, rows) bytes -> states (time, rows, hidden). Where inside (time, rows, 1) is 0 a state is the initial one."""
        h, n, (T, U, b) = self.h, x.shape[1], (self.p["T"], self.p["U"], self.p["b"])
        out, state, tape = np.empty((*x.shape, h), np.float32), np.zeros((n, h), np.float32), []
        # the unit's gates are sigmoids: half a tanh of half the sum, so halves are put into the weights
        half = np.ones(3 * h, np.float32)
        half[: 2 * h] = 0.5
        Th, Uh, bh = T * half, U * half, b * half
        xs, hs = np.empty((n, 3 * h), np.float32), np.empty((n, 3 * h), np.float32)
        for t in range(len(x)):
            np.take(Th, x[t], axis=0, out=xs)
            np.matmul(state, Uh, out=hs)
            hs += bh
            hn = hs[:, 2 * h :]
            gates = xs[:, : 2 * h] + hs[:, : 2 * h]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:, :h], gates[:, h:]
            new = r * hn
            new += xs[:, 2 * h :]
            np.tanh(new, out=new)
            if keep:
                tape.append((state.copy(), z.copy(), r.copy(), new.copy(), hn.copy()))
            state = np.subtract(state, new, out=out[t])
            state *= z
            state += new
            if inside is not None:
                state *= inside[t]
        return out, tape

    def back(self, x: np.ndarray, tape: list, grad: np.ndarray) -> dict[str, np.ndarray]:
        """grad: of the states; returns the gradients of the weights."""
        h, U = self.h, self.p["U"]
        gx, gU, gb, carry = np.empty((*x.shape, 3 * h), np.float32), np.zeros_like(U), np.zeros(3 * h, np.float32), 0
        for t in range(len(x) - 1, -1, -1):
            before, z, r, new, hn = tape[t]
            d = grad[t] + carry
            dn = d * (1 - z) * (1 - new * new)
            gx[t] = np.concatenate([d * (before - new) * z * (1 - z), dn * hn * r * (1 - r), dn], axis=1)
            gh = gx[t].copy()
            gh[:, 2 * h :] *= r
            gU += before.T @ gh
            gb += gh.sum(axis=0)
            carry = d * z + gh @ U.T
        gT, flat, rows = np.zeros_like(self.p["T"]), x.ravel(), gx.reshape(-1, 3 * h)
        order = np.argsort(flat, kind="stable")
        values, first = np.unique(flat[order], return_index=True)
        gT[values] = np.add.reduceat(rows[order], first, axis=0)
        return {"T": gT, "U": gU, "b": gb}


class ByteTagger:
    """The network: labels for every byte."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.forward, self.backward = Direction(rng, hidden), Direction(rng, hidden)
        self.out = {"V": rng.normal(0, 0.3, (2 * hidden, len(labels))).astype(np.float32), "c": np.zeros(len(labels), np.float32)}

    def groups(self) -> list[dict[str, np.ndarray]]:
        return [self.forward.p, self.backward.p, self.out]

    def positions(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(time, rows) bytes, of which lengths[row] count -> (time, rows, labels) probabilities."""
        h, k, inside = self.forward.h, len(self.labels), None
        if int(lengths.min()) < len(x):  # backwards a row starts with what follows its end: the unit waits there
            inside = (np.arange(len(x))[::-1, None] < lengths).astype(np.float32)[:, :, None]
        f, _ = self.forward.run(x)
        b, _ = self.backward.run(x[::-1], inside=inside)
        p = f.reshape(-1, h) @ self.out["V"][:h]
        p += b[::-1].reshape(-1, h) @ self.out["V"][h:]
        p += self.out["c"]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p.reshape(*x.shape, k)

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, lengths: np.ndarray | None = None) -> tuple[float, list[dict[str, np.ndarray]]]:
        """x: (time, rows) bytes, y: labels of the rows; cross entropy over all positions that count, and its gradients."""
        h, lengths = self.forward.h, np.full(x.shape[1], len(x)) if lengths is None else lengths
        back = turned(x, lengths)
        f, ft = self.forward.run(x, keep=True)
        b, bt = self.backward.run(back, keep=True)
        states = np.concatenate([f, turned(b, lengths)], axis=2)
        logits = states @ self.out["V"] + self.out["c"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        rows = np.arange(len(y))
        inside = np.arange(len(x))[:, None] < lengths
        w = inside * (weight / np.maximum(lengths, 1) / weight.sum())
        loss = float(-(np.log(p[:, rows, y] + 1e-30) * w).sum())
        p[:, rows, y] -= 1
        p *= w[:, :, None].astype(np.float32)
        flat = p.reshape(-1, p.shape[2])
        gs = p @ self.out["V"].T
        out = {"V": states.reshape(-1, 2 * h).T @ flat, "c": flat.sum(axis=0)}
        return loss, [self.forward.back(x, ft, gs[:, :, :h]), self.backward.back(back, bt, turned(gs[:, :, h:], lengths)), out]

    def fit(self, x: np.ndarray, y: np.ndarray, lengths: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = 0.02, seed: int = 0) -> ByteTagger:
        """x: (windows, time) bytes, of which lengths count; classes weigh alike, however many windows they have."""
        rng, counts = np.random.default_rng(seed), np.bincount(y, minlength=len(self.labels))
        weight = (1 / np.maximum(counts, 1))[y].astype(np.float32)
        moments = [{k: (np.zeros_like(v), np.zeros_like(v)) for k, v in g.items()} for g in self.groups()]
        per = -(-len(x) // batch)
        epochs = max(epochs, -(-STEPS // per))
        step, steps = 0, epochs * per
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for k in range(0, len(x), batch):
                at = order[k : k + batch]
                _, grads = self.gradients(np.ascontiguousarray(x[at].T), y[at], weight[at], lengths[at])
                step += 1
                scale = min(1.0, 1 / (1e-9 + float(np.sqrt(sum((g**2).sum() for part in grads for g in part.values())))))
                lr = rate * (1 - 0.9 * step / steps)
                for part, group, moment in zip(grads, self.groups(), moments, strict=True):
                    for name, g in part.items():
                        m, v = moment[name]
                        g = g * scale
                        m += 0.1 * (g - m)
                        v += 0.01 * (g * g - v)
                        group[name] -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Pooled probabilities of texts that lie one after the other; every byte counts once."""
        sizes = np.diff(offsets)
        per = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(sizes)), per)
        core = (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)) * SEGMENT  # in the text
        lead = np.minimum(core, CONTEXT)
        counts = np.minimum(SEGMENT, sizes[owner] - core)
        lengths = np.minimum(lead + counts + CONTEXT, sizes[owner] - core + lead)
        starts = offsets[owner] + core - lead
        order = np.argsort(-lengths, kind="stable")
        sums = np.zeros((len(starts), len(self.labels)))
        padded = np.concatenate([data, np.zeros(SEGMENT + 2 * CONTEXT, np.uint8)])
        for k in range(0, len(order), ROWS):
            at = order[k : k + ROWS]
            # rows of zero length fill the group up: whole tiles of the matrix products, so that a row's sums don't depend on its group
            n = np.concatenate([lengths[at], np.zeros(-len(at) % 64, np.int64)])
            t = np.arange(int(n[0]))[:, None]
            x = np.where(t < n, padded[np.minimum(np.append(starts[at], np.zeros(len(n) - len(at), np.int64)) + t, len(padded) - 1)], np.uint8(0))
            p = self.positions(x, n)[:, : len(at)]
            p *= ((t >= lead[at]) & (t < (lead + counts)[at]))[:, :, None]
            sums[at] = p.sum(axis=0, dtype=np.float64)
        pooled = np.zeros((len(sizes), len(self.labels)))
        np.add.at(pooled, owner, sums)
        return pooled / np.maximum(sizes, 1)[:, None]


def pieces(window: str) -> list[bytes]:
    """A window as runs of whole characters of at most WINDOW bytes."""
    raw, out = window.encode(), []
    while raw:
        end = min(WINDOW, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(raw[:end])
        raw = raw[end:]
    return out


def learn(docs: DataFrame, may_learn, seed: int = 0) -> ByteTagger | None:
    """Fits on windows of a bounded sample that reaches the driver; None if there is nothing to learn from.

    A language gives its rows with the smallest hashes: about TRAIN_DOCS / number of languages, all if it has fewer.
    """
    rows = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select(F.xxhash64("doc_id", "text").alias("hash"), F.col("lang").cast("string").alias("lang"), "text")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LABELS).collect()
    if not counts:
        return None
    share = -(-TRAIN_DOCS // len(counts))
    most = {r.lang: int(min(1.0, 1.5 * share / r["count"]) * (1 << 62)) for r in counts}  # of hashes below 2^62
    limit = F.create_map(*[F.lit(x) for pair in most.items() for x in pair])[F.col("lang")]
    near = rows.where(F.shiftrightunsigned("hash", 2) <= limit)
    n = F.greatest(F.length("text") - WINDOW, F.lit(0))
    parts = [F.substring(F.col("text"), F.floor(n * k / max(WINDOWS - 1, 1)).cast("int") + 1, F.lit(WINDOW)) for k in range(WINDOWS)]
    near = near.select("hash", "lang", F.array_distinct(F.array(*parts)).alias("windows"))
    sample = near.orderBy("hash", "lang", "windows").limit(2 * TRAIN_DOCS + 2 * LABELS).collect()
    labels, taken, raw = sorted(most), dict.fromkeys(most, 0), []
    for r in sample:
        taken[r.lang] += 1
        if taken[r.lang] <= share:
            raw += [(w, labels.index(r.lang)) for window in r.windows for w in pieces(window)]
    x = np.frombuffer(b"".join(w.ljust(WINDOW, b"\0") for w, _ in raw), np.uint8).reshape(-1, WINDOW)
    model = ByteTagger(labels, seed=seed).fit(x, np.array([y for _, y in raw]), np.array([len(w) for w, _ in raw]), seed=seed)
    release_memory()
    return model


def predict(docs: DataFrame, model: ByteTagger | None, *keep: str) -> DataFrame:
    """Columns `keep` of docs (none called lang_pred or score) with lang_pred and score, from the text alone."""
    has = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.array(model.labels, dtype=object)
        for batch in batches:
            data, offsets = flat_text(batch.column(len(keep)))
            letters = batch.column(len(keep) + 1).to_numpy(zero_copy_only=False)
            p = model.documents(data, offsets) if batch.num_rows else np.zeros((0, len(labels)))
            best = p.argmax(axis=1)
            names = np.where(letters, labels[best], UNKNOWN)
            score = np.where(letters, np.clip(p.max(axis=1, initial=0), 0, 1), 0.0).round(6)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], pa.array(names.tolist(), pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])
        release_memory()

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*keep, F.col("text").alias("__text"), has.alias("__letters")).mapInArrow(run, schema)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, crc_mod("doc_id", 4) != 2)
    named = docs.select("doc_id", "text", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"))
    return predict(named, model, "doc_id", "held_out")
