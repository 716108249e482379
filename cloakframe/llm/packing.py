"""Packing documents into sequences by cutting-stock column generation.

1. Texts become ids with an end id. Every 4096 ids make a piece; the rest of a document is one more piece.
2. Piece lengths, rounded up to a quantum, make a histogram: at most capacity / quantum classes at any input size.
3. A linear program over patterns (how many pieces of each class share a sequence) is solved by revised
   simplex; an unbounded knapsack by dynamic programming prices new patterns until none improves the bound.
4. Pattern counts are rounded down; what demand is left gets first-fit-decreasing patterns.
5. Pieces are ranked within their class, and the rank says which sequence and slot a piece has.

Only the histogram and the pattern table (both bounded by the number of classes) reach the driver.
Defined cases: null or empty text is the end id alone; null doc_ids, repeated rows and shared doc_ids are
documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, prepare, stored, table
from .tokens import encoder

CAPACITY, QUANTUM, END_ID = 4096, 8, 2
#: Column generation stops when the program is within this part of its lower bound.
GAP = 0.001
PIECES = "doc_id long, tie long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def price(duals: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The pattern of most dual value: unbounded knapsack, item c + 1 has weight c + 1."""
    best, take = np.zeros(size + 1), np.zeros(size + 1, dtype=np.int64)
    for w in range(1, size + 1):
        options = best[w - 1 :: -1] + duals[:w]
        k = int(options.argmax())
        if options[k] > best[w - 1]:
            best[w], take[w] = options[k], k + 1
        else:
            best[w] = best[w - 1]
    pattern, w = np.zeros(size, dtype=np.int64), size
    while w:
        if take[w]:
            pattern[take[w] - 1] += 1
            w -= int(take[w])
        else:
            w -= 1
    return float(best[size]), pattern


def solve(demand: np.ndarray, size: int, gap: float = GAP, most: int = 5000) -> list[tuple[int, np.ndarray]]:
    """Counts and patterns that cover demand (pieces of class c + 1, c + 1 quanta long) in bins of `size` quanta."""
    rows = np.flatnonzero(demand)
    if not len(rows):
        return []
    need = demand[rows].astype(float)
    columns = np.zeros((size, len(rows)))
    columns[rows, np.arange(len(rows))] = size // (rows + 1)
    basis, cost = columns[rows].copy(), np.ones(len(rows))  # column j: one class alone
    inverse = np.linalg.inv(basis)
    for step in range(most):
        x, duals = inverse @ need, cost @ inverse
        low = int(duals.argmin())
        if duals[low] < -1e-9:  # more of a class than asked for costs nothing
            column, price_of = np.zeros(len(rows)), 0.0
            column[low] = -1
        else:
            full = np.zeros(size)
            full[rows] = np.maximum(duals, 0)
            value, pattern = price(full, size)
            if value <= 1 + gap:  # the optimum is at least cost / value
                break
            column, price_of = pattern[rows].astype(float), 1.0
        direction = inverse @ column
        ok = direction > 1e-9
        ratios = np.where(ok, np.maximum(x, 0) / np.where(ok, direction, 1), np.inf)
        leave = int(ratios.argmin())
        if not np.isfinite(ratios[leave]):
            break
        basis[:, leave], cost[leave] = column, price_of
        if step % 64 == 63:
            inverse = np.linalg.inv(basis)
        else:
            pivot = inverse[leave] / direction[leave]
            inverse -= np.outer(direction, pivot)
            inverse[leave] = pivot
    left, out = demand.astype(np.int64).copy(), []
    x = np.linalg.solve(basis, need)
    for j in np.argsort(-x, kind="stable"):
        n = int(np.floor(x[j] + 1e-9))
        if cost[j] and n > 0:
            pattern = np.zeros(size, dtype=np.int64)
            pattern[rows] = basis[:, j].astype(np.int64)
            n = min([n, *(-(-left[c] // pattern[c]) for c in np.flatnonzero(pattern) if left[c] > 0)]) if (left[pattern > 0] > 0).any() else 0
            if n > 0:
                out.append((n, pattern))
                left = np.maximum(left - n * pattern, 0)
    while left.any():  # first fit decreasing, equal sequences at one go
        pattern, room, c = np.zeros(size, dtype=np.int64), size, size
        while room and c:
            n = min(room // c, int(left[c - 1]))
            pattern[c - 1] = n
            room -= n * c
            c = min(c - 1, room)
        n = min(int(left[c] // pattern[c]) for c in np.flatnonzero(pattern))
        out.append((n, pattern))
        left -= n * pattern
    return out


def _cutter(path: str, capacity: int, end_id: int, with_ids: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part, cols = batch.slice(k, 2000), [[] for _ in schema]
                for doc, tie, raw in zip(part.column("doc_id").to_pylist(), part.column("tie").to_pylist(), enc.encode(part.column("text").to_pylist()), strict=True):
                    raw += end
                    n = len(raw) // 4
                    for at in range(0, n, capacity):
                        piece = raw[4 * at : 4 * (at + capacity)]
                        for col, v in zip(cols, (doc, tie, at, len(piece) // 4, zlib.crc32(piece), n, piece if with_ids else None), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    return cut


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, quantum: int = QUANTUM, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece with its sequence and offset; with_ids keeps the ids themselves (uint32, little-endian)."""
    if capacity % quantum:
        raise ValueError("the quantum must divide the capacity")
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    pieces = stored(rows.mapInArrow(_cutter(tokenizer_path, capacity, end_id, with_ids), PIECES), "pieces")
    size, n = capacity // quantum, partitions(pieces)
    # the bucket splits a class that holds most pieces; it depends on values alone, so that both passes agree
    ranked = pieces.withColumn("kind", F.ceil(F.col("length") / quantum).cast("int")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie", "start"), F.lit(n)).cast("int"))
    counts = stored(ranked.groupBy("kind", "bucket").agg(F.count("*").alias("n")), "piece-counts")
    demand = np.zeros(size, dtype=np.int64)
    for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect():  # at most capacity / quantum rows
        demand[r.kind - 1] = r.n
    slots, sequence, done = [], 0, np.zeros(size, dtype=np.int64)
    for count, pattern in solve(demand, size):
        slot = 0
        for c in np.flatnonzero(pattern)[::-1]:
            a = int(pattern[c])
            slots.append((int(c) + 1, int(done[c]), int(done[c]) + a * count, a, sequence, slot))
            done[c] += a * count
            slot += a
        sequence += count
    plan = spark.createDataFrame(slots, "kind int, first long, beyond long, each long, sequence long, slot0 long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("kind").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranked.join(counts.select("kind", "bucket", before.alias("before")), ["kind", "bucket"])
    inner = Window.partitionBy("kind", "bucket").orderBy("doc_id", "tie", "start")
    ranked = ranked.withColumn("rank", F.row_number().over(inner) - 1 + F.col("before")).drop("before", "bucket")
    # the plan has a row for each class of each pattern: bounded by the classes, whatever the input
    placed = ranked.alias("r").join(F.broadcast(plan).alias("p"), (F.col("r.kind") == F.col("p.kind")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("beyond")))
    turn = F.col("rank") - F.col("first")
    placed = placed.withColumn("sequence_id", F.expr("sequence + (rank - first) div each")).withColumn("slot", F.col("slot0") + turn % F.col("each"))
    inside = Window.partitionBy("sequence_id").orderBy("slot")
    offset = F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    return placed.withColumn("offset", offset).select(*kept)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """A row for each sequence: its ids, padded to the capacity unless their number is a power of two."""
    joined = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))).alias("parts"), F.sum("length").alias("n_tokens"))
    text = F.concat_ws("", F.col("parts.ids"))
    whole = F.expr("n_tokens & (n_tokens - 1)") == 0
    padding = F.when(whole, F.lit("")).otherwise(F.expr(f"repeat('{pad_id.to_bytes(4, 'little').hex()}', cast({capacity} - n_tokens as int))"))
    return joined.select("sequence_id", "n_tokens", F.unhex(F.concat(text, padding)).alias("ids"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
