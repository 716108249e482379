"""Approximate nearest neighbours: an inverted file with product-quantised residuals and exact reranking.

Equal vectors are one entry that keeps their k + 1 smallest ids: no other id of them can be among k results.
Coarse centroids (the square root of the number of vectors, at most LISTS) and codebooks are fitted on a sample of SHARE
vectors a list, at most TRAIN, with the smallest hash; every vector is indexed. A query probes its nearest
lists: so many that, in the sample, they hold COVER of the true neighbours; in each list a table of squared distances from the
query's residual to every code gives all entries' distances, and the best over all lists are compared exactly, in double
precision, on the original vectors (a double column is kept as doubles). That shortlist is as long as the sample's
neighbours need, in proportion to the table, from RERANK to MOST. Lists are cut into blocks of bounded size, so that
a list that holds most vectors is spread over tasks. `exact` probes every list and compares every vector.

Defined cases: vectors that are null, zero, hold null or non-finite components, or haven't the most frequent
length (of equals the smaller) take no part: between unlike lengths there is no distance; null ids take no part; a
query never finds rows of its own id; rows of equal id count as one each if their vectors differ, else once; if a
query's id has several vectors, the least by its bytes is searched; ties go to the smaller id; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, prepare, settled, stored, table

#: Bounds of what is fitted; then of the search.
TRAIN, SHARE, LISTS, PARTS, CODES, ROUNDS = 65_536, 64, 4096, 16, 256, 6
K, PROBES, RERANK, MOST, BLOCK = 10, 8, 400, 8000, 8192
#: Probed lists are as many as hold this part of the sample's own neighbours, tried with so many of its vectors.
COVER, TRIED = 0.97, 256


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out, norms = np.empty(len(x), np.int64), (centers**2).sum(axis=1) / 2
    for k in range(0, len(x), 4096):
        out[k : k + 4096] = (norms - x[k : k + 4096] @ centers.T).argmin(axis=1)
    return out


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    x = np.ascontiguousarray(x)
    centers = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, centers)
        order, counts = np.argsort(near, kind="stable"), np.bincount(near, minlength=len(centers))
        full = np.flatnonzero(counts)
        centers[full] = np.add.reduceat(x[order], (np.cumsum(counts) - counts)[full], axis=0) / counts[full, None]
        empty = np.flatnonzero(counts == 0)
        centers[empty] = x[rng.integers(0, len(x), len(empty))]
    return centers


@dataclass
class Index:
    centers: np.ndarray  # (lists, dimension)
    books: list[np.ndarray]  # a codebook for each part
    cuts: list[tuple[int, int]]  # the parts' columns

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, parts: int = PARTS, codes: int = CODES, seed: int = 0) -> Index:
        rng, d = np.random.default_rng(seed), sample.shape[1]
        centers = k_means(sample, min(lists, len(sample)), ROUNDS, rng)
        residual = sample - centers[_nearest(sample, centers)]
        edges = np.linspace(0, d, min(parts, d) + 1).astype(int).tolist()
        cuts = list(zip(edges[:-1], edges[1:], strict=True))
        return cls(centers, [k_means(residual[:, a:b], min(codes, len(sample)), ROUNDS, rng) for a, b in cuts], cuts)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes of each vector."""
        near = _nearest(x, self.centers)
        residual = x - self.centers[near]
        return near, np.stack([_nearest(residual[:, a:b], book) for (a, b), book in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)

    def table(self, query: np.ndarray, at: int) -> np.ndarray:
        """(parts, codes) squared distances from a query's residual in list `at`."""
        r = query - self.centers[at]
        out = np.full((len(self.books), max(len(b) for b in self.books)), np.inf, np.float32)
        for p, ((a, b), book) in enumerate(zip(self.cuts, self.books, strict=True)):
            out[p, : len(book)] = ((book - r[a:b]) ** 2).sum(axis=1)
        return out

    def tuned(self, sample: np.ndarray, k: int, cover: float = COVER) -> tuple[int, int]:
        """Lists to probe, and entries of the sample to compare, so that `cover` of the k nearest in the sample are among them."""
        tried, (near, codes) = sample[:TRIED], self.encode(sample)
        rows, itself = np.arange(len(tried))[:, None], np.arange(len(tried))
        distance = (sample**2).sum(axis=1) / 2 - tried @ sample.T
        distance[itself, itself] = np.inf
        found = np.argsort(distance, axis=1)[:, : min(k, max(len(sample) - 1, 1))]
        order = np.argsort((self.centers**2).sum(axis=1) / 2 - tried @ self.centers.T, axis=1)
        lists = np.argsort(order, axis=1)[rows, near[found]]
        known = self.centers[near] + np.concatenate([book[codes[:, p]] for p, book in enumerate(self.books)], axis=1)
        distance = (known**2).sum(axis=1) / 2 - tried @ known.T
        distance[itself, itself] = np.inf
        entries = np.argsort(np.argsort(distance, axis=1), axis=1)[rows, found]
        return int(np.quantile(lists, cover, method="higher")) + 1, int(np.quantile(entries, cover, method="higher")) + 1


def usable(column: str = "embedding") -> Column:
    ok = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(column).isNotNull() & (F.size(column) > 0) & ok & F.exists(column, lambda x: x != 0), F.lit(False))


def _vectors(batch: pa.RecordBatch, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("vec").to_pylist()), kind).reshape(batch.num_rows, -1).astype(np.float32)


def _raw(column: pa.ListArray, kind: str) -> tuple[bytes, int]:
    """Components of vectors of equal length, one after the other, and bytes of a vector."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind) + np.dtype(kind).type(0)  # -0 is 0
    return values.tobytes(), values.nbytes // max(len(column), 1)


def _join_equal(k: int, kind: str):
    """Equal vectors of a batch become one row with their k + 1 smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, width = _raw(batch.column("embedding"), kind)
            by: dict[bytes, list[int]] = {}
            for i, v in enumerate(batch.column("vec_id").to_pylist()):
                by.setdefault(raw[i * width : (i + 1) * width], []).append(v)
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.binary()), pa.array([sorted(set(v))[: k + 1] for v in by.values()], pa.list_(pa.int64()))], names=["vec", "ids"])

    return run


def distinct_vectors(rows: DataFrame, dimension: int, k: int, kind: str = "<f4") -> DataFrame:
    """(uid, vec, ids): each vector once, with the k + 1 smallest of its ids."""
    least = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, k + 1)
    joined = rows.where(usable() & F.col("vec_id").isNotNull() & (F.size("embedding") == dimension)).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_join_equal(k, kind), "vec binary, ids array<long>")
    # two levels: what is left of a very large group is gathered in parts first
    salted = joined.groupBy("vec", F.pmod(F.spark_partition_id(), F.lit(64)).alias("part")).agg(least("ids").alias("ids"))
    return salted.groupBy("vec").agg(least("ids").alias("ids")).select(F.xxhash64("vec").alias("uid"), "vec", "ids")


def _assign(index: Index, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near, codes = index.encode(_vectors(batch, kind))
                yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(near.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["uid", "list", "code"])

    return run


def _probe(index: Index, counts: np.ndarray, probes: int, enough: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids, out = _vectors(batch, kind), batch.column("query_id").to_pylist(), []
            for q, v in zip(ids, x, strict=True):
                order = np.argsort(((index.centers - v) ** 2).sum(axis=1), kind="stable")
                need = max(probes, int(np.searchsorted(np.cumsum(counts[order]), enough)) + 1)
                out += [(q, int(at), v.tobytes()) for at in order[:need] if counts[at]]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["query_id", "list", "vec"])

    return run


def _best(distance: np.ndarray, uid: np.ndarray, n: int) -> np.ndarray:
    if len(distance) > n:
        at = np.flatnonzero(distance <= np.partition(distance, n - 1)[n - 1])
    else:
        at = np.arange(len(distance))
    return at[np.lexsort((uid[at], distance[at]))][:n]


def _search(index: Index, rerank: int):
    """Rows sorted by (list, block, kind): a block's entries (kind 0), then queries; the best of each query in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, uids, codes, flat = None, [], [], None
        for batch in batches:
            out = []
            for list_, block, kind, uid, raw in zip(*(batch.column(c).to_pylist() for c in ("list", "block", "kind", "uid", "raw")), strict=True):
                if at != (list_, block):
                    at, uids, codes, flat = (list_, block), [], [], None
                if kind == 0:
                    uids.append(uid)
                    codes.append(raw)
                    continue
                if not uids:
                    continue
                if flat is None:
                    own = np.array(uids, np.int64)
                    flat = np.frombuffer(b"".join(codes), np.uint8).reshape(len(uids), -1).T.astype(np.int64)
                tables = index.table(np.frombuffer(raw, "<f4"), list_)
                distance = np.zeros(len(own), np.float32)
                for p in range(len(tables)):
                    distance += tables[p][flat[p]]
                best = _best(distance, own, rerank)
                out.append((uid, own[best].tobytes(), distance[best].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["query_id", "uids", "distances"])

    return run


def _shortlist(rerank: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for q, u, d in zip(*(batch.column(c).to_pylist() for c in ("query_id", "uids", "distances")), strict=True):
                u, d = np.frombuffer(u, np.int64), np.frombuffer(d, np.float32)
                if q in kept:
                    u, d = np.concatenate([kept[q][0], u]), np.concatenate([kept[q][1], d])
                best = _best(d, u, rerank)
                kept[q] = u[best], d[best]
        for q, (u, _) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(u), pa.int64()), pa.array(u)], names=["query_id", "uid"])

    return run


def _exact(k: int, kind: str):
    """Rows sorted by query: exact distances to the shortlist, and the k nearest ids."""

    def results(query: int, got: list[tuple[bytes, bytes, list[int]]]) -> list[tuple[int, int, int, float]]:
        v = np.frombuffer(got[0][0], kind).astype(np.float64)
        x = np.frombuffer(b"".join(g[1] for g in got), kind).reshape(len(got), -1).astype(np.float64)
        distance = np.sqrt(((x - v) ** 2).sum(axis=1))
        found = sorted((float(d), i) for d, g in zip(distance, got, strict=True) for i in g[2] if i != query)[:k]
        return [(query, r + 1, i, d) for r, (d, i) in enumerate(found)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, got, out = None, [], []
        for batch in batches:
            for q, vec, other, ids in zip(*(batch.column(c).to_pylist() for c in ("query_id", "vec", "other", "ids")), strict=True):
                if q != query:
                    out += results(query, got) if got else []
                    query, got = q, []
                got.append((vec, other, ids))
        out += results(query, got) if got else []
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.float64()))], names=["query_id", "rank", "vec_id", "score"])

    return run


def nearest_neighbours(rows: DataFrame, is_query: Column, k: int = K, probes: int = PROBES, rerank: int = RERANK, exact: bool = False) -> DataFrame:
    """rows (vec_id, embedding) -> (query_id, rank, vec_id, score) for the rows that are queries; probes and rerank are least numbers."""
    spark = rows.sparkSession
    prepare(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    kind = "<f4" if dict(rows.dtypes)["embedding"] == "array<float>" else "<f8"
    rows = rows.select("vec_id", F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"), is_query.alias("is_query"))
    lengths = rows.where(usable() & F.col("vec_id").isNotNull()).groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    unique = stored(distinct_vectors(rows, lengths.d, k, kind), "vectors")
    total = unique.count()
    lists = int(min(LISTS, max(1, total**0.5)))
    least = unique.select(F.hash("uid", F.lit(1)).alias("h"), "uid").orderBy("h", "uid").limit(min(TRAIN, max(SHARE * lists, 4096)))
    sample = unique.join(F.broadcast(least), "uid").orderBy("h", "uid").select("vec").collect()  # at most TRAIN rows
    sample = np.frombuffer(b"".join(r.vec for r in sample), kind).reshape(len(sample), -1).astype(np.float32)
    index = Index.fit(sample, lists)
    lists, compared = index.tuned(sample, k)
    probes, rerank = max(probes, lists), max(rerank, min(MOST, -(-compared * total // len(sample))))
    if exact:
        probes, rerank = len(index.centers), total
    entries = stored(unique.select("uid", "vec").mapInArrow(_assign(index, kind), "uid long, list int, code binary"), "vector-codes")
    counts = np.zeros(len(index.centers), np.int64)
    for r in entries.groupBy("list").count().collect():  # at most LISTS rows
        counts[r.list] = r["count"]
    blocks = spark.createDataFrame([(i, int(-(-n // BLOCK))) for i, n in enumerate(counts.tolist()) if n], "list int, blocks int")
    asked = rows.where(F.col("is_query") & usable() & F.col("vec_id").isNotNull() & (F.size("embedding") == lengths.d)).select(F.col("vec_id").cast("long").alias("query_id"), "embedding")

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, n = _raw(b.column("embedding"), kind)
            yield pa.RecordBatch.from_arrays([b.column("query_id"), pa.array([raw[i * n : (i + 1) * n] for i in range(b.num_rows)], pa.binary())], names=["query_id", "vec"])

    queries = stored(asked.mapInArrow(flat, "query_id long, vec binary").groupBy("query_id").agg(F.min("vec").alias("vec")), "vector-queries")
    probed = queries.mapInArrow(_probe(index, counts, probes, 4 * rerank, kind), "query_id long, list int, vec binary")
    sized = F.broadcast(blocks)  # at most LISTS rows
    left = entries.join(sized, "list").select("list", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("kind"), "uid", F.col("code").alias("raw"))
    right = probed.join(sized, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), F.col("query_id").alias("uid"), F.col("vec").alias("raw"))
    n = partitions(entries)
    met = left.unionByName(right).repartition(n, "list", "block").sortWithinPartitions("list", "block", "kind", "uid")
    found = met.mapInArrow(_search(index, rerank), "query_id long, uids binary, distances binary")
    short = found.repartition(n, "query_id").mapInArrow(_shortlist(rerank), "query_id long, uid long")
    pairs = short.join(unique.select("uid", F.col("vec").alias("other"), "ids"), "uid").join(queries, "query_id")
    return pairs.repartition(n, "query_id").sortWithinPartitions("query_id", "uid").mapInArrow(_exact(k, kind), schema)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0), "nearest")
