"""Near-duplicate components by a join on rare prefix n-grams.

1. A fixed-size count sketch over all documents says how frequent n-grams are; sets are sorted rare first
   (sketch level, then hash), the same way everywhere.
2. A set that can reach the threshold shares one of its first n - ceil(t n) + 1 n-grams with its partner.
   These prefixes, with length and position, meet by n-gram; equal sets are one node from the start.
3. Pairs that pass the length and positional filters are candidates: all pairs of small groups, in large
   groups the pairs with LEADERS members. Every candidate is verified once, behind the suffix filter.
4. Linked nodes get labels (alternating large and small stars). In large groups only pairs of nodes with
   different labels are left; these are verified against blocks of the larger component. No pair that
   passes the filters is left out, and none is made inside a component.

N-grams travel as 56-bit hashes in packed columns. The sketch (4 MB) and a filter of ids (1 MB) are all that is broadcast, at any input size.
Defined cases: null or blank text has an empty set and links with nothing (component_id is its doc_id); fewer
words than n make one n-gram; rows of equal doc_id are documents of their own; null doc_ids count in no
component's minimum, a component of such rows alone has a null id; an empty table gives no rows. `representatives`
decides row by row and keeps the other columns: of each component one row stays, whatever ids its rows have.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat_text, mix64, pack, partitions, powers, prepare, release_memory, settled, stored, table, unpack, writers

N_WORDS, PERCENT = 5, 80
CELLS, CHUNKS, SLICE = 1 << 22, 16, 1 << 19
CELL_SHIFT = 56 - 22
SMALL, LEADERS, BLOCK, GUESTS = 4, 3, 64, 1024
#: Buckets of a set's histogram for the first suffix filter, bytes of an n-gram in a shipped set, most bits of the filter of wanted ids.
BUCKETS, GRAM_BYTES, MOST_BITS = 128, 6, 1 << 26
#: From this rarity level on (4 times the logarithm of the count, here 2^18) an n-gram's sets are dealt over parts; sets of a part in the last step.
HOT_LEVEL, PART, SALTS = 72, 4096, 32
_U = np.uint64
_MIX = [_U(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
ENTRY = ["<u8", "<u8", "<u4", "<u4"]  # n-gram, node, set size, position
PAIR = ["<u8", "<u8"]
ROUTED = "kind int, bucket int, blob binary, doc_id long, key long, node long, n long, shape binary"
_ROUTED = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary()), ("doc_id", pa.int64()), ("key", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("shape", pa.binary())])


def _rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def shingles(data: np.ndarray, offsets: np.ndarray, n_words: int = N_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """56-bit hashes of the n-grams of texts that lie one after the other, with repeats, and their offsets."""
    n_docs = len(offsets) - 1
    if not len(data):
        return np.empty(0, _U), np.zeros(n_docs + 1, np.int64)
    x = data.copy()
    x[(x >= 65) & (x <= 90)] += 32
    word = (x != 32) & ((x < 9) | (x > 13))
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = word[edge]
    ends[edge - 1] = word[edge - 1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = powers(len(x) + 1)
    running = np.zeros(len(x) + 1, _U)
    np.cumsum((x.astype(_U) + _U(1)) * power[: len(x)], out=running[1:])
    words = mix64((running[end] - running[begin]) * inverse[begin] + (end - begin).astype(_U) * _MIX[0])
    first = np.searchsorted(begin, offsets)  # words before each text
    count = np.diff(first)
    grams = np.where(count >= n_words, count - n_words + 1, np.minimum(count, 1))
    out_offsets = np.concatenate([[0], np.cumsum(grams)])
    at = np.arange(out_offsets[-1]) + np.repeat(first[:-1] - out_offsets[:-1], grams)
    length = np.repeat(np.minimum(count, n_words), grams)
    total, padded = length.astype(_U) * _MIX[-1], np.concatenate([words, np.zeros(n_words, _U)])
    for j in range(n_words):
        part = padded[at + j] * _MIX[j % 7] + _U(j // 7)
        total += part if (length > j).all() else np.where(length > j, part, _U(0))
    return mix64(total) >> _U(8), out_offsets


def _slices(text: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = flat_text(text)
    k = 0
    while k < len(offsets) - 1:
        to = max(k + 1, int(np.searchsorted(offsets, offsets[k] + SLICE, side="right")) - 1)
        yield k, to, data[offsets[k] : offsets[to]], offsets[k : to + 1] - offsets[k]
        k = to


def _sketch(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, wait, waiting = np.zeros(CELLS, np.uint32), [], 0
        for batch in batches:
            for _, _, data, offsets in _slices(batch.column("text")):
                wait.append((shingles(data, offsets, n_words)[0] >> _U(CELL_SHIFT)).astype(np.int32))
                waiting += len(wait[-1])
                if waiting > CELLS:
                    counts += np.bincount(np.concatenate(wait), minlength=CELLS).astype(np.uint32)
                    wait, waiting = [], 0
        if wait:
            counts += np.bincount(np.concatenate(wait), minlength=CELLS).astype(np.uint32)
        release_memory()
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([zlib.compress(c.astype("<u2").tobytes(), 1) for c in np.split(np.minimum(counts, 0xFFFF), CHUNKS)])], names=["chunk", "counts"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(zlib.decompress(blob), "<u2").astype(np.int64)
    for chunk, c in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.minimum(c, 0xFFFFFFFF).astype("<u4").tobytes()])], names=["chunk", "counts"])


def rarity_levels(rows: DataFrame, n_words: int) -> np.ndarray:
    """A level for each cell of the count sketch over all rows: 0 where n-grams are as rare as most. A task's counts stop at 65,535."""
    parts = rows.select("text").mapInArrow(_sketch(n_words), "chunk int, counts binary")
    counts, width = np.zeros(CELLS, np.uint32), CELLS // CHUNKS
    for r in parts.repartition(CHUNKS, "chunk").mapInArrow(_add_up, "chunk int, counts binary").collect():  # CHUNKS rows, 16 MB in all
        counts[r.chunk * width : (r.chunk + 1) * width] = np.frombuffer(r.counts, "<u4")
    usual, levels = 2 * int(np.median(counts)) + 16, np.zeros(CELLS, np.uint8)
    for k in range(0, CELLS, width):
        above = np.maximum(counts[k : k + width].astype(np.int64) - usual, 0)
        levels[k : k + width] = np.floor(4 * np.log2(1 + above)).clip(0, 255)
    del counts
    release_memory()
    return levels


def _sets(text, levels: np.ndarray, n_words: int) -> Iterator[tuple[int, np.ndarray]]:
    """Text number and its set, sorted rare first: level in the upper eight bits, hash below."""
    for k, to, data, offsets in _slices(text):
        h, at = shingles(data, offsets, n_words)
        h |= levels[(h >> _U(CELL_SHIFT)).astype(np.int64)].astype(_U) << _U(56)
        for i in range(to - k):
            x = np.sort(h[at[i] : at[i + 1]])
            if len(x) > 1:
                x = x[np.concatenate([[True], x[1:] != x[:-1]])]
            yield k + i, x


def node_of(x: np.ndarray) -> int:
    """A set's 64-bit name; equal sets have equal names."""
    return (int(mix64(x * _MIX[1]).sum()) * int(_MIX[2]) + len(x) * int(_MIX[3])) & (1 << 64) - 1


def shape_of(x: np.ndarray) -> bytes:
    """How many n-grams of a set fall into each of BUCKETS hash ranges; 255 stands for any number from there on."""
    return np.minimum(np.bincount((x & _U(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def _prefixes(buckets: int, levels: np.ndarray, n_words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, seen, parts, shapes = np.zeros(batch.num_rows, _U), np.zeros(batch.num_rows, np.int64), set(), [], [None] * batch.num_rows
            for i, x in _sets(batch.column("text"), levels, n_words):
                if not len(x):
                    continue
                nodes[i], sizes[i] = node, n = node_of(x), len(x)
                if node not in seen:
                    seen.add(node)
                    shapes[i] = shape_of(x)
                    parts.append((x[: n + (-percent * n) // 100 + 1], node, n))
            # these rows only pass through: they are spread evenly, the same way in every attempt
            spread = mix64(np.arange(batch.num_rows, dtype=_U) + nodes) % _U(buckets)
            yield _rows(_ROUTED, kind=np.ones(batch.num_rows, np.int32), bucket=spread.astype(np.int32), doc_id=batch.column("doc_id"), key=batch.column("key"), node=nodes.view(np.int64), n=sizes, shape=shapes)
            if not parts:
                continue
            length = np.array([len(p[0]) for p in parts])
            gram = np.concatenate([p[0] for p in parts])
            node, n = (np.repeat(np.array([p[c] for p in parts], d), length) for c, d in ((1, _U), (2, np.uint32)))
            pos = (np.arange(len(gram)) - np.repeat(np.cumsum(length) - length, length)).astype(np.uint32)
            to = (mix64(gram + _part(gram, node)) % _U(buckets)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            edges = np.flatnonzero(np.diff(to[order], prepend=-1))
            blobs = [pack(gram[x], node[x], n[x], pos[x]) for x in np.split(order, edges[1:])]
            yield _rows(_ROUTED, kind=np.zeros(len(edges), np.int32), bucket=to[order][edges], blob=blobs)
        release_memory()

    return run


def _part(gram: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The part of a very frequent n-gram that a node belongs to; 0 for all others."""
    level = (gram >> _U(56)).astype(np.int64)
    hot = np.flatnonzero(level >= HOT_LEVEL)
    part = np.zeros(len(gram), _U)
    part[hot] = mix64(node[hot] ^ _MIX[5]) % (_U(2) << ((level[hot] - HOT_LEVEL) // 4).astype(_U))
    return part


def passes(na, pa_, nb, pb, percent: int):
    """Length and positional filters at a shared n-gram."""
    na, nb = na.astype(np.int64), nb.astype(np.int64)
    short, long_ = np.minimum(na, nb), np.maximum(na, nb)
    need = -(-percent * (na + nb) // (100 + percent))
    return (100 * short >= percent * long_) & (1 + np.minimum(na - pa_ - 1, nb - pb - 1) >= need)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...] | pa.RecordBatch]:
    """Passes on rows without entries; then yields sorted entries of groups (n-gram and part) of two nodes or more, or of split n-grams, and group starts."""
    got = []
    for batch in batches:
        rest = batch.filter(pc.not_equal(batch.column("kind"), 0))
        if rest.num_rows:
            yield rest
        got += [unpack(b, ENTRY) for b in batch.column("blob").to_pylist() if b is not None]
    if not got:
        return
    gram, node, n, pos = (np.concatenate(x) for x in zip(*got, strict=True))
    del got
    group = gram + _part(gram, node)
    split = (gram >> _U(56)) >= _U(HOT_LEVEL)
    order = np.argsort(group, kind="stable")
    sorted_ = group[order]
    lone = ~split[order]
    lone[1:] &= sorted_[1:] != sorted_[:-1]
    lone[:-1] &= sorted_[1:] != sorted_[:-1]
    order = order[~lone]
    order = order[np.lexsort((node[order], gram[order], group[order]))]
    group, gram, node, n, pos, split = (x[order] for x in (group, gram, node, n, pos, split))
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (gram[1:] != gram[:-1])
    keep = new.copy()
    keep[1:] |= node[1:] != node[:-1]
    number = np.cumsum(new)[keep]
    gram, node, n, pos, split = (x[keep] for x in (gram, node, n, pos, split))
    size = np.bincount(number)[number] if len(number) else number
    keep = (size > 1) | split
    gram, node, n, pos, number = (x[keep] for x in (gram, node, n, pos, number))
    start = np.flatnonzero(np.diff(number, prepend=0))
    yield gram, node, n.astype(np.int64), pos.astype(np.int64), start, np.diff(np.append(start, len(gram)))


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, first = np.unique(mix64(a * _MIX[4]) ^ b, return_index=True)
    return a[first], b[first]


def _candidates(buckets: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in _groups(batches):
            if isinstance(got, pa.RecordBatch):
                yield got
                continue
            gram, node, n, pos, start, size = got
            pa_, pb = [], []
            for d in range(1, SMALL + 1):  # partner d places before; in large groups the first LEADERS members are all partners
                i = np.arange(d, len(gram))
                rank = i - np.repeat(start, size)[i]
                i = i[(rank >= d) & (np.repeat(size, size)[i] <= SMALL)]
                ok = passes(n[i], pos[i], n[i - d], pos[i - d], percent)
                pa_.append(node[i[ok] - d])
                pb.append(node[i[ok]])
            many = np.repeat(size > SMALL, size)
            at = np.flatnonzero(many)
            for k in range(LEADERS):
                lead = np.repeat(start + k, size)[at]
                i, lead = at[at > lead], lead[at > lead]
                ok = passes(n[i], pos[i], n[lead], pos[lead], percent)
                pa_.append(node[lead[ok]])
                pb.append(node[i[ok]])
            a, b = _unique_pairs(np.concatenate(pa_), np.concatenate(pb))
            to = (mix64(a) % _U(buckets)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            edges = np.flatnonzero(np.diff(to[order], prepend=-1))
            if len(edges):
                yield _rows(_ROUTED, kind=np.full(len(edges), 2, np.int32), bucket=to[order][edges], blob=[pack(a[x], b[x]) for x in np.split(order, edges[1:])])
            # pairs with leaders are candidates already; those of a split n-gram's leaders only inside their part
            rank = np.arange(len(gram)) - np.repeat(start, size)
            rest = np.flatnonzero((many & (rank >= LEADERS)) | ((gram >> _U(56)) >= _U(HOT_LEVEL)))
            if len(rest):
                yield _rows(_ROUTED, kind=np.array([3], np.int32), bucket=np.array([0], np.int32), blob=[pack(gram[rest], node[rest], n[rest].astype("<u4"), pos[rest].astype("<u4"))])
        release_memory()

    return run


def _distinct_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [unpack(b, PAIR) for batch in batches for b in batch.column("blob").to_pylist()]
    if got:
        a, b = _unique_pairs(*(np.concatenate(x) for x in zip(*got, strict=True)))
        for k in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[k : k + 100_000].view(np.int64)), pa.array(b[k : k + 100_000].view(np.int64))], names=["host", "guest"])
    release_memory()


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            gram, node, n, pos = unpack(blob, ENTRY)
            for k in range(0, len(gram), 100_000):
                x = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(gram[x].view(np.int64)), pa.array(node[x].view(np.int64)), pa.array(n[x].astype(np.int64)), pa.array(pos[x].astype(np.int64))], names=["gram", "node", "n", "pos"])


def _shapes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BUCKETS)


def _overlap_possible(a: np.ndarray, b: np.ndarray, na, nb, percent: int) -> np.ndarray:
    """Suffix filter by histograms: sets share at most the sum of the lesser counts. A full bucket (255) has no bound."""
    full = ((a == 255) & (b == 255)).any(axis=-1)
    return full | (np.minimum(a, b).sum(axis=-1, dtype=np.int64) >= -(-percent * (na + nb) // (100 + percent)))


CROSS = ("gram", "band", "salt", "guest", "node", "n", "pos", "label", "members")


def banded(known: DataFrame, percent: int, n: int) -> DataFrame:
    """Entries of n-grams whose nodes have unlike labels, sorted by (n-gram, band, salt), hosts before guests.

    A small group is one part, whose entries are hosts and guests at once (guest null). In a large one the sets of a band are
    hosts in one part each, and guests in all parts of their own band and the next: set sizes of a pair differ by one band at most.
    """
    unlike = known.groupBy("gram").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("gram", "size")
    # the sets of one n-gram are dealt over SALTS tasks to learn their number
    unlike = unlike.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = known.withColumn("deal", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(unlike.hint("merge"), ["gram", "deal"])
    lit = lambda v, t: F.lit(v).cast(t)
    small = rows.where(F.col("size") <= PART).select("*", lit(-1, "int").alias("band"), lit(0, "int").alias("salt"), lit(None, "int").alias("guest"))
    large = rows.where(F.col("size") > PART).withColumn("band", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("int"))
    salts = large.groupBy("gram", "band").agg(F.ceil(F.count("*") / PART).cast("int").alias("salts"))
    large = large.join(salts.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge"), ["gram", "band", "deal"])
    hosts = large.select("*", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), lit(0, "int").alias("guest"))
    own = large.select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), lit(1, "int").alias("guest"))
    above = salts.select("gram", (F.col("band") - 1).alias("band"), F.col("salts").alias("above"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("deal"))
    next_ = large.join(above.hint("merge"), ["gram", "band", "deal"]).withColumn("band", F.col("band") + 1).select("*", F.explode(F.sequence(F.lit(0), F.col("above") - 1)).alias("salt"), lit(2, "int").alias("guest"))
    cols = [*CROSS, "shape"]
    out = small.select(*cols).unionByName(hosts.select(*cols)).unionByName(own.select(*cols)).unionByName(next_.select(*cols))
    return out.repartition(n, "gram", "band", "salt").sortWithinPartitions("gram", "band", "salt", "guest", "node")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of CROSS and shapes, part by part; only one part is held at a time."""
    held: list[tuple[list[np.ndarray], np.ndarray]] = []

    def joined():
        return [np.concatenate(x) for x in zip(*(c for c, _ in held), strict=True)], np.concatenate([s for _, s in held])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols, shape = [batch.column(c).fill_null(-1).to_numpy(zero_copy_only=False) for c in CROSS], _shapes(batch.column("shape"))
        new = np.ones(len(shape), bool)
        new[1:] = (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)
        edges = np.append(np.flatnonzero(new), len(shape))
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part = [c[s:e] for c in cols], shape[s:e]
            if held and any(held[0][0][k][0] != part[0][k][0] for k in range(3)):
                yield joined()
                held = []
            held.append(part)
    if held:
        yield joined()


def _cross(percent: int):
    """Sorted parts of large groups -> (host label, block, guest): pairs of unlike labels that pass the filters; the larger component is the host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, _, guest, node, n, pos, label, members), shape in _parts(batches):
            guests = np.flatnonzero(guest != 0)
            found: set[tuple[int, int, int]] = set()
            for i in np.flatnonzero(guest <= 0).tolist():
                others = guests[label[guests] != label[i]]
                if guest[i] < 0:  # hosts and guests at once: each pair comes up twice, and counts where i is of the larger component
                    others = others[(members[others] < members[i]) | ((members[others] == members[i]) & (label[others] < label[i]))]
                others = others[passes(n[others], pos[others], np.array(n[i]), pos[i], percent)]
                others = others[_overlap_possible(shape[others], shape[i], n[others], n[i], percent)]
                for j in others.tolist():
                    big, small = (i, j) if (members[i], label[i]) > (members[j], label[j]) else (j, i)
                    found.add((int(label[big]), int(node[big]) % -(-int(members[big]) // BLOCK), int(node[small])))
                if len(found) > 100_000:
                    yield _triples(found)
                    found = set()
            if found:
                yield _triples(found)
        release_memory()

    return run


def _triples(found: set[tuple[int, int, int]]) -> pa.RecordBatch:
    cols = np.array(sorted(found), np.int64).T
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["host", "block", "guest"])


def _by_shape(percent: int):
    """Pairs whose histograms allow the overlap that the threshold asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            ok = _overlap_possible(_shapes(batch.column("a")), _shapes(batch.column("b")), na, nb, percent)
            yield batch.filter(pa.array(ok)).select(["host", "guest"])

    return run


def likely(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """rows whose column may be in wanted: a filter of eight bits or more for each wanted value; a join follows, which is exact. Very many values get no filter."""
    count = wanted.count()
    bits = 1 << max(16, (8 * count - 1).bit_length())
    if bits > MOST_BITS:
        return rows
    at = F.pmod(F.xxhash64(column), F.lit(bits)).cast("int")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(bits, bool)
        for batch in batches:
            mine[batch.column("h").to_numpy()] = True
        if mine.any():
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.packbits(mine).tobytes()])], names=["chunk", "bits"])

    total = np.zeros(bits // 8, np.uint8)
    for r in wanted.select(at.alias("h")).coalesce(max(1, (1 << 26) // bits)).mapInArrow(mark, "chunk int, bits binary").collect():  # 8 MB in all
        total |= np.frombuffer(r.bits, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("__at").to_numpy()
            yield batch.filter(pa.array((total[h >> 3] >> (7 - (h & 7)).astype(np.uint8)) & 1 == 1)).drop_columns(["__at"])
        release_memory()

    return rows.withColumn("__at", at).mapInArrow(run, rows.schema)


def _ship(x: np.ndarray) -> bytes:
    """A set by the lower 48 bits of its hashes, sorted."""
    low = np.sort(x & _U((1 << 8 * GRAM_BYTES) - 1))
    return np.ascontiguousarray(low.view(np.uint8).reshape(-1, 8)[:, :GRAM_BYTES]).tobytes()


def _unship(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // GRAM_BYTES, 8), np.uint8)
    out[:, :GRAM_BYTES] = np.frombuffer(blob, np.uint8).reshape(-1, GRAM_BYTES)
    return out.view("<u8").ravel()


def suffix_filter(x: np.ndarray, y: np.ndarray, most: int, depth: int = 2) -> int:
    """A lower bound of the symmetric difference of sorted sets: halves are compared by size around a pivot."""
    least = abs(len(x) - len(y))
    if depth == 0 or not len(x) or not len(y) or least > most:
        return least
    mid = len(y) // 2
    cut = int(np.searchsorted(x, y[mid]))
    has = int(cut < len(x) and x[cut] == y[mid])
    left = suffix_filter(x[:cut], y[:mid], most, depth - 1)
    right = suffix_filter(x[cut + has :], y[mid + 1 :], most - left, depth - 1)
    return left + right + 1 - has


def _verify(percent: int):
    """Rows sorted by (host, block, salt, kind): the members of a host's block (kind 0), then its guests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members, index = None, [], None
        for batch in batches:
            links = []
            for host, block, salt, kind, node, blob in zip(*(batch.column(c).to_pylist() for c in ("host", "block", "salt", "kind", "node", "grams")), strict=True):
                if at != (host, block, salt):
                    at, members, index = (host, block, salt), [], None
                x = _unship(blob)
                if kind == 0:
                    members.append((node, x))
                    continue
                if index is None and len(members) > 1:
                    grams, owner = np.concatenate([m[1] for m in members]), np.repeat(np.arange(len(members), dtype=np.int32), [len(m[1]) for m in members])
                    order = np.argsort(grams, kind="stable")
                    index = grams[order], owner[order], np.array([len(m[1]) for m in members])
                if len(members) == 1:
                    y = members[0][1]
                    total = len(x) + len(y)
                    need = -(-percent * total // (100 + percent))
                    if suffix_filter(x, y, total - 2 * need) > total - 2 * need:
                        continue
                    spot = np.searchsorted(y, x)
                    if int((y[np.minimum(spot, len(y) - 1)] == x).sum()) >= need:
                        links.append((members[0][0], node))
                elif members:
                    grams, owner, sizes = index
                    lo, hi = np.searchsorted(grams, x), np.searchsorted(grams, x, side="right")
                    n = hi - lo
                    hits = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    shared = np.bincount(owner[hits], minlength=len(sizes))
                    ok = np.flatnonzero(shared * (100 + percent) >= percent * (sizes + len(x)))
                    if len(ok):  # one link joins the guest to the component
                        links.append((members[int(ok[0])][0], node))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in links], pa.int64()) for c in (0, 1)], names=["a", "b"])
        release_memory()

    return run


def verified(candidates: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """candidates (host, block, guest), members (host, block, node), sets (node, grams) -> links (a, b)."""
    load = candidates.groupBy("host", "block").agg(F.ceil(F.count("*") / GUESTS).cast("int").alias("salts"))
    hosts = members.join(load, ["host", "block"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    hosts = hosts.join(sets.hint("merge"), "node").select("host", "block", "salt", F.lit(0).alias("kind"), "node", "grams")
    guests = candidates.join(load, ["host", "block"]).withColumn("salt", F.pmod(F.xxhash64("guest"), F.col("salts")).cast("int"))
    guests = guests.withColumnRenamed("guest", "node").join(sets.hint("merge"), "node").select("host", "block", "salt", F.lit(1).alias("kind"), "node", "grams")
    rows = hosts.unionByName(guests).repartition(partitions(sets), "host", "block", "salt").sortWithinPartitions("host", "block", "salt", "kind", "node")
    return rows.mapInArrow(_verify(percent), "a long, b long")


def components(links: DataFrame, label: str) -> DataFrame:
    """(a, b) -> (node, label): the least node of its component, for nodes with links. Alternating stars."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), f"{label}-0", writers(links))
    check, k = None, 0
    files = max(2 * links.sparkSession.sparkContext.defaultParallelism, edges.count() >> 20)  # the edges never get more
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # every node now points at smaller ones; each of these goes to the least
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v")).where("u != v").distinct()
        k += 1
        edges = stored(small, f"{label}-{k}", files)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_if(F.col("u") == F.col("v"))).first())
        if now == check:
            break
        check = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def near_duplicates(docs: DataFrame, n_words: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, key, node, n_shingles, label): a row for each row of docs; key is a hash of the text, label null where there is no link."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    n = partitions(rows)
    levels = rarity_levels(rows, n_words)
    made = rows.mapInArrow(_prefixes(n, levels, n_words, percent), ROUTED).repartition(n, "bucket").mapInArrow(_candidates(n, percent), ROUTED)
    files = writers(rows)
    made = stored(made, "join-groups", files)
    names = made.where("kind = 1").select("doc_id", "key", "node", "n", "shape")
    pairs = stored(made.where("kind = 2").select("bucket", "blob").repartition(n, "bucket").mapInArrow(_distinct_pairs, "host long, guest long"), "join-pairs", files)
    entries = made.where("kind = 3").select("blob").mapInArrow(_entries, "gram long, node long, n long, pos long")
    # the text that stands for a node: of the least id (nulls last), then of the least hash
    first = F.min(F.struct(F.isnull("doc_id").alias("last"), F.coalesce("doc_id", F.lit(0)).alias("did"), "key")).alias("first")
    nodes = names.where("n > 0").groupBy("node").agg(first, F.first("shape", True).alias("shape"), F.max("n").alias("n"))
    nodes = stored(nodes.select("node", "first.*", "shape", "n"), "join-nodes", files)
    # sides that grow with the input are merged at every size, never broadcast
    shaped = pairs.hint("merge").join(nodes.select(F.col("node").alias("host"), F.col("shape").alias("a"), F.col("n").alias("na")), "host")
    shaped = shaped.hint("merge").join(nodes.select(F.col("node").alias("guest"), F.col("shape").alias("b"), F.col("n").alias("nb")), "guest")
    pairs = stored(shaped.select("host", "guest", "a", "b", "na", "nb").mapInArrow(_by_shape(percent), "host long, guest long"), "join-pairs", files)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            got, blobs, ask = [], [], batch.column("node").to_pylist()
            for i, x in _sets(batch.column("text"), levels, n_words):
                if len(x) and ask[i] not in seen and node_of(x) == ask[i] & (1 << 64) - 1:  # texts of one id and hash may still differ
                    seen.add(ask[i])
                    got.append(ask[i])
                    blobs.append(_ship(x))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), pa.array(blobs, pa.binary())], names=["node", "grams"])
        release_memory()

    named = rows.select(F.isnull("doc_id").alias("last"), F.coalesce("doc_id", F.lit(0)).alias("did"), "key", "text")

    def sets_of(wanted: DataFrame, label: str) -> DataFrame:
        wanted = stored(nodes.join(wanted.hint("merge"), "node").select("node", "last", "did", "key"), f"{label}-wanted", files)
        texts = likely(named, wanted, "key")
        return stored(texts.join(wanted.hint("merge"), ["last", "did", "key"]).select("node", "text").mapInArrow(build, "node long, grams binary"), label, files)

    sets = sets_of(pairs.select(F.explode(F.array("host", "guest")).alias("node")).distinct(), "join-sets")
    alone = pairs.select("host", F.lit(0).cast("long").alias("block"), F.col("host").alias("node")).distinct()
    links = stored(verified(pairs.withColumn("block", F.lit(0).cast("long")), alone, sets, percent), "join-links", files)
    labels = components(links, "join-labels")
    sized = labels.join(labels.groupBy("label").agg(F.count("*").alias("members")), "label")
    sized = stored(sized, "join-sized", files)
    known = entries.join(sized.hint("merge"), "node", "left").select("gram", "node", "n", "pos", F.coalesce("label", "node").alias("label"), F.coalesce("members", F.lit(1)).cast("long").alias("members"))
    known = known.join(nodes.select("node", "shape").hint("merge"), "node")
    cross = stored(banded(known, percent, n).mapInArrow(_cross(percent), "host long, block long, guest long").distinct(), "join-cross", files)
    block = F.pmod(F.col("node"), F.ceil(F.col("members") / BLOCK).cast("long"))
    hosts = cross.select("host").distinct()
    inside = hosts.join(sized, hosts.host == sized.label).select("host", block.alias("block"), "node")
    single = hosts.join(sized, hosts.host == sized.label, "left_anti").select("host", F.lit(0).cast("long").alias("block"), F.col("host").alias("node"))
    hosts = stored(inside.unionByName(single).join(cross.select("host", "block").distinct(), ["host", "block"]), "join-hosts", files)
    missing = hosts.select("node").unionByName(cross.select(F.col("guest").alias("node"))).distinct().join(sets.select("node"), "node", "left_anti")
    sets = sets.unionByName(sets_of(missing, "join-more-sets"))
    more = verified(cross, hosts, sets, percent)
    final = components(links.unionByName(stored(more, "join-more", files)), "join-final")
    return names.join(final, "node", "left").select("doc_id", "key", "node", F.col("n").alias("n_shingles"), "label")


def document_components(docs: DataFrame, **how) -> DataFrame:
    """Per row of docs: doc_id, n_shingles and component_id."""
    found = settled(lambda: near_duplicates(docs, **how), "join-named", writers(docs)).withColumn("group", F.coalesce("label", "node"))
    least = found.where("n_shingles > 0").groupBy("group").agg(F.min("doc_id").alias("least"))
    joined = found.join(least, "group", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame, **how) -> DataFrame:
    """docs without near duplicates: of each component one row stays, that of the least id (nulls last), then of the least set and text.

    Rows of one id and text stand for each other: where they have to give one row, the other columns decide. Rows without an n-gram stay.
    """

    def decided() -> DataFrame:
        """(doc_id, key, several): texts whose rows go, or of which one row stays."""
        found = near_duplicates(docs, **how).where("n_shingles > 0").withColumn("group", F.coalesce("label", "node"))
        texts = stored(found.groupBy("group", "node", "doc_id", "key").agg(F.count("*").alias("copies")), "join-texts", writers(docs))
        best = texts.groupBy("group").agg(F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "node", "key", "copies")).alias("best"))
        best = stored(best.select("best.doc_id", "best.key", "best.copies"), "join-best", writers(docs))
        gone = texts.join(best, same(texts, best), "left_anti").select("doc_id", "key", F.lit(False).alias("several"))
        return gone.unionByName(best.where("copies > 1").select("doc_id", "key", F.lit(True).alias("several")))

    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["key"] == b["key"])
    apart = settled(decided, "join-apart", writers(docs))
    several = apart.where("several").select("doc_id", "key")
    apart = apart.select("doc_id", "key")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("key"))
    whole = rows.join(apart, same(rows, apart), "left_anti").select("doc.*")
    alike = likely(rows, several, "key")
    one = alike.join(several, same(alike, several), "left_semi").groupBy("doc_id", "key").agg(F.min_by("doc", F.to_json("doc")).alias("doc"))
    return whole.unionByName(one.select("doc.*"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_components(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM g),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * COUNT(*) >= 80 * (a.n + b.n - COUNT(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, MIN(b) AS b FROM reach GROUP BY a)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, LEAST(doc_id, COALESCE(least.b, doc_id)) AS component_id FROM g LEFT JOIN least ON least.a = g.doc_id"""
