"""Removal of repeated byte strings, by merged Burrows-Wheeler transforms of shards.

A byte goes if a WIDTH-byte string that covers it also starts earlier (smaller doc_id, or the same document
and an earlier start); strings are judged on the input. All repeats are read off transforms of shards, merged by
refining the interleave of the shards: each round distributes it by the transformed symbols, which sorts by one symbol
more, and a boundary that first shows in round h has a common prefix of h - 1 symbols. Suffixes are never sorted again.
A shard is what one batch of one task sends; the merge joins shards of all tasks. There are two levels of symbols:

1. Every WIDTH-byte window has an anchor, the least hash of the GRAM-byte strings in it (the last one of
   equals); equal windows have equal anchors at equal offsets. Windows with one anchor make a block, the string
   (anchor, content). Each shard has its transform; it sends the first of its equal blocks. In the merged transforms an
   interval with a common prefix of two symbols is a block that repeats as a whole, all but its first place. An
   interval with one common symbol and several contents sends the texts of its first places on. Blocks whose
   anchor stands alone can't repeat; that is all that is filtered out.
2. These texts are strings of super-symbols (STEP bytes each), again with a transform for each shard that sent
   some. After WIDTH / STEP rounds the intervals without boundary are the repeated windows of all shards. In an
   interval all but the first window repeat.

The covered spans are joined to the documents. Blocks travel in packed columns. An anchor with more than CROWDED
contents sends single windows, spread by their first symbol. Symbols are 64-bit hashes: of anchors and contents on the
first level (two for each block), of super-symbols on the second (five for each window).

Defined cases: null text is empty; null doc_id comes last; rows of equal doc_id and different text are
documents of their own, ordered by text hash; repeated rows (equal id and text) are one document, and each
gets its result; an empty table gives no rows; other columns are kept by `deduplicated` and clash with nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat_text, mix64, pack, partitions, powers, prepare, release_memory, settled, stored, table, unpack, writers

WIDTH, GRAM, STEP = 100, 24, 20
SPAN = WIDTH - GRAM + 1
SLICE, UNIT, CROWDED = 1 << 19, 1_500_000, 50_000
LAST = (1 << 63) - 1
_U = np.uint64
ROUTED = "kind int, bucket int, blob binary, did long, tie long, a long, b long"
_ROUTED = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary()), ("did", pa.int64()), ("tie", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
FOUND = "kind int, did long, tie long, a long, b long, key long, crowded boolean"
_FOUND = pa.schema([("kind", pa.int32()), ("did", pa.int64()), ("tie", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("crowded", pa.bool_())])
SPANS = "did long, tie long, a long, b long"
_SPANS = pa.schema([("did", pa.int64()), ("tie", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
BLOCK = ["<u8", "<u8", "<i8", "<i8", "<u4", "<u1"]  # key, content, did, tie, first window, windows


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one number."""
    n = len(data) - 7
    out, raw = np.empty(max(n, 0), _U), data.tobytes()
    for r in range(min(8, max(n, 0))):
        out[r::8] = np.frombuffer(raw, "<u8", count=len(out[r::8]), offset=r)
    return out


def gram_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of GRAM-byte strings from mixed eight-byte words."""
    n = max(len(words) - GRAM + 8, 0)
    out = words[:n] * _U(0xBF58476D1CE4E5B9)
    for k in range(8, GRAM, 8):
        out += words[k : k + n]
        out ^= out >> _U(32)
        out *= _U(0x94D049BB133111EB)
    out ^= out >> _U(29)
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, step = len(x) - width + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:n], x[width - step : width - step + n]) if step < width else x


def blocks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks of texts that lie one after the other: key, content hash, text number, first window, windows."""
    sizes = np.diff(offsets)
    n = len(data) - WIDTH + 1
    if n <= 0:
        return tuple(np.empty(0, d) for d in (_U, _U, np.int64, np.int64, np.int64))
    words = mix64(words8(data))
    grams = gram_hashes(words)
    least = sliding_min(grams, SPAN)[:n]
    inside = np.zeros(n + 1, np.int8)  # windows that lie in one text
    long_ = sizes >= WIDTH
    np.add.at(inside, offsets[:-1][long_], 1)
    np.add.at(inside, offsets[1:][long_] - WIDTH + 1, -1)
    valid = np.cumsum(inside[:n]) > 0
    cut = np.empty(n, bool)
    cut[0] = True
    cut[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
    cut |= grams[SPAN - 1 : SPAN - 1 + n] == least  # a new last anchor
    firsts = offsets[:-1][long_]
    cut[firsts[firsts < n]] = True
    lo = np.flatnonzero(cut)
    hi = np.append(lo[1:], n)
    keep = valid[lo]
    lo, hi = lo[keep], hi[keep]
    power, inverse = powers(len(words) + 1)
    running = np.zeros(len(words) + 1, _U)
    np.cumsum(words * power[: len(words)], out=running[1:])
    end = hi + WIDTH - 1 - 8  # words that lie in the block
    content = mix64((running[end + 1] - running[lo]) * inverse[lo] + (hi - lo).astype(_U))
    owner = np.searchsorted(offsets, lo, side="right") - 1
    return least[lo], content, owner, lo - offsets[owner], hi - lo


def _table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def join_spans(owner: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of one owner become one. Sorted by owner, then a."""
    if not len(a):
        return owner, a, b
    reach = np.maximum.accumulate(b + owner * (1 << 40)) - owner * (1 << 40)
    new = np.ones(len(a), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (a[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return owner[at], a[at], np.maximum.reduceat(b, at)


def _find_blocks(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = pa.Table.from_batches([batch]).sort_by([("did", "ascending"), ("tie", "ascending")]).combine_chunks()
            data, offsets = flat_text(batch.column("text"))
            did, tie = (batch.column(c).to_numpy() for c in ("did", "tie"))
            same = np.zeros(len(did), bool)
            same[1:] = (did[1:] == did[:-1]) & (tie[1:] == tie[:-1])
            parts, k = [], 0
            while k < len(did):
                to = max(k + 1, int(np.searchsorted(offsets, offsets[k] + SLICE, side="right")) - 1)
                key, content, owner, lo, cnt = blocks(data[offsets[k] : offsets[to]], offsets[k : to + 1] - offsets[k])
                ok = ~same[owner + k]
                parts.append((key[ok], content[ok], owner[ok] + k, lo[ok], cnt[ok]))
                k = to
            if not parts:
                continue
            key, content, owner, lo, cnt = (np.concatenate(x) for x in zip(*parts, strict=True))
            order, _, whole = merged_blocks(key, content, np.zeros(len(key), np.int32))
            # blocks are numbered in order of document and place: the least of an interval is its first
            starts = np.flatnonzero(np.diff(whole, prepend=-1))
            first = np.minimum.reduceat(order, starts) if len(order) else order
            again = np.ones(len(key), bool)
            again[first] = False
            o, a, b = join_spans(owner[again], lo[again], lo[again] + cnt[again] + WIDTH - 1)
            if len(o):  # these rows only pass through: they are spread evenly, the same way in every attempt
                spread = mix64((did[o] ^ a).view(_U) + np.arange(len(o), dtype=_U)) % _U(buckets)
                yield _table(_ROUTED, kind=np.ones(len(o), np.int32), bucket=spread.astype(np.int32), did=did[o], tie=tie[o], a=a, b=b)
            to = ((key[first] >> _U(32)) % _U(buckets)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            first, to = first[order], to[order]
            edges = np.flatnonzero(np.diff(to, prepend=-1))
            blobs = []
            for x in np.split(first, edges[1:]):
                blobs.append(pack(key[x], content[x], did[owner[x]], tie[owner[x]], lo[x].astype("<u4"), cnt[x].astype("<u1")))
            if len(edges):
                yield _table(_ROUTED, kind=np.zeros(len(edges), np.int32), bucket=to[edges], blob=blobs)
        release_memory()

    return run


def _merge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All blocks of an anchor are in one partition: repeats of whole blocks, and requests for texts."""
    got = []
    for batch in batches:
        known = batch.column("kind").to_numpy() == 1
        if known.any():
            t = batch.filter(pa.array(known))
            yield _table(_FOUND, kind=np.ones(len(t), np.int32), **{c: t.column(c).to_numpy() for c in ("did", "tie", "a", "b")})
        got += [unpack(x, BLOCK) for x in batch.column("blob").to_pylist() if x is not None]
    if not got:
        return
    shard = np.repeat(np.arange(len(got), dtype=np.int32), [len(x[0]) for x in got])
    key, content, did, tie, lo, cnt = (np.concatenate(x) for x in zip(*got, strict=True))
    del got
    order, anchor, whole = merged_blocks(key, content, shard)
    # places that share their anchor with another one, each interval in order of document and place
    many = np.bincount(anchor)[anchor] > 1 if len(anchor) else np.zeros(0, bool)
    order, anchor, whole = order[many], anchor[many], whole[many]
    key, did, tie, lo, cnt = (x[order] for x in (key, did, tie, lo.astype(np.int64), cnt.astype(np.int64)))
    order = np.lexsort((lo, tie, did, whole))
    key, did, tie, lo, cnt, anchor, whole = (x[order] for x in (key, did, tie, lo, cnt, anchor, whole))
    first = np.diff(whole, prepend=-1) != 0
    twin = ~first & (np.diff(did, prepend=-1) == 0) & (np.diff(tie, prepend=0) == 0) & (np.diff(lo, prepend=-1) == 0)  # a repeated row
    again = np.flatnonzero(~first & ~twin)
    for k in range(0, len(again), 100_000):
        x = again[k : k + 100_000]
        yield _table(_FOUND, kind=np.ones(len(x), np.int32), did=did[x], tie=tie[x], a=lo[x], b=lo[x] + cnt[x] + WIDTH - 1)
    at = np.flatnonzero(first)
    contents = np.bincount(anchor[at])[anchor[at]] if len(at) else at
    ask = at[contents > 1]
    crowded = contents[contents > 1] > CROWDED
    for k in range(0, len(ask), 100_000):
        x = ask[k : k + 100_000]
        yield _table(_FOUND, kind=np.full(len(x), 2, np.int32), did=did[x], tie=tie[x], a=lo[x], b=cnt[x], key=key[x].view(np.int64), crowded=crowded[k : k + 100_000])
    release_memory()


TEXT = ["<u8", "<i8", "<i8", "<i8", "<u1"]  # key, did, tie, first window, windows; texts follow


def _send_texts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            for did, tie, text, asked in zip(*(batch.column(c).to_pylist() for c in ("did", "tie", "text", "asked")), strict=True):
                text = text.encode()
                for r in asked:
                    if r["crowded"]:  # single windows, spread by their first symbol
                        for p in range(r["a"], r["a"] + r["b"]):
                            piece = text[p : p + WIDTH]
                            rows.append((int.from_bytes(hashlib.blake2b(piece[:STEP], digest_size=8).digest(), "little"), did, tie, p, 1))
                            texts.append(piece)
                    else:
                        rows.append((r["key"] & (1 << 64) - 1, did, tie, r["a"], r["b"]))
                        texts.append(text[r["a"] : r["a"] + r["b"] + WIDTH - 1])
            if not rows:
                continue
            cols = [np.array(c, d) for c, d in zip(zip(*rows, strict=True), TEXT, strict=True)]
            to = ((cols[0] >> _U(32)) % _U(buckets)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            edges = np.flatnonzero(np.diff(to[order], prepend=-1))
            blobs = [pack(*(c[x] for c in cols)) + b"".join([texts[i] for i in x.tolist()]) for x in np.split(order, edges[1:])]
            yield _table(_ROUTED, kind=np.zeros(len(edges), np.int32), bucket=to[order][edges], blob=blobs)
        release_memory()

    return run


def _by_symbol(ranks: np.ndarray) -> np.ndarray:
    """Stable order by rank: one or two passes of a distribution sort."""
    order = np.argsort((ranks & 0xFFFF).astype(np.uint16), kind="stable")
    if len(ranks) and int(ranks.max()) > 0xFFFF:
        order = order[np.argsort((ranks >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def _by_shard(shard: np.ndarray) -> np.ndarray:
    return np.argsort(shard.astype(np.uint16) if len(shard) and int(shard.max()) <= 0xFFFF else shard, kind="stable")


class Transforms:
    """Burrows-Wheeler transforms of strings of symbols to a depth: one for each shard, one after the other."""

    def __init__(self, positions: np.ndarray, shard: np.ndarray, symbol: np.ndarray, before: np.ndarray, depth: int):
        """By position: its shard; its symbol's rank (-1: the end of a string); the position one symbol earlier, or -1."""
        ends = positions[symbol[positions] < 0]
        ends = ends[_by_shard(shard[ends])]
        order = np.concatenate([ends, positions[symbol[positions] >= 0]])
        for _ in range(depth):
            earlier = before[order]
            earlier = earlier[earlier >= 0]
            order = np.concatenate([ends, earlier[_by_symbol(symbol[earlier])]])
        order = order[_by_shard(shard[order])]
        self.positions, self.shard, self.ends, self.depth = order, shard[order], shard[ends], depth
        earlier = before[order]
        self.bwt = np.where(earlier >= 0, symbol[earlier], -1)


def merge(t: Transforms) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all shards in merged order, and the common prefix with the one before, in symbols (at most the depth)."""
    z, n, n_ends = t.shard, len(t.shard), len(t.ends)
    interval, common = np.zeros(n, np.int32), np.full(n, t.depth, np.int8)
    for h in range(1, t.depth + 1):
        turned = np.empty(n, np.int32)
        turned[_by_shard(z)] = t.bwt
        goes = np.flatnonzero(turned >= 0)
        goes = goes[_by_symbol(turned[goes])]
        z = np.concatenate([t.ends, z[goes]])
        sym, old = turned[goes], interval[goes]
        edge = np.ones(n, bool)
        edge[n_ends + 1 :] = (sym[1:] != sym[:-1]) | (old[1:] != old[:-1])
        common[edge & (common == t.depth)] = h - 1
        interval = np.cumsum(edge, dtype=np.int32)
    out = np.empty(n, t.positions.dtype)
    out[_by_shard(z)] = t.positions
    return out, common


def merged_blocks(key: np.ndarray, content: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings (key, content) of all shards: their numbers in merged order, and there the intervals of one and of two common symbols."""
    n = len(key)
    symbol = np.full(3 * n, -1, np.int32)
    rank = np.unique(np.concatenate([key, content]), return_inverse=True)[1].astype(np.int32)
    symbol[0::3], symbol[1::3] = rank[:n], rank[n:]
    positions = np.arange(3 * n, dtype=np.int32)
    before = np.where(positions % 3 > 0, positions - 1, -1).astype(np.int32)
    merged, common = merge(Transforms(positions, np.repeat(shard, 3), symbol, before, 2))
    starts = merged % 3 == 0
    return merged[starts] // 3, np.cumsum(common < 1)[starts], np.cumsum(common < 2)[starts]


def repeated_windows(data: np.ndarray, starts: np.ndarray, cnt: np.ndarray, rank: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of cnt + WIDTH - 1 bytes from `starts` on, by shard: (text, window) of windows that a text of smaller rank has too."""
    size = cnt + WIDTH - 1
    slots = size + 1
    base = np.concatenate([[0], np.cumsum(slots)])
    owner = np.repeat(np.arange(len(cnt), dtype=np.int32), slots)
    at = (np.arange(base[-1]) - base[owner]).astype(np.int32)
    used = at % STEP < cnt[owner]  # strings that no window starts are left out
    place = np.flatnonzero(used & (at + STEP <= size[owner]))
    src = starts[owner[place]] + at[place]
    words = words8(np.concatenate([data, np.zeros(8, np.uint8)]))
    h = mix64(words[src])
    h = mix64(h * _U(3) + words[src + 8])
    h = mix64(h * _U(5) + words[src + STEP - 8])
    symbol = np.full(base[-1], -1, np.int32)
    symbol[place] = np.unique(h, return_inverse=True)[1]
    del words, src, h, place
    before = np.where(at >= STEP, np.arange(base[-1], dtype=np.int32) - STEP, -1).astype(np.int32)
    merged, common = merge(Transforms(np.flatnonzero(used).astype(np.int32), shard[owner], symbol, before, WIDTH // STEP))
    first = np.flatnonzero(common < WIDTH // STEP)
    ranks = rank[owner[merged]]
    least = np.repeat(np.minimum.reduceat(ranks, first), np.diff(np.append(first, len(merged))))
    again = np.sort(merged[ranks > least])
    return owner[again].astype(np.int64), at[again].astype(np.int64)


def _merge_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got, texts = [], []
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            cols = unpack(blob, TEXT)
            got.append(cols)
            texts.append(blob[8 + sum(c.nbytes for c in cols) :])
    if not got:
        return
    shard = np.repeat(np.arange(len(got), dtype=np.int32), [len(x[0]) for x in got])
    key, did, tie, lo, cnt = (np.concatenate(x) for x in zip(*got, strict=True))
    cnt, lo = cnt.astype(np.int64), lo.astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    del texts, got
    starts = np.concatenate([[0], np.cumsum(cnt + WIDTH - 1)])[:-1]
    order = np.lexsort((lo, tie, did, key))
    twin = np.zeros(len(order), bool)
    for c in (key, did, tie, lo):
        twin |= np.diff(c[order], prepend=c[order][:1] + c.dtype.type(1)) != 0
    order = order[twin]  # repeated rows have sent their texts twice
    key, did, tie, lo, cnt, starts, shard = (x[order] for x in (key, did, tie, lo, cnt, starts, shard))
    edges = np.append(np.flatnonzero(np.diff(key, prepend=key[:1] + _U(1))), len(key))
    weight, k = np.concatenate([[0], np.cumsum(cnt + WIDTH)]), 0
    while k < len(edges) - 1:  # units of whole keys
        to = max(k + 1, int(np.searchsorted(weight[edges], weight[edges[k]] + UNIT, side="right")) - 1)
        x = slice(edges[k], edges[to])
        size = cnt[x] + WIDTH - 1
        at = np.concatenate([[0], np.cumsum(size)])
        own = data[np.repeat(starts[x] - at[:-1], size) + np.arange(at[-1])]
        rank = np.empty(len(size), np.int64)
        rank[np.lexsort((lo[x], tie[x], did[x]))] = np.arange(len(size))
        text, window = repeated_windows(own, at[:-1], cnt[x], rank, np.unique(shard[x], return_inverse=True)[1].astype(np.int32))
        text, a, b = join_spans(text, window, window + WIDTH)
        if len(text):
            yield _table(_SPANS, did=did[x][text], tie=tie[x][text], a=lo[x][text] + a, b=lo[x][text] + b)
        k = to
    release_memory()


def _identity() -> tuple[Column, Column]:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"), F.xxhash64("text").alias("tie")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(did, tie, spans): a document's repeated spans, in any order, as they were found."""
    prepare(docs.sparkSession)
    rows, files = docs.where(F.col("text").isNotNull()).select(*_identity(), "text"), writers(docs)
    n = partitions(rows)

    def spans() -> DataFrame:
        found = stored(rows.mapInArrow(_find_blocks(n), ROUTED).repartition(n, "bucket").mapInArrow(_merge_blocks, FOUND), "repeat-blocks", files)
        asked = found.where("kind = 2").groupBy("did", "tie").agg(F.collect_list(F.struct("a", "b", "key", "crowded")).alias("asked"))
        sent = rows.join(asked, ["did", "tie"]).mapInArrow(_send_texts(n), ROUTED)
        return found.where("kind = 1").select("did", "tie", "a", "b").unionByName(sent.repartition(n, "bucket").mapInArrow(_merge_texts, SPANS))

    return settled(spans, "repeat-spans", files).groupBy("did", "tie").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def cut(text: bytes, spans: list[dict] | None, whole_characters: bool) -> tuple[bytes, int, int]:
    """What stays of a text, bytes removed, and removed runs."""
    if not spans:
        return text, 0, 0
    a, b = (np.array([s[c] for s in spans], np.int64) for c in "ab")
    order = np.argsort(a, kind="stable")
    _, a, b = join_spans(np.zeros(len(a), np.int64), a[order], b[order])
    out, at, removed, runs = [], 0, 0, 0
    for s, e in zip(a.tolist(), b.tolist(), strict=True):
        if whole_characters:  # a character that is covered in part stays
            while s < e and text[s] & 0xC0 == 0x80:
                s += 1
            while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
                e -= 1
        if s < e:
            out.append(text[at:s])
            at, removed, runs = e, removed + e - s, runs + 1
    return b"".join([*out, text[at:]]), removed, runs


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
            text = (text or "").encode()
            kept, removed, runs = cut(text, spans, False)
            rows.append((doc_id, len(text), removed, runs, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _with_spans(docs: DataFrame, *columns: Column | str) -> DataFrame:
    spans = repeated_spans(docs)
    return docs.select(*columns, "text", *_identity()).join(spans, ["did", "tie"], "left")


def removal_report(docs: DataFrame) -> DataFrame:
    """Per document: bytes, removed bytes and runs, and the hash of what stays."""
    rows = _with_spans(docs, "doc_id").select("doc_id", "text", "spans")
    return rows.mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with repeated spans cut out of `text`, whole characters at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [None if t is None else cut(t.encode(), s, True)[0].decode() for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string())], names=["row", "kept"])

    rest = [c for c in docs.columns if c != "text"]
    rows = _with_spans(docs, F.struct(*rest).alias("row"), "doc_id").select("row", "text", "spans")
    out = rows.mapInArrow(run, rows.select("row").schema.add("kept", "string"))
    return out.select(*[F.col("kept").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(table(spark, sf_dir, "documents"))


#: Windows are cut from pieces of 64, these from parts of 2,048, so that no long text is sliced for each window.
OP2_SQL = """
WITH b AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h, octet_length(encode(COALESCE(text, ''))) AS n FROM documents),
l AS (SELECT doc_id, h, n, unnest(range(0, n - 99, 2048)) AS c FROM b WHERE n >= 100),
m AS (SELECT doc_id, n, c, substr(h, 2 * c + 1, 2 * (2048 + 99)) AS part FROM l),
o AS (SELECT doc_id, n, c, part, unnest(range(0, least(2048, n - 99 - c), 64)) AS d FROM m),
q AS (SELECT doc_id, n, c + d AS c, substr(part, 2 * d + 1, 2 * (64 + 99)) AS piece FROM o),
x AS (SELECT doc_id, c, piece, unnest(range(0, least(64, n - 99 - c))) AS i FROM q),
w AS (SELECT doc_id, c + i AS p, md5_number(substr(piece, 2 * i + 1, 200)) AS content FROM x),
f AS (SELECT content, MIN((doc_id, p)) AS first FROM w GROUP BY content HAVING COUNT(*) > 1),
r AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new FROM w JOIN f USING (content) WHERE (doc_id, p) <> first),
i AS (SELECT doc_id, p, SUM(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM r),
s AS (SELECT doc_id, run, MIN(p) AS a, MAX(p) + 100 AS e FROM i GROUP BY doc_id, run),
g AS (SELECT doc_id, a, COALESCE(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since, e, lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS final FROM s),
c AS (SELECT b.doc_id, COUNT(g.a) AS n_spans, CAST(COALESCE(SUM(g.e - g.a), 0) AS BIGINT) AS n_removed,
             string_agg(substr(h, 2 * since + 1, 2 * (a - since)) || CASE WHEN final THEN substr(h, 2 * e + 1) ELSE '' END, '' ORDER BY a) AS kept FROM b LEFT JOIN g ON g.doc_id = b.doc_id GROUP BY b.doc_id)
SELECT doc_id, n AS n_bytes, n_removed, n_spans, sha256(unhex(COALESCE(kept, h))) AS kept_sha256 FROM b JOIN c USING (doc_id)"""
