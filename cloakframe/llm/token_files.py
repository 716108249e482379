"""Token-id files: one id array for each shard of documents, boundaries in Elias-Fano code.

`write_token_files` range-partitions documents by doc_id, sorts within each shard and streams ids to
`<name>.ids` (16-bit ids where the vocabulary allows it, else 32-bit). `<name>.idx` holds the boundaries
(n + 1 values, Elias-Fano) and the doc_ids. Each attempt of a task writes to names of its own; only the
manifest, which Spark commits, says which files count, so retried and speculative tasks leave nothing wrong.

Defined cases: null or empty text has the end id alone; null doc_id sorts last; rows that share a doc_id
are documents of their own, ordered by a hash of the text, then by text (nulls first); an empty table gives no
shards. Other columns are ignored. The range partitioner samples ids and hashes, never texts.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, prepare, release_memory, scratch, stored, table
from .eliasfano import EliasFano
from .tokens import encoder

END_ID = 2
MANIFEST = "shard int, n_docs long, n_tokens long, width int, ids_path string, idx_path string"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _writer(folder: str, tokenizer_path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        width = 2 if max(enc.vocab_size - 1, end_id) < 1 << 16 else 4
        end = np.array([end_id], dtype="<u4").tobytes()
        system, at = _open(folder)
        system.create_dir(at, recursive=True)
        name, out = uuid.uuid4().hex, None
        counts, doc_ids, valid, shard = [], [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or system.open_output_stream(f"{at}/{name}.ids")
            shard = batch.column("shard")[0].as_py()
            ids = [x + end for x in enc.encode(batch.column("text").to_pylist())]
            counts.append(np.array([len(x) // 4 for x in ids], dtype=np.int64))
            raw = np.frombuffer(b"".join(ids), dtype="<u4")
            out.write(raw.astype(f"<u{width}").tobytes() if width == 2 else raw.tobytes())
            d = batch.column("doc_id")
            doc_ids.append(d.fill_null(0).to_numpy(zero_copy_only=False))
            valid.append(d.is_valid().to_numpy(zero_copy_only=False))
        if out is None:
            return
        out.close()
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        ids, ok = np.concatenate(doc_ids).astype("<i8"), np.concatenate(valid)
        code = EliasFano.encode(bounds).to_bytes()
        with system.open_output_stream(f"{at}/{name}.idx") as f:
            f.write(len(code).to_bytes(8, "little") + code + zlib.compress(ids.tobytes() + np.packbits(ok).tobytes(), 1))
        row = {"shard": [shard], "n_docs": [len(ids)], "n_tokens": [int(bounds[-1])], "width": [width], "ids_path": [f"{folder}/{name}.ids"], "idx_path": [f"{folder}/{name}.idx"]}
        yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()), ("ids_path", pa.string()), ("idx_path", pa.string())]))
        release_memory()

    return write


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, shard_bytes: int = 32 << 20) -> DataFrame:
    """Writes the files below folder; returns the committed manifest, with base: ids of all shards before."""
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("hash").asc()]
    ranged = rows.repartitionByRange(partitions(rows, shard_bytes), *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    made = ranged.select("doc_id", "text", F.spark_partition_id().alias("shard")).mapInArrow(_writer(folder, tokenizer_path, end_id), MANIFEST)
    manifest = stored(made, "token-manifest")
    # a row for each shard: the window's one task holds as many rows as there are files
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("base", before)


class TokenShard:
    """A shard's files: document(i) and start(i) by select, without a table of offsets."""

    def __init__(self, ids_path: str, idx_path: str, width: int):
        system, at = _open(idx_path)
        with system.open_input_stream(at) as f:
            raw = f.read()
        n = int.from_bytes(raw[:8], "little")
        self.bounds = EliasFano.from_bytes(raw[8 : 8 + n])
        self.n = self.bounds.n - 1
        rest = zlib.decompress(raw[8 + n :])
        self.doc_ids = np.frombuffer(rest, "<i8", self.n)
        self.valid = np.unpackbits(np.frombuffer(rest, np.uint8, offset=8 * self.n), count=self.n).astype(bool)
        self.dtype = f"<u{width}"
        self.width = width
        system, at = _open(ids_path)
        self.file = system.open_input_file(at)

    def start(self, i: int) -> int:
        return self.bounds.select(i)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids from position a to b - 1 of the shard."""
        return np.frombuffer(self.file.read_at((b - a) * self.width, a * self.width), dtype=self.dtype).astype("<u4")

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.bounds.select(i), self.bounds.select(i + 1))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for m in batch.to_pylist():
            shard = TokenShard(m["ids_path"], m["idx_path"], m["width"])
            for k in range(0, shard.n, 2000):
                to = min(shard.n, k + 2000)
                bounds = shard.bounds.select_range(k, to + 1)
                ids, crc = memoryview(shard.ids(int(bounds[0]), int(bounds[-1]))).cast("B"), []
                for a, b in zip(((bounds[:-1] - bounds[0]) * 4).tolist(), ((bounds[1:] - bounds[0]) * 4).tolist(), strict=True):
                    crc.append(zlib.crc32(ids[a:b]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids[k:to], mask=~shard.valid[k:to]), pa.array(bounds[:-1] + m["base"]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def read_token_files(manifest: DataFrame) -> DataFrame:
    """A row for each document, from the files alone."""
    return manifest.repartition(partitions(manifest), "shard").mapInArrow(_read, DOCS)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return read_token_files(write_token_files(docs, scratch(spark, "token-files"), public_tokenizers.path("word_bpe_49k.json")))
