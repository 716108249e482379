"""Results as tables or files. Nothing that exists is written over."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("parquet", "json", "orc", "text")


def save_results(results: DataFrame, path: str, form: str = "parquet") -> None:
    """Results without anything that was withheld in part: `text` writes the safe texts alone, other formats all columns."""
    if form not in FORMATS:
        raise ValueError(f"one of {', '.join(FORMATS)}")
    rows = results.where("safe_text is not null").select("safe_text") if form == "text" else results
    rows.write.format(form).mode("errorifexists").save(path)


def save_files(files: DataFrame, folder: str, name: str = "request_id", content: str = "content") -> DataFrame:
    """One file for each row that has content, named by a hash of its key; (key, path, size) of what was written. Each attempt of a task writes the same bytes to the same names."""
    rows = files.where(F.col(content).isNotNull()).select(F.col(name).cast("string").alias("key"), F.sha2(F.col(name).cast("string"), 256).alias("file"), F.col(content).alias("content"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(folder)
        system.create_dir(at, recursive=True)
        for batch in batches:
            made = []
            for key, file, data in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "content")), strict=True):
                with system.open_output_stream(f"{at}/{file}") as out:
                    out.write(data)
                made.append((key, f"{folder}/{file}", len(data)))
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["key", "path", "size"])

    return rows.mapInArrow(write, "key string, path string, size long")
