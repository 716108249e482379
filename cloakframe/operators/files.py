"""Files as requests: `binaryFile` rows to text segments, and Word documents written back.

Texts of Word and PDF files are read here. Formats whose pixels need an engine that isn't there (OCR) go through
plug-ins: callables from bytes to text segments. Without a plug-in a file isn't inspected, says so, and is marked incomplete.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.storagelevel import StorageLevel

from ..functions.values import spliced
from ..plans.policy import Policy, decide, resolve_policy
from ..sources.docx import docx_apply, docx_read
from ..sources.pdf import pdf_pages
from ..sources.sniff import file_problem_col, format_col
from .detect import Detection, detect
from .protect import NO_NAMES, replaced, status_of

Extractor = Callable[[bytes], list[str]]
SEGMENTS = "request_id string, session_id string, seq long, format string, seg_no int, page int, text string, warning string"


def _extract(plugins: dict[str, Extractor]):
    def texts(kind: str, content: bytes) -> tuple[list[str], list[str]]:
        if kind == "zip":
            found, warnings = docx_read(content)
            return [s.text for s in found], warnings
        if kind in plugins:
            return plugins[kind](content), []
        if kind == "pdf":
            return pdf_pages(content)
        if kind == "unknown":
            try:
                return [content.decode()], []
            except UnicodeDecodeError:
                return [], ["DOCUMENT_STRUCTURE_UNSUPPORTED"]
        return [], ["OCR_UNAVAILABLE"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                try:
                    found, warnings = ([], [f"REFUSED:{r['problem']}"]) if r["problem"] else texts(r["format"], r["content"])
                except Exception as error:  # a file that can't be read is a row with a warning, whatever reads it
                    found, warnings = [], [f"REFUSED:{error if isinstance(error, ValueError) else type(error).__name__}"]
                out += [(r["request_id"], r["session_id"], r["seq"], r["format"], k, k + 1, t, None) for k, t in enumerate(found)]
                out += [(r["request_id"], r["session_id"], r["seq"], r["format"], -1, 0, None, w) for w in warnings]
                if not found and not warnings:  # a document without text
                    out.append((r["request_id"], r["session_id"], r["seq"], r["format"], -1, 0, None, None))
            types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=[c.split()[0] for c in SEGMENTS.split(", ")])

    return run


def file_segments(files: DataFrame, plugins: dict[str, Extractor] | None = None) -> DataFrame:
    """files (request_id, session_id, seq, path, content, optional mime) -> segments of text, and a row for each warning."""
    mime = F.col("mime") if "mime" in files.columns else F.lit(None).cast("string")
    rows = files.select("request_id", "session_id", F.col("seq").cast("long").alias("seq"), "content", format_col(F.col("content")).alias("format"), file_problem_col(F.col("content"), F.col("path"), mime).alias("problem"))
    return rows.mapInArrow(_extract(plugins or {}), SEGMENTS)


def protect_files(files: DataFrame, policy: Policy | str | dict | None = None, how: Detection | None = None, plugins: dict[str, Extractor] | None = None) -> tuple[DataFrame, DataFrame]:
    """(request_id, format, status, content, text, total, warnings), mappings.

    Word documents come back as documents, text as bytes; other formats give their protected text alone. What could not be read or scanned
    makes a file uncertain: with a policy that fails closed it is withheld, and a file that was refused or not scanned at all always is.
    """
    p = resolve_policy(policy)
    detected = detect(file_segments(files, plugins), how=how, values=True).persist(StorageLevel.MEMORY_AND_DISK)
    found = detected.select("request_id", "session_id", "seq", "seg_no", F.explode("entities").alias("e")).select("request_id", "session_id", "seq", "seg_no", "e.*")
    decided = decide(found.withColumn("policy", F.lit(p.name)).withColumn("purpose", F.lit(None).cast("string")), [p])
    done, mappings = replaced(decided, detected.select("session_id", "text").limit(0))
    per = done.groupBy("request_id").agg(F.collect_list(F.struct("seg_no", "start", "end", "replacement")).alias("edits"), F.bool_or(F.col("action") == "block").alias("blocked"), F.count("*").alias("total"))
    told = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(F.coalesce("warnings", F.expr(NO_NAMES)), F.filter(F.array("warning"), lambda w: w.isNotNull()))))))
    segments = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("seg_no", "text"))))
    seen = detected.groupBy("request_id").agg(F.max("format").alias("format"), told.alias("told"), segments.alias("segments"), F.bool_or("incomplete").alias("part"))
    rows = files.select("request_id", "content").join(seen, "request_id").join(per, "request_id", "left")
    status, withheld, told = status_of(F.coalesce("blocked", F.lit(False)), F.col("part") | (F.size("told") > 0), F.col("told"), p.fail_mode)
    rows = rows.select("request_id", "format", status.alias("status"), withheld.alias("withheld"), told.alias("warnings"), F.coalesce("total", F.lit(0)).alias("total"), "content", "segments", "edits")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                content = text = None
                if not r["withheld"]:
                    edits = [(e["seg_no"], e["start"], e["end"], e["replacement"]) for e in r["edits"] or [] if e["replacement"] is not None]
                    texts = [spliced(s["text"], [e[1:] for e in edits if e[0] == s["seg_no"]]) for s in r["segments"] if s is not None]
                    text = "\n\n".join(t for t in texts if t.strip())
                    if r["format"] == "zip":
                        content = docx_apply(r["content"], sorted(edits))
                    elif r["format"] == "unknown":
                        content = text.encode() if texts else None
                out.append((r["request_id"], r["format"], r["status"], content, text, r["total"], r["warnings"]))
            types = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["request_id", "format", "status", "content", "text", "total", "warnings"])

    return rows.mapInArrow(build, "request_id string, format string, status string, content binary, text string, total long, warnings array<string>"), mappings
