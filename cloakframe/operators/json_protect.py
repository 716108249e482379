"""Protection of JSON columns: each document is a request of many segments."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.fields import field_type
from ..functions.values import spliced
from ..plans.policy import Policy, decide, resolve_policy
from ..sources.json_doc import hinted, rewritten, segments
from .detect import Detection, Scanner, entity_rows, entity_type
from .protect import NO_COUNTS, NO_NAMES, replaced, requests_summary, status_of

SEGMENTS = "request_id string, session_id string, seq long, seg_no int, field string, text string, entities array<struct<type:string,start:int,end:int,confidence:double,source:string,detector:string,rule:string,has_context:boolean,value:string,norm:string>>, warnings array<string>, incomplete boolean"
RESULT = "request_id string, session_id string, status string, safe_document string, total long, counts map<string,bigint>, risk string, removed array<string>, retained array<string>, tokenized array<string>, blocked_types array<string>, below_threshold long, warnings array<string>"


def _flatten(how: Detection, most_bytes: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(how)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                key = r["request_id"], r["session_id"], r["seq"]
                try:
                    if most_bytes is not None and len((r["document"] or "").encode()) > most_bytes:
                        raise ValueError("too large")
                    found = segments(r["document"]) if r["document"] is not None else []
                except (ValueError, RecursionError) as error:  # malformed or over the limits: a row that says so
                    reason = "not JSON" if isinstance(error, json.JSONDecodeError) else "too deep" if isinstance(error, RecursionError) else str(error)
                    out.append((*key, -1, None, None, [], [f"REFUSED:{reason}"], True))
                    continue
                for k, (text, field) in enumerate(found):
                    spans, warnings, part = scanner(text)
                    out.append((*key, k, field, text, entity_rows(hinted(text, field, spans, field_type), text, True), warnings, part))
                if not found:
                    out.append((*key, -1, None, None, [], [], False))
            types = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), entity_type(True), pa.list_(pa.string()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["request_id", "session_id", "seq", "seg_no", "field", "text", "entities", "warnings", "incomplete"])

    return run


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """safe_document for documents that may be given out (null: null)."""
    for batch in batches:
        made = []
        for document, edits, withheld in zip(*(batch.column(c).to_pylist() for c in ("document", "edits", "withheld")), strict=True):
            if withheld or document is None:
                made.append(None)
                continue
            by: dict[int, list[tuple[int, int, str]]] = {}
            for e in edits or []:
                by.setdefault(e["seg_no"], []).append((e["start"], e["end"], e["replacement"]))
            made.append(rewritten(document, [spliced(text, by.get(k, [])) for k, (text, _) in enumerate(segments(document))]))
        keep = [c for c in batch.schema.names if c not in ("document", "edits", "withheld")]
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()) if c == "safe_document" else batch.column(c) for c in keep], names=keep)


def protect_json(requests: DataFrame, policy: Policy | str | dict | None = None, how: Detection | None = None, most_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """requests (request_id, session_id, seq, document, optional purpose) -> (a result for each request, mappings).

    A result has status, safe_document, counts, risk, types by action, and warnings, as a text's result has. A null document gives a null
    one; a document that is no JSON, too deep, of too many nodes or too large is a row with a REFUSED warning, without a document.
    """
    p = resolve_policy(policy)
    asked = requests if "purpose" in requests.columns else requests.withColumn("purpose", F.lit(None).cast("string"))
    # each document is read and scanned once for all plans below
    parts = asked.select("request_id", "session_id", F.col("seq").cast("long").alias("seq"), "document").mapInArrow(_flatten(how or Detection(), most_bytes), SEGMENTS).persist(StorageLevel.MEMORY_AND_DISK)
    rows = parts.select("request_id", "session_id", "seq", "seg_no", F.explode("entities").alias("e")).select("request_id", "session_id", "seq", "seg_no", "e.*")
    if "purpose" in requests.columns:
        rows = rows.join(asked.select("request_id", "purpose"), "request_id")
    else:
        rows = rows.withColumn("purpose", F.lit(None).cast("string"))
    decided = decide(rows.withColumn("policy", F.lit(p.name)), [p])
    done, mappings = replaced(decided, parts.select("session_id", "text"))
    low = decided.where(~F.col("kept")).select("request_id")
    done = done.select("request_id", "seg_no", F.struct("seg_no", "start").alias("start"), F.col("start").alias("at"), "end", "type", "action", "replacement", "risk_rank", F.lit(True).alias("kept")).unionByName(low.withColumn("kept", F.lit(False)), allowMissingColumns=True)
    edit = F.when(F.col("replacement").isNotNull(), F.struct("seg_no", F.col("at").alias("start"), "end", "replacement"))
    per = requests_summary(done, edit)
    none = F.expr(NO_NAMES)
    told = parts.groupBy("request_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("warnings")))).alias("told"), F.bool_or("incomplete").alias("part"))
    out = requests.select("request_id", "session_id", "document").join(told, "request_id").join(per, "request_id", "left")
    status, withheld, warned = status_of(F.coalesce("has_block", F.lit(False)), F.col("part"), F.col("told"), p.fail_mode)
    lists = [F.coalesce(c, none).alias(c) for c in ("removed", "retained", "tokenized", "blocked_types")]
    out = out.select(
        "request_id", "session_id", status.alias("status"), F.lit(None).cast("string").alias("safe_document"), F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("counts", F.expr(NO_COUNTS)).alias("counts"),
        F.coalesce("risk", F.lit("NONE")).alias("risk"), *lists, F.coalesce("below_threshold", F.lit(0)).cast("long").alias("below_threshold"), warned.alias("warnings"), "document", "edits", withheld.alias("withheld"),
    )
    return out.mapInArrow(_rewrite, RESULT), mappings
