"""Protect, call a user's model function, release: and the audit rows of each step, without values."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..plans.policy import Policy
from .detect import Detection
from .protect import protect, release


def prompt(data: object, instructions: str | None = None) -> list[dict]:
    """Messages of a request: structured data as JSON of two spaces."""
    body = data if isinstance(data, str) else json.dumps(data, indent=2, ensure_ascii=False)
    return [*([{"role": "system", "content": instructions}] if instructions else []), {"role": "user", "content": body}]


def generate(requests: DataFrame, model: Callable[[str], str], policy: Policy | str | dict | None = None, how: Detection | None = None) -> DataFrame:
    """Requests that are blocked or withheld never reach the model; answers are released to their own session."""
    results, mappings = protect(requests, policy, how)
    call = F.arrow_udf(lambda texts: pa.array([None if t is None else model(t) for t in texts.to_pylist()], pa.string()), StringType())
    asked = results.where("safe_text is not null").select(F.col("request_id").alias("response_id"), "session_id", call("safe_text").alias("text"))
    back = release(asked, mappings, policy, how)
    return results.select("request_id", "status").join(back.select(F.col("response_id").alias("request_id"), F.col("status").alias("answer_status"), "data", "restored", "unrestored"), "request_id", "left")


# Names of audit events.
EVENTS = ["REQUEST_RECEIVED", "ENTITY_PROTECTED", "REQUEST_BLOCKED", "REQUEST_COMPLETED", "OUTPUT_ENTITY_DETECTED", "OUTPUT_BLOCKED", "TOKENS_RESTORED", "SESSION_CREATED", "SESSION_DESTROYED"]


def audit(decided: DataFrame, results: DataFrame) -> DataFrame:
    """Append-only rows: an event for each entity and request, never a value."""
    one = decided.where("kept").select(F.lit("ENTITY_PROTECTED").alias("event"), "request_id", "session_id", "type", F.upper("action").alias("action"), F.round("confidence", 3).alias("confidence"), F.lit(1).cast("long").alias("n"))
    null = lambda t: F.lit(None).cast(t)
    two = results.select(F.when(F.col("status") == "blocked", "REQUEST_BLOCKED").otherwise("REQUEST_COMPLETED").alias("event"), "request_id", "session_id", null("string").alias("type"), null("string").alias("action"), null("double").alias("confidence"), F.col("total").cast("long").alias("n"))
    return one.unionByName(two)
