"""Warnings of requests as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_warnings(warnings: DataFrame) -> DataFrame:
    """(request_id, code, message, page, ord, ...): of equal warnings (code, message, page) of a request the first by ord stays."""
    rest = [c for c in warnings.columns if c not in ("request_id", "code", "message", "page")]
    first = F.min_by(F.struct(*rest), "ord").alias("first")
    return warnings.groupBy("request_id", "code", "message", "page").agg(first).select("request_id", "code", "message", "page", "first.*")
