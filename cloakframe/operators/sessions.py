"""Lives of sessions as columns of their mappings: use extends them, an end drops them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def touched(mappings: DataFrame, used: DataFrame, ttl_seconds: int) -> DataFrame:
    """used (session_id, used_at): a session's last use gives its mappings a whole life from then on.

    Mappings are rewritten only once less than half of their life is left, and never after it has ended.
    """
    last = used.groupBy("session_id").agg(F.max("used_at").alias("used_at"))
    rows = mappings.join(last, "session_id", "left")
    left = F.unix_timestamp("expires_at") - F.unix_timestamp("used_at")
    late = F.col("used_at").isNotNull() & (left >= 0) & (left < ttl_seconds / 2)
    return rows.withColumn("expires_at", F.when(late, F.timestamp_seconds(F.unix_timestamp("used_at") + ttl_seconds)).otherwise(F.col("expires_at"))).drop("used_at")


def destroyed(mappings: DataFrame, ended: DataFrame) -> DataFrame:
    """Without the mappings of ended sessions (session_id): their tokens can't be restored any more."""
    return mappings.join(ended.select("session_id").distinct(), "session_id", "left_anti")
