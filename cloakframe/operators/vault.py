"""Encrypted mappings: values by AES-GCM, bound to session, token and type. The key comes as a one-row table, never as a literal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bound() -> Column:
    return F.concat_ws(":", F.col("session_id"), F.col("token"), F.col("type"), F.col("restorable").cast("string"))


def sealed(mappings: DataFrame, key: DataFrame) -> DataFrame:
    """key: one row (secret BINARY of 32 bytes). Every value gets its own random nonce."""
    secret = key.select("secret").limit(1).scalar()
    made = F.aes_encrypt(F.col("value"), secret, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), _bound())
    return mappings.withColumn("sealed", made).drop("value")


def opened(stored: DataFrame, key: DataFrame) -> DataFrame:
    """Values that the key opens; entries that were moved or changed are left out."""
    secret = key.select("secret").limit(1).scalar()
    value = F.try_aes_decrypt(F.col("sealed"), secret, F.lit("GCM"), F.lit("DEFAULT"), _bound()).cast("string")
    return stored.withColumn("value", value).where("value is not null").drop("sealed")


def unexpired(mappings: DataFrame, now: Column) -> DataFrame:
    return mappings.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
