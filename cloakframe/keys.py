"""Keys of encrypted mappings: 32 bytes, from bytes, hex, Base64 or a passphrase. They go to Spark as one-row tables."""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import secrets

from pyspark.sql import DataFrame, SparkSession

KEY_BYTES, LEAST_PASSPHRASE = 32, 12
# Cost of the key derivation.
SCRYPT = {"n": 2**15, "r": 8, "p": 1, "maxmem": 64 << 20}


def new_key() -> bytes:
    return secrets.token_bytes(KEY_BYTES)


def key_of(value: bytes | str) -> bytes:
    """A key of 32 bytes, or its hex or Base64 form; anything else is refused, passphrases too."""
    if isinstance(value, str):
        try:
            value = bytes.fromhex(value) if re.fullmatch("[0-9a-fA-F]{64}", value) else base64.b64decode(value + "=" * (-len(value) % 4))
        except (ValueError, binascii.Error) as error:
            raise ValueError("a key is 32 bytes, hex or Base64") from error
    if len(value) != KEY_BYTES:
        raise ValueError(f"a key has {KEY_BYTES} bytes, not {len(value)}")
    return bytes(value)


def key_from_passphrase(passphrase: str, salt: bytes | str) -> bytes:
    if len(passphrase) < LEAST_PASSPHRASE:
        raise ValueError(f"a passphrase has at least {LEAST_PASSPHRASE} characters")
    return hashlib.scrypt(passphrase.encode(), salt=salt.encode() if isinstance(salt, str) else salt, dklen=KEY_BYTES, **SCRYPT)


def key_table(spark: SparkSession, key: bytes | str) -> DataFrame:
    """The one-row table (secret) that `sealed` and `opened` take."""
    return spark.createDataFrame([(bytearray(key_of(key)),)], "secret binary")
