"""Normal forms of values, tokens, markers and pseudonyms."""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# How values of a type are compared.
LOWER = {"EMAIL", "UPI_ID", "URL", "INTERNAL_URL", "USERNAME", "PERSON", "ADDRESS", "HEALTHCARE_PROVIDER"}
DIGITS = {"PHONE", "AADHAAR", "CREDIT_CARD", "SSN", "BANK_ACCOUNT"}
COMPACT = {"IBAN", "PAN", "PASSPORT", "MAC_ADDRESS"}
# Fictitious names.
FIRST = "Avery Jordan Riley Casey Morgan Quinn Rowan Sage Emerson Harper Kendall Reese Skyler Dakota Finley Hayden Parker Sawyer Arden Blair".split()
LAST = "Collins Hayes Ellison Brooks Marlow Thorne Winslow Ashby Calloway Prescott Langley Merritt Sterling Whitaker Fairfax Holloway Kingsley Radcliffe Sinclair Vance".split()


def normal(entity_type: str, value: str) -> str:
    v = " ".join(unicodedata.normalize("NFKC", value).split())
    if entity_type in LOWER:
        return v.lower()
    if entity_type in DIGITS:
        d = re.sub("[^0-9]", "", v)
        return d[-10:] if entity_type == "PHONE" else d
    return re.sub(r"[\s\-:]", "", v).upper() if entity_type in COMPACT else v


def token_col(entity_type: Column, n: Column) -> Column:
    """[TYPE_001]; numbers from 1,000 on grow."""
    number = F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))
    return F.concat(F.lit("["), entity_type, F.lit("_"), number, F.lit("]"))


def marker_col(entity_type: Column) -> Column:
    return F.concat(F.lit("["), entity_type, F.lit("_REDACTED]"))


def spliced(text: str, edits: list[tuple[int, int, str]]) -> str:
    """edits: (start, end, replacement) in any order; one that overlaps an earlier one is left out. One pass over the text."""
    pieces, at = [], 0
    for start, end, new in sorted(edits):
        if start >= at:
            pieces += [text[at:start], new]
            at = end
    return "".join([*pieces, text[at:]])


@F.arrow_udf(StringType())
def splice(text: pa.Array, replacements: pa.Array) -> pa.Array:
    """replacements: array of (start, end, repl), disjoint, in any order; offsets count code points from 0."""
    out = [t if t is None or not edits else spliced(t, [(e["start"], e["end"], e["repl"]) for e in edits if e is not None]) for t, edits in zip(text.to_pylist(), replacements.to_pylist(), strict=True)]
    return pa.array(out, pa.string())


def pseudonym(key: bytes, entity_type: str, value: str, attempt: int = 0) -> str:
    """A fictitious value that depends on the session's key alone."""
    norm = normal(entity_type, value)
    seed = hmac.new(key, f"{entity_type}\0{norm}\0{attempt}".encode(), hashlib.sha256).digest()
    pick = lambda k, n: int.from_bytes(seed[4 * k : 4 * k + 4], "big") % n
    if entity_type == "PERSON":
        return f"{FIRST[pick(0, len(FIRST))]} {LAST[pick(1, len(LAST))]}"
    if entity_type == "EMAIL":
        return f"user{pick(0, 10_000):04}@example.com"
    if entity_type == "PHONE":
        return f"+1 555-01{pick(0, 100):02}"
    if entity_type == "USERNAME":
        return f"user_{pick(0, 100_000):05}"
    if entity_type in ("URL", "INTERNAL_URL"):
        return f"https://example.com/{seed[:4].hex()}"
    if entity_type == "IP_ADDRESS":
        return f"192.0.2.{pick(0, 254) + 1}"
    stream, out = seed, []
    for k, c in enumerate(value):  # digits for digits, letters for letters
        if k % 32 == 0 and k:
            stream = hashlib.sha256(stream).digest()
        b = stream[k % 32]
        out.append(str(b % 10) if c in "0123456789" else chr(65 + b % 26) if "A" <= c <= "Z" else chr(97 + b % 26) if "a" <= c <= "z" else c)
    return "".join(out)
