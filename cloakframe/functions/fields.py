"""Entity types that field names imply."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Anchored patterns of field names, the first match wins.
HINTS = [
    ("EMAIL", "e[-_]?mail|email[-_]?address|mail"),
    ("PHONE", "phone|phone[-_]?(no|number)|mobile|mobile[-_]?(no|number)|tel|telephone|cell|contact[-_]?number|whatsapp"),
    ("PERSON", "(full|first|last|middle|given|family|sur|maiden|patient|customer|user|employee|account[-_]?holder|beneficiary|father|mother|spouse|guardian|nominee)[-_]?name|name|surname|fname|lname"),
    ("ADDRESS", "(home|street|postal|mailing|billing|shipping|residential|permanent)[-_]?address|address([-_]?line[-_]?[0-9])?|street|addr"),
    ("DATE_OF_BIRTH", "dob|date[-_]?of[-_]?birth|birth[-_]?date|birthday"),
    ("USERNAME", "user[-_]?name|login|user[-_]?id|handle|screen[-_]?name"),
    ("AADHAAR", "aadhaar|aadhar|aadhaar[-_]?(no|number)|uid"),
    ("PAN", "pan|pan[-_]?(no|number|card)"),
    ("PASSPORT", "passport|passport[-_]?(no|number)"),
    ("DRIVER_LICENSE", "driver'?s?[-_]?licen[cs]e|dl[-_]?(no|number)|driving[-_]?licen[cs]e"),
    ("NATIONAL_ID", "national[-_]?id|nin|nino|voter[-_]?id"),
    ("SSN", "ssn|social[-_]?security([-_]?number)?"),
    ("CREDIT_CARD", "card[-_]?(no|number)|credit[-_]?card([-_]?number)?|cc[-_]?number|pan[-_]?card[-_]?number"),
    ("BANK_ACCOUNT", "account[-_]?(no|number)|bank[-_]?account([-_]?number)?|acct[-_]?(no|number)"),
    ("IBAN", "iban"),
    ("UPI_ID", "upi|upi[-_]?id|vpa"),
    ("PASSWORD", "password|passwd|pwd|pass|passphrase|pin"),
    ("API_KEY", "api[-_]?key|apikey|x[-_]?api[-_]?key"),
    ("ACCESS_TOKEN", "access[-_]?token|refresh[-_]?token|auth[-_]?token|bearer[-_]?token|token|id[-_]?token"),
    ("SECRET", "secret|client[-_]?secret|secret[-_]?key|private[-_]?key|signing[-_]?key"),
    ("DATABASE_URL", "database[-_]?url|db[-_]?url|connection[-_]?string|dsn"),
    ("PATIENT_ID", "patient[-_]?id|uhid|abha([-_]?(no|number|id))?"),
    ("MEDICAL_RECORD_NUMBER", "mrn|medical[-_]?record[-_]?(no|number)"),
    ("INSURANCE_ID", "insurance[-_]?(id|no|number)|policy[-_]?(no|number)|member[-_]?id"),
    ("IP_ADDRESS", "ip|ip[-_]?address|client[-_]?ip|remote[-_]?addr"),
    ("MAC_ADDRESS", "mac|mac[-_]?address"),
]
_COMPILED = [(t, re.compile(p, re.I | re.A)) for t, p in HINTS]


def field_type(name: str) -> str | None:
    return next((t for t, p in _COMPILED if p.fullmatch(name)), None)


def field_type_col(name: Column) -> Column:
    out = F
    for t, p in HINTS:
        out = out.when(name.rlike(rf"(?i)\A({p})\z"), F.lit(t))
    return out.otherwise(None)
