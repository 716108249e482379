"""Entity types, categories and priorities."""

from __future__ import annotations

# Categories with the priority of their entities.
PRIORITY = {"security": 100, "government": 90, "financial": 85, "healthcare": 80, "custom": 75, "identity": 70, "network": 60, "demographic": 40}

# Entity types by category.
TYPES = {
    "identity": ["PERSON", "EMAIL", "PHONE", "ADDRESS", "DATE_OF_BIRTH", "USERNAME", "FACE"],
    "demographic": ["AGE"],
    "government": ["AADHAAR", "PAN", "PASSPORT", "DRIVER_LICENSE", "NATIONAL_ID", "SSN"],
    "financial": ["CREDIT_CARD", "BANK_ACCOUNT", "IBAN", "UPI_ID", "TRANSACTION_ID"],
    "security": ["PASSWORD", "API_KEY", "ACCESS_TOKEN", "JWT", "PRIVATE_KEY", "SECRET", "DATABASE_URL", "AWS_ACCESS_KEY", "GITHUB_TOKEN"],
    "healthcare": ["PATIENT_ID", "MEDICAL_RECORD_NUMBER", "INSURANCE_ID", "HEALTHCARE_PROVIDER"],
    "network": ["IP_ADDRESS", "MAC_ADDRESS", "URL", "INTERNAL_URL"],
}
CATEGORY = {t: c for c, ts in TYPES.items() for t in ts}
SECURITY = TYPES["security"]

# Risk by category; other categories are low.
RISKS = ["NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
RISK = {"security": "CRITICAL", "government": "HIGH", "financial": "HIGH", "healthcare": "HIGH", "identity": "MEDIUM", "custom": "MEDIUM"}


def category(entity_type: str) -> str:
    return CATEGORY.get(entity_type, "custom")


def priority(entity_type: str) -> int:
    return PRIORITY[category(entity_type)]


def risk_rank(entity_type: str) -> int:
    return RISKS.index(RISK.get(category(entity_type), "LOW"))
