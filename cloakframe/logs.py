"""Fields that may stand in logs: named ones, with plain values; never a value of a text."""

from __future__ import annotations

from typing import Any

# Names of fields that are safe to log.
SAFE_KEYS = frozenset(
    "requestId sessionId inputType policy provider model status processingTimeMs durationMs entityCounts entityTotal riskLevel warningCodes pages detector errorCode errorName restoredTokens unrestoredTokens mode failMode action "
    "entityType count".split()
)
MOST_CHARS = 128


def _plain(value: Any) -> bool:
    return isinstance(value, (int, float))


def safe_fields(fields: dict[str, Any] | None) -> dict[str, Any] | None:
    """Allowed keys only: numbers and booleans as they are, strings cut, lists of strings and numbers, mappings of counts."""
    if fields is None:
        return None
    out: dict[str, Any] = {}
    for key in fields.keys() & SAFE_KEYS:
        value = fields[key]
        if _plain(value):
            out[key] = value
        elif isinstance(value, str):
            out[key] = value if len(value) <= MOST_CHARS else value[:MOST_CHARS] + "…"
        elif isinstance(value, (list, tuple)):
            out[key] = [v for v in value if isinstance(v, str) or (_plain(v) and not isinstance(v, bool))]
        elif isinstance(value, dict):
            out[key] = {k: v for k, v in value.items() if _plain(v) and not isinstance(v, bool)}
    return out
