"""JSON documents as requests: flattening to segments, field hints, and rewriting with order kept."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

MAX_NODES, MAX_DEPTH, DROPPED = 100_000, 64, {"__proto__", "constructor", "prototype"}
MAX_HINTED = 2000


def walk(value: Any, visit: Callable[[str, str | None], str], key: str | None = None, depth: int = 0, count: list[int] | None = None) -> Any:
    """The value with every string replaced by visit(text, field); keys too. Numbers under a key become strings only if they change."""
    count = count if count is not None else [0]
    count[0] += 1
    if depth > MAX_DEPTH or count[0] > MAX_NODES:
        raise ValueError("the document is too deep or has too many nodes")
    if isinstance(value, str):
        return visit(value, key)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)):
        text = json.dumps(value)
        new = visit(text, key) if key is not None else text
        return value if new == text else new
    if isinstance(value, list):
        return [walk(v, visit, key, depth + 1, count) for v in value]
    return {visit(k, None): walk(v, visit, k, depth + 1, count) for k, v in value.items() if k not in DROPPED}


def segments(document: str) -> list[tuple[str, str | None]]:
    """(text, field) in order of traversal."""
    out: list[tuple[str, str | None]] = []

    def visit(text: str, key: str | None) -> str:
        out.append((text, key))
        return text

    walk(json.loads(document), visit)
    return out


def rewritten(document: str, texts: list[str]) -> str:
    """The document with the n-th segment replaced by the n-th text."""
    at = iter(texts)
    return json.dumps(walk(json.loads(document), lambda *_: next(at)), ensure_ascii=False)


def hinted(text: str, field: str | None, spans: list, type_of: Callable[[str], str | None]) -> list:
    """A named field whose value is mostly uncovered is one entity of the field's type."""
    from ..functions.rules import Span

    kind = type_of(field) if field else None
    body = text.strip()
    if not kind or not body or len(body) > MAX_HINTED or sum(s.end - s.start for s in spans) >= 0.6 * len(body):
        return spans
    start = len(text) - len(text.lstrip())
    return [Span(kind, start, start + len(body), 0.9, "field", "fields", "field-hint", False)]
