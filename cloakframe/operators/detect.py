"""Entity detection over a column of text: one Arrow kernel finds spans and resolves overlaps within a row.

Offsets count code points. Entities carry no values unless asked for (then also their normal form). Null text has no entities. Texts are scanned
whole unless limits are asked for: then texts beyond `max_text_bytes` are not scanned and say so in `incomplete`.
"""

from __future__ import annotations

import time
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cmp_to_key

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions.names import ADDRESS_RULES, NameLists, NameScanner
from ..functions.rules import PII_RULES, Reader, Rule, Span, compiled, scan
from ..functions.secrets import SECRET_RULES
from ..functions.values import normal

TOKEN_RE = r"\[[A-Z][A-Z0-9_]*_(?:[0-9]{3,}|REDACTED)\]"
ENTITY = "type string, start int, end int, confidence double, source string, detector string, rule string, has_context boolean"
FOUND = f"entities array<struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in ENTITY.split(', '))}>>, warnings array<string>, incomplete boolean"
_STRUCT = pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64()), ("source", pa.string()), ("detector", pa.string()), ("rule", pa.string()), ("has_context", pa.bool_())])


@dataclass(frozen=True)
class Detection:
    """What to look for, and the limits of a text (none unless they are set; `Limits.detection` sets them)."""

    disabled: tuple[str, ...] = ()  # pii, secrets, names, or names of own detectors
    rules: tuple[Rule, ...] = ()  # own pattern rules
    functions: tuple[tuple[str, Callable[[str], list[tuple[str, int, int, float]]]], ...] = ()  # own detectors: name, text -> (type, start, end, confidence)
    names: NameLists = field(default_factory=NameLists)
    only: tuple[str, ...] = ()  # entity types; empty: all
    max_text_bytes: int | None = None
    max_entities: int | None = None
    priorities: tuple[tuple[str, int], ...] = ()  # of own types; others have their category's


def pattern_rule(entity_type: str, rule_id: str, pattern: str, confidence: float = 0.9, flags: str = "", **more) -> Rule:
    """An own rule; patterns that match the empty string are refused."""
    if compiled(pattern, flags).search(""):
        raise ValueError("the pattern matches empty text")
    if not compiled(r"[A-Z][A-Z0-9_]{1,63}").fullmatch(entity_type):
        raise ValueError("entity types are upper-case names of 2 to 64 characters")
    return Rule(entity_type, rule_id, pattern, confidence, flags, source="custom", **more)


def overlapping(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """spans: disjoint and sorted."""
    k = bisect_left(spans, (start, start))
    return (k < len(spans) and spans[k][0] < end) or (k > 0 and spans[k - 1][1] > start)


def _order(priority: Callable[[str], int]) -> Callable[[Span, Span], float]:
    """Score decides, unless the scores are within 0.05: then the longer span, then the score."""
    score = lambda s: s.confidence + 0.002 * priority(s.type)

    def compare(a: Span, b: Span) -> float:
        d = score(b) - score(a)
        return d if abs(d) > 0.05 else (b.end - b.start) - (a.end - a.start) or d

    return compare


def resolve(spans: list[Span], own: dict[str, int] | None = None) -> list[Span]:
    """The best spans that don't overlap, in order of start; own: priorities of own types."""
    kept: list[tuple[int, int]] = []
    out = []
    priority = catalog.priority if not own else lambda t: own.get(t, catalog.priority(t))
    for s in sorted(spans, key=cmp_to_key(_order(priority))):
        if not overlapping(kept, s.start, s.end):
            insort(kept, (s.start, s.end))
            out.append(s)
    return sorted(out, key=lambda s: s.start)


class Scanner:
    """Detectors of a worker, in order."""

    def __init__(self, how: Detection):
        self.how = how
        names = NameScanner(how.names)
        only = set(how.only)
        pick = lambda rules: [r for r in rules if not only or r.type in only or (r.type == "URL" and "INTERNAL_URL" in only)]
        pii, secrets, own = pick(PII_RULES), pick(SECRET_RULES), list(how.rules)
        steps = [("pii", lambda v: scan(v, pii, "pii")), ("secrets", lambda v: scan(v, secrets, "secrets"))]
        if not only or only & {"PERSON", "ADDRESS", "HEALTHCARE_PROVIDER"}:
            steps.append(("names", names.scan))
        if own:
            steps.append(("custom", lambda v: scan(v, own, "custom")))
        for name, call in how.functions:
            steps.append((name, lambda v, n=name, f=call: [Span(k, s, e, c, "custom", n, n, False) for k, s, e, c in f(v.text)]))
        self.steps = [(n, f) for n, f in steps if n not in how.disabled]
        used = {n for n, _ in self.steps}
        rules = [*(pii if "pii" in used else ()), *(secrets if "secrets" in used else ()), *(ADDRESS_RULES if "names" in used else ()), *own]
        self.reader = Reader(rules, names.words if "names" in used else ())

    def __call__(self, text: str) -> tuple[list[Span], list[str], bool]:
        most = self.how.max_text_bytes
        if most is not None and (len(text) > most or (len(text) * 4 > most and len(text.encode()) > most)):
            return [], ["TEXT_TOO_LARGE"], True
        view, spans, warnings = self.reader(text), [], []
        for name, step in self.steps:
            try:
                spans += step(view)
            except Exception:  # one detector's failure leaves the others' results, marked as incomplete
                warnings.append(f"DETECTOR_FAILED:{name}")
        tokens = [m.span() for m in compiled(TOKEN_RE).finditer(text)] if "[" in text else []
        valid = [s for s in spans if 0 <= s.start < s.end <= len(text) and s.confidence == s.confidence and not overlapping(tokens, s.start, s.end)]
        if self.how.only:
            valid = [s for s in valid if s.type in self.how.only]
        best = resolve(valid, dict(self.how.priorities))
        if self.how.max_entities is not None and len(best) > self.how.max_entities:
            best = best[: self.how.max_entities]
            warnings.append("ENTITY_LIMIT_REACHED")
        return best, warnings, bool(warnings)


def entity_rows(spans: list[Span], text: str, values: bool) -> list[dict]:
    if not values:
        return [s._asdict() for s in spans]
    return [{**s._asdict(), "value": (v := text[s.start : s.end]), "norm": normal(s.type, v)} for s in spans]


def entity_type(values: bool) -> pa.ListType:
    return pa.list_(pa.struct([*_STRUCT, *([("value", pa.string()), ("norm", pa.string())] if values else [])]))


def _kernel(how: Detection, column: str, keep: list[str], values: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(how)
        for batch in batches:
            entities, warnings, incomplete = [], [], []
            for text in batch.column(column).to_pylist():
                got, warned, part = scanner(text) if text else ([], [], False)
                entities.append(entity_rows(got, text, values))
                warnings.append(warned)
                incomplete.append(part)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(entities, entity_type(values)), pa.array(warnings, pa.list_(pa.string())), pa.array(incomplete, pa.bool_())], names=[*keep, "entities", "warnings", "incomplete"]
            )

    return run


def detect(segments: DataFrame, text: str = "text", how: Detection | None = None, keep: list[str] | None = None, values: bool = False) -> DataFrame:
    """segments' columns with `entities`, `warnings` and `incomplete`; with values, entities have `value` and `norm` too."""
    keep = segments.columns if keep is None else keep
    rows = segments.select(*dict.fromkeys([*keep, text]))
    schema = segments.select(*keep).schema
    for f in ("entities", "warnings", "incomplete"):
        if f in keep:
            raise ValueError(f"column {f} is taken")
    from pyspark.sql.types import _parse_datatype_string

    found = FOUND.replace(", has_context:boolean", ", has_context:boolean, value:string, norm:string") if values else FOUND
    for f in _parse_datatype_string(found).fields:
        schema = schema.add(f)
    return rows.mapInArrow(_kernel(how or Detection(), text, list(keep), values), schema)


def entities_of(detected: DataFrame, *keys: str, value_of: str | None = None) -> DataFrame:
    """A row for each entity (fields that clash with a key are called entity_...); value_of names the text column if values are wanted (they are left out by default)."""
    rows = detected.select(*keys, *([value_of] if value_of and value_of not in keys else []), F.posexplode("entities").alias("entity_no", "e"))
    value = [F.substring(F.col(value_of), F.col("e.start") + 1, F.col("e.end") - F.col("e.start")).alias("value")] if value_of else []
    fields = [F.col(f"e.{f}").alias(f"entity_{f}" if f in keys else f) for f in _STRUCT.names]
    return rows.select(*keys, "entity_no", *fields, (F.col("e.end") - F.col("e.start")).alias("length"), *value)


def timed(scanner: Scanner, text: str) -> float:
    began = time.perf_counter()
    scanner(text)
    return time.perf_counter() - began
