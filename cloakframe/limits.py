"""Limits of inputs, all positive and finite."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

from .operators.detect import Detection


@dataclass(frozen=True)
class Limits:
    max_text_bytes: int = 10 << 20
    max_file_bytes: int = 50 << 20
    max_json_nodes: int = 100_000
    max_json_depth: int = 64
    max_zip_entries: int = 2000
    max_zip_bytes: int = 200 << 20
    max_zip_ratio: int = 200
    max_entities: int = 100_000
    max_pages: int = 500
    max_image_pixels: int = 50_000_000
    max_policy_bytes: int = 1 << 20
    session_ttl_seconds: int = 3600
    max_alias: int = 50

    def __post_init__(self) -> None:
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) or v <= 0:
                raise ValueError(f"{f.name} must be a positive finite number")

    def detection(self, how: Detection | None = None) -> Detection:
        return Detection(**{**(how or Detection()).__dict__, "max_text_bytes": self.max_text_bytes, "max_entities": self.max_entities})
