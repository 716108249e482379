"""Own entity types beside the built-in ones: category, priority and default action, and what finds them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from .functions import catalog
from .functions.rules import Rule, compiled
from .operators.detect import Detection, pattern_rule
from .plans.policy import INPUT_ACTIONS

FunctionDetector = Callable[[str], list[tuple[str, int, int, float]]]


@dataclass(frozen=True)
class EntityType:
    name: str
    category: str = "custom"
    priority: int = catalog.PRIORITY["custom"]
    description: str = ""
    default_action: str | None = None
    built_in: bool = False


@dataclass
class Registry:
    """Known types; `detection` adds their detectors to what is looked for, and decisions take the registry's defaults."""

    types: dict[str, EntityType] = field(default_factory=lambda: {t: EntityType(t, c, catalog.PRIORITY[c], built_in=True) for t, c in catalog.CATEGORY.items()})
    rules: list[Rule] = field(default_factory=list)
    functions: list[tuple[str, FunctionDetector]] = field(default_factory=list)

    def register(self, name: str, detector: str | Rule | FunctionDetector | None = None, category: str = "custom", priority: int | None = None, description: str = "", default_action: str | None = None) -> EntityType:
        """A new type, or a further detector of a built-in one (whose definition stays): a pattern, a rule or a function."""
        if not compiled(r"[A-Z][A-Z0-9_]{1,63}").fullmatch(name):
            raise ValueError("entity types are upper-case names of 2 to 64 characters")
        known = self.types.get(name)
        if known is not None and known.built_in and detector is None:
            raise ValueError(f"{name} is a built-in type")
        if category not in catalog.PRIORITY:
            raise ValueError(f"unknown category: {category}")
        if default_action is not None and default_action not in INPUT_ACTIONS:
            raise ValueError(f"unknown action: {default_action}")
        if known is None or not known.built_in:
            self.types[name] = EntityType(name, category, catalog.PRIORITY[category] if priority is None else priority, description or f"own type {name}", default_action)
        if isinstance(detector, str):
            self.rules.append(pattern_rule(name, f"custom.{name.lower()}", detector))
        elif isinstance(detector, Rule):
            self.rules.append(replace(detector, type=name))
        elif detector is not None:
            self.functions.append((f"custom.{name.lower()}", detector))
        return self.types[name]

    def detection(self, how: Detection | None = None) -> Detection:
        how = how or Detection()
        return replace(how, rules=(*how.rules, *self.rules), functions=(*how.functions, *self.functions), priorities=tuple((t.name, t.priority) for t in self.types.values() if not t.built_in))
