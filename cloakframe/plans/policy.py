"""Policies: built-in matrix, inheritance, validation, purposes, and decisions as joins."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog

INPUT_ACTIONS = ("allow", "redact", "tokenize", "pseudonymize", "block")
OUTPUT_ACTIONS = ("allow", "warn", "redact", "tokenize", "block")
REVERSIBLE = ("tokenize", "pseudonymize")
STRICT_CONFIDENCE = 0.35

# The built-in policies, and what each of them does with a type (in the order of NAMES).
NAMES = ("default", "strict", "healthcare", "financial", "developer", "enterprise")
MATRIX: list[tuple[str, str]] = [
    ("PERSON", "tokenize tokenize tokenize tokenize tokenize tokenize"),
    ("EMAIL", "tokenize tokenize redact tokenize tokenize tokenize"),
    ("PHONE", "tokenize tokenize redact tokenize tokenize tokenize"),
    ("USERNAME", "tokenize tokenize redact tokenize tokenize tokenize"),
    ("ADDRESS", "tokenize redact redact redact tokenize tokenize"),
    ("DATE_OF_BIRTH", "redact redact redact redact redact redact"),
    ("AGE", "allow allow allow allow allow allow"),
    ("AADHAAR", "tokenize redact redact redact redact redact"),
    ("PASSPORT", "tokenize redact redact redact redact redact"),
    ("DRIVER_LICENSE", "tokenize redact redact redact redact redact"),
    ("NATIONAL_ID", "tokenize redact redact redact redact redact"),
    ("SSN", "tokenize redact redact redact redact redact"),
    ("PAN", "tokenize redact redact tokenize redact redact"),
    ("CREDIT_CARD", "redact block block block redact block"),
    *((t, "redact block block block redact block") for t in catalog.SECURITY),
    ("BANK_ACCOUNT", "tokenize redact redact tokenize redact tokenize"),
    ("IBAN", "tokenize redact redact tokenize redact tokenize"),
    ("UPI_ID", "tokenize redact redact tokenize allow tokenize"),
    ("TRANSACTION_ID", "tokenize redact redact tokenize allow tokenize"),
    ("PATIENT_ID", "tokenize tokenize tokenize redact redact tokenize"),
    ("MEDICAL_RECORD_NUMBER", "tokenize tokenize tokenize redact redact tokenize"),
    ("INSURANCE_ID", "tokenize tokenize tokenize redact redact tokenize"),
    ("HEALTHCARE_PROVIDER", "tokenize tokenize tokenize redact allow tokenize"),
    ("IP_ADDRESS", "tokenize redact redact redact tokenize redact"),
    ("MAC_ADDRESS", "tokenize redact redact redact tokenize redact"),
    ("INTERNAL_URL", "tokenize redact redact redact tokenize redact"),
    ("URL", "allow redact allow allow allow allow"),
]
LEAST = dict(zip(NAMES, (0.5, 0.35, 0.45, 0.45, 0.5, 0.45), strict=True))
FAIL = dict(zip(NAMES, ("open", "closed", "closed", "closed", "open", "closed"), strict=True))
UNEXPECTED = dict(zip(NAMES, ("warn", "redact", "redact", "redact", "warn", "redact"), strict=True))
OUTPUT_RULES = {"default": {t: "redact" for t in [*catalog.SECURITY, "CREDIT_CARD"]}, "financial": {"CREDIT_CARD": "block"}, "developer": {t: "redact" for t in catalog.SECURITY}}
PURPOSES: dict[str, list[dict[str, Any]]] = {
    "healthcare": [
        {
            "id": "clinical-analysis",
            "keywords": ["clinical", "diagnos", "symptom", "risk", "cardio", "treatment", "condition", "medical", "summar", "triage", "prognosis", "lab result"],
            "entities": {**dict.fromkeys(["PERSON", "PATIENT_ID", "MEDICAL_RECORD_NUMBER", "INSURANCE_ID", "HEALTHCARE_PROVIDER", "ADDRESS", "PHONE", "EMAIL"], "redact"), "AGE": "allow"},
        },
        {"id": "patient-communication", "keywords": ["letter", "message to patient", "patient communication", "discharge instructions", "appointment reminder"], "entities": dict.fromkeys(["PERSON", "HEALTHCARE_PROVIDER", "PATIENT_ID"], "tokenize")},
        {"id": "billing", "keywords": ["billing", "claim", "insurance", "invoice", "reimburse"], "entities": dict.fromkeys(["INSURANCE_ID", "PATIENT_ID", "PERSON"], "tokenize")},
    ],
    "financial": [
        {"id": "fraud-analysis", "keywords": ["fraud", "anomaly", "risk", "pattern", "aml"], "entities": {**dict.fromkeys(["PERSON", "EMAIL", "PHONE"], "redact"), **dict.fromkeys(["TRANSACTION_ID", "BANK_ACCOUNT"], "tokenize")}},
    ],
}


@dataclass(frozen=True)
class TypeRule:
    action: str
    min_confidence: float | None = None
    restore: bool = True


@dataclass(frozen=True)
class Purpose:
    id: str
    keywords: tuple[str, ...]
    entities: dict[str, str]


@dataclass(frozen=True)
class Policy:
    name: str
    default_action: str = "redact"
    min_confidence: float = 0.5
    fail_mode: str = "open"
    entities: dict[str, TypeRule] = field(default_factory=dict)
    output_default: str = "warn"
    output_entities: dict[str, str] = field(default_factory=dict)
    restore_tokens: bool = True
    purposes: tuple[Purpose, ...] = ()

    def strict(self) -> Policy:
        """Fails closed and keeps less certain entities; a rule's own threshold still wins."""
        return Policy(**{**self.__dict__, "fail_mode": "closed", "min_confidence": min(self.min_confidence, STRICT_CONFIDENCE)})

    def purpose(self, text: str | None) -> Purpose | None:
        """An equal id wins, else the longest keyword in the text; of equals the first purpose."""
        wanted = (text or "").strip().lower()
        if not wanted:
            return None
        best, length = None, 0
        for p in self.purposes:
            if p.id.lower() == wanted:
                return p
            longest = max((len(k) for k in p.keywords if k.lower() in wanted), default=0)
            if longest > length:
                best, length = p, longest
        return best


def built_in(name: str) -> Policy:
    at = NAMES.index(name)
    return Policy(
        name, "redact", LEAST[name], FAIL[name], {t: TypeRule(a.split()[at]) for t, a in MATRIX}, UNEXPECTED[name], dict(OUTPUT_RULES.get(name, {})), True,
        tuple(Purpose(p["id"], tuple(p["keywords"]), p["entities"]) for p in PURPOSES.get(name, [])),
    )


def problems(spec: Any) -> list[tuple[str, str]]:
    """(path, message) of everything that is wrong with a policy document."""
    if not isinstance(spec, dict):
        return [("", "a policy is a mapping")]
    out = []
    known = {"name", "extends", "version", "description", "defaultAction", "minConfidence", "failMode", "entities", "output", "purposes"}
    out += [(k, "unknown field") for k in spec if k not in known]
    check = lambda path, ok, what: out.append((path, what)) if not ok else None
    action = lambda a, allowed: isinstance(a, str) and a.lower() in allowed
    share = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and 0 <= x <= 1
    check("extends", spec.get("extends", "default") in NAMES, "unknown policy to extend")
    check("defaultAction", action(spec.get("defaultAction", "redact"), INPUT_ACTIONS), "unknown action")
    check("minConfidence", share(spec.get("minConfidence", 0.5)), "must be between 0 and 1")
    check("failMode", str(spec.get("failMode", "open")).lower() in ("open", "closed"), "open or closed")
    rules = spec.get("entities") or {}
    check("entities", isinstance(rules, dict), "a mapping by entity type")
    for t, r in rules.items() if isinstance(rules, dict) else []:
        r = {"action": r} if isinstance(r, str) else r
        check(f"entities.{t}", isinstance(r, dict) and action(r.get("action"), INPUT_ACTIONS), "unknown action")
        if isinstance(r, dict) and "minConfidence" in r:
            check(f"entities.{t}.minConfidence", share(r["minConfidence"]), "must be between 0 and 1")
    output = spec.get("output") or {}
    check("output", isinstance(output, dict), "a mapping")
    if isinstance(output, dict):
        check("output.unexpectedEntityAction", action(output.get("unexpectedEntityAction", "warn"), OUTPUT_ACTIONS), "unknown action")
        check("output.restoreTokens", isinstance(output.get("restoreTokens", True), bool), "true or false")
        out += [(f"output.entities.{t}", "unknown action") for t, a in (output.get("entities") or {}).items() if not action(a, OUTPUT_ACTIONS)]
    purposes = spec.get("purposes") or []
    check("purposes", isinstance(purposes, list), "a list")
    for k, p in enumerate(purposes if isinstance(purposes, list) else []):
        check(f"purposes[{k}].id", isinstance(p, dict) and bool(p.get("id")), "an id is needed")
        if isinstance(p, dict):
            out += [(f"purposes[{k}].entities.{t}", "unknown action") for t, a in (p.get("entities") or {}).items() if not action(a, INPUT_ACTIONS)]
    return out


def issues(spec: Any) -> list[tuple[str, str, str]]:
    """(path, severity, message): errors, and warnings of what is allowed but likely a mistake."""
    out = [(p, "error", m) for p, m in problems(spec)]
    if isinstance(spec, dict):
        for where, rules in (("entities", spec.get("entities")), ("output.entities", (spec.get("output") or {}).get("entities") if isinstance(spec.get("output"), dict) else None)):
            for t in rules if isinstance(rules, dict) else ():
                if str(t).upper() not in catalog.CATEGORY:
                    out.append((f"{where}.{t}", "warning", "not a built-in type"))
        for k, p in enumerate(spec.get("purposes") or [] if isinstance(spec.get("purposes"), list) else []):
            if isinstance(p, dict) and not p.get("keywords"):
                out.append((f"purposes[{k}].keywords", "warning", "only its id selects this purpose"))
    return out


def resolve_policy(spec: Policy | str | dict | None) -> Policy:
    """A name, a document that extends a built-in policy, or a short form {TYPE: action}."""
    if spec is None or isinstance(spec, str):
        if (spec or "default") not in NAMES:
            raise ValueError(f"no such policy: {spec}")
        return built_in(spec or "default")
    if isinstance(spec, Policy):
        return spec
    if spec and all(k.isupper() for k in spec):
        spec = {"entities": spec, "name": "custom"}
    if found := problems(spec):
        raise ValueError("; ".join(f"{p}: {m}" for p, m in found))
    base = built_in(spec.get("extends", "default"))
    rules, output = dict(base.entities), spec.get("output") or {}
    for t, r in (spec.get("entities") or {}).items():
        r = {"action": r} if isinstance(r, str) else r
        rules[t.upper()] = TypeRule(r["action"].lower(), r.get("minConfidence"), r.get("restore", True))
    purposes = tuple(Purpose(p["id"], tuple(p.get("keywords") or ()), {t: a.lower() for t, a in (p.get("entities") or {}).items()}) for p in spec["purposes"]) if "purposes" in spec else base.purposes
    return Policy(
        spec.get("name") or ("custom" if "extends" not in spec else f"{base.name}-custom"), spec.get("defaultAction", base.default_action).lower(), float(spec.get("minConfidence", base.min_confidence)), spec.get("failMode", base.fail_mode).lower(), rules,
        output.get("unexpectedEntityAction", base.output_default).lower(), {**base.output_entities, **{t: a.lower() for t, a in (output.get("entities") or {}).items()}}, output.get("restoreTokens", base.restore_tokens), purposes,
    )


MAX_ALIASES, MAX_POLICY_BYTES = 50, 1 << 20


def load_policy(text: str) -> Policy:
    """A policy from YAML or JSON: no duplicate keys, no merge keys, few aliases, at most 1 MiB."""
    import yaml

    if len(text.encode()) > MAX_POLICY_BYTES:
        raise ValueError("the policy is too large")

    class Loader(yaml.SafeLoader):
        def construct_mapping(self, node, deep=False):
            seen = set()
            for key, _ in node.value:
                if key.tag == "tag:yaml.org,2002:merge":
                    raise ValueError("merge keys are not allowed")
                name = self.construct_object(key, deep=True)
                if name in seen or name in ("__proto__", "constructor", "prototype"):
                    raise ValueError(f"key not allowed: {name}")
                seen.add(name)
            return super().construct_mapping(node, deep)

        flatten_mapping = lambda self, node: None

    if sum(isinstance(e, yaml.AliasEvent) for e in yaml.parse(text, Loader=yaml.SafeLoader)) > MAX_ALIASES:
        raise ValueError("too many aliases")
    return resolve_policy(yaml.load(text, Loader=Loader))


# Decisions as joins with small tables ----------------------------------------------------------------------------


def type_table(spark: SparkSession, registry=None) -> DataFrame:
    """Entity types with category, priority, risk and default action: a row for each built-in type, or each type of a registry."""
    rank = lambda c: catalog.RISKS.index(catalog.RISK.get(c, "LOW"))
    rows = [(t, c, catalog.PRIORITY[c], rank(c), None) for t, c in catalog.CATEGORY.items()] if registry is None else [(t.name, t.category, t.priority, rank(t.category), t.default_action) for t in registry.types.values()]
    return spark.createDataFrame(rows, "type string, category string, priority int, risk_rank int, type_action string")


def rule_table(spark: SparkSession, policies: list[Policy]) -> DataFrame:
    rows = [(p.name, t, r.action, r.min_confidence, r.restore) for p in policies for t, r in p.entities.items()]
    return spark.createDataFrame(rows, "policy string, type string, rule_action string, rule_min double, rule_restore boolean")


def policy_table(spark: SparkSession, policies: list[Policy]) -> DataFrame:
    rows = [(p.name, p.default_action, p.min_confidence, p.fail_mode, p.restore_tokens) for p in policies]
    return spark.createDataFrame(rows, "policy string, default_action string, min_confidence double, fail_mode string, restore_tokens boolean")


def purpose_entities(spark: SparkSession, policies: list[Policy]) -> DataFrame:
    rows = [(p.name, u.id, t, a) for p in policies for u in p.purposes for t, a in u.entities.items()]
    return spark.createDataFrame(rows, "policy string, purpose_id string, type string, purpose_action string")


def purpose_id_col(policies: list[Policy], policy: str = "policy", purpose: str = "purpose") -> Column:
    """The id of the purpose that holds, or null: an equal id wins, else the longest keyword in the text, of equals the first purpose.

    An expression over the policies' few keywords: no join, so that rows without a purpose don't meet in one task.
    """
    want, out = F.lower(F.trim(purpose)), F.lit(None).cast("string")
    for p in policies:
        if p.purposes:
            ids = [(u.id.lower(), u.id) for u in p.purposes]
            words = sorted(((w.lower(), k, u.id) for k, u in enumerate(p.purposes) for w in u.keywords if w), key=lambda x: (-len(x[0]), x[1]))
            held = F
            for name, own in ids:
                held = held.when(want == name, F.lit(own))
            for word, _, own in words:
                held = held.when(F.contains(want, F.lit(word)), F.lit(own))
            out = F.when(F.col(policy) == p.name, held.otherwise(F.lit(None))).otherwise(out)
    return out


def match_purposes(asked: DataFrame, policies: list[Policy]) -> DataFrame:
    """Distinct (policy, purpose) rows with the purpose_id that holds."""
    return asked.select("policy", "purpose").distinct().withColumn("purpose_id", purpose_id_col(policies)).where("purpose_id is not null")


def decide(entities: DataFrame, policies: list[Policy], registry=None) -> DataFrame:
    """Adds action, reason, threshold, restorable, category, risk_rank and kept to rows (policy, purpose, type, confidence)."""
    spark = entities.sparkSession
    rows = entities.withColumn("purpose_id", purpose_id_col(policies))
    small = lambda df: F.broadcast(df)  # noqa: E731  tables of policies and types
    rows = rows.join(small(policy_table(spark, policies)), "policy", "left").join(small(rule_table(spark, policies)), ["policy", "type"], "left")
    rows = rows.join(small(purpose_entities(spark, policies)), ["policy", "purpose_id", "type"], "left").join(small(type_table(spark, registry)), "type", "left")
    rows = rows.withColumn("action", F.coalesce("purpose_action", "rule_action", "type_action", "default_action"))
    reason = F.when(F.col("purpose_action").isNotNull(), "purpose").when(F.col("rule_action").isNotNull(), "policy").otherwise("default")
    rows = rows.withColumn("reason", reason).withColumn("threshold", F.coalesce("rule_min", "min_confidence"))
    rows = rows.withColumn("category", F.coalesce("category", F.lit("custom"))).withColumn("risk_rank", F.coalesce("risk_rank", F.lit(catalog.risk_rank("CUSTOM")))).withColumn("priority", F.coalesce("priority", F.lit(75)))
    restorable = F.col("action").isin(*REVERSIBLE) & F.coalesce("rule_restore", F.lit(True)) & F.col("restore_tokens")
    return rows.withColumn("restorable", restorable).withColumn("kept", F.col("confidence") >= F.col("threshold")).drop("purpose_action", "rule_action", "type_action", "rule_min", "rule_restore", "min_confidence", "default_action", "restore_tokens")
