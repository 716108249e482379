"""Protection of requests: detection, decisions, session tokens, replacement, and a result for each request.

requests: (request_id, session_id, seq, text) and optionally purpose; request_id is unique. A session's tokens are numbered
over its distinct values in order of first use, so a session with very many mentions is reduced to its values
before any window. Numbers that already stand in the session's texts as tokens are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.storagelevel import StorageLevel

from ..functions.catalog import RISKS
from ..functions.values import marker_col, normal, pseudonym, splice, token_col
from ..plans.policy import Policy, decide, resolve_policy
from ..registry import Registry
from .detect import Detection, detect


@F.pandas_udf(StringType())
def normal_udf(entity_type: pd.Series, value: pd.Series) -> pd.Series:
    return pd.Series([normal(t, v) for t, v in zip(entity_type, value, strict=True)])


def decided_entities(requests: DataFrame, policy: Policy | str | dict | None = None, how: Detection | None = None, registry: Registry | None = None) -> tuple[DataFrame, DataFrame]:
    """(detected requests, decided entities); both are internal: they hold values.

    The detected requests are persisted, as several plans read them and each would scan the texts again; a lost executor's part
    is scanned again. Callers may unpersist them once their results are written.
    """
    p = resolve_policy(policy)
    how = registry.detection(how) if registry else how
    rows = requests.withColumn("policy", F.lit(p.name))
    if "purpose" not in rows.columns:
        rows = rows.withColumn("purpose", F.lit(None).cast("string"))
    base = detect(rows.select("request_id", "session_id", "seq", "text", "purpose", "policy"), how=how, values=True).persist(StorageLevel.MEMORY_AND_DISK)
    entities = base.select("request_id", "session_id", "seq", "purpose", "policy", F.explode("entities").alias("e")).select("request_id", "session_id", "seq", "purpose", "policy", "e.*")
    return base, decide(entities, [p], registry)


def reserved_numbers(requests: DataFrame) -> DataFrame:
    """(session_id, type, gaps): for the i-th reserved number r, how many free numbers come before it (r - i)."""
    found = requests.select("session_id", F.explode(F.regexp_extract_all("text", F.lit(r"\[([A-Z][A-Z0-9_]*_[0-9]{3,})\]"), 1)).alias("token")).distinct()
    parts = found.select("session_id", F.regexp_extract("token", r"^(.*)_([0-9]+)$", 1).alias("type"), F.regexp_extract("token", r"^(.*)_([0-9]+)$", 2).alias("digits"))
    number = F.expr("try_cast(digits AS bigint)")
    same = F.col("digits") == F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string"))
    parts = parts.withColumn("r", number).where((F.col("r") > 0) & same)
    rank = F.row_number().over(Window.partitionBy("session_id", "type").orderBy("r"))
    return parts.withColumn("gap", F.col("r") - rank).groupBy("session_id", "type").agg(F.sort_array(F.collect_list("gap")).alias("gaps"))


def assign_tokens(mentions: DataFrame, requests: DataFrame | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """mentions (session_id, type, norm, value, ord, restorable) -> mappings, a row for each session, type and value.

    earlier: mappings of former batches; their values keep their tokens, new ones count on.
    """
    firsts = mentions.groupBy("session_id", "type", "norm").agg(F.min("ord").alias("first_ord"), F.min_by("value", "ord").alias("value"), F.min_by("restorable", "ord").alias("restorable"))
    start = F.lit(0)
    if earlier is not None:
        known = earlier.select("session_id", "type", "norm")
        firsts = firsts.join(known, ["session_id", "type", "norm"], "left_anti")
        firsts = firsts.join(earlier.groupBy("session_id", "type").agg(F.max("number").alias("last")), ["session_id", "type"], "left")
        start = F.coalesce(F.col("last"), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("session_id", "type").orderBy("first_ord", "norm")) + start
    numbered = firsts.withColumn("nth", nth)
    if requests is not None:
        numbered = numbered.join(reserved_numbers(requests), ["session_id", "type"], "left")
        numbered = numbered.withColumn("number", F.col("nth") + F.coalesce(F.size(F.filter("gaps", lambda g: g < F.col("nth"))), F.lit(0)))
    else:
        numbered = numbered.withColumn("number", F.col("nth"))
    out = numbered.select("session_id", "type", "norm", "value", "restorable", F.col("number").cast("long").alias("number"), token_col(F.col("type"), F.col("number")).alias("token"))
    return out if earlier is None else earlier.unionByName(out)


def pseudonyms(mentions: DataFrame, keys: DataFrame) -> DataFrame:
    """(session_id, type, norm, value) and keys (session_id, session_key) -> replacement; collisions inside a session are retried in order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        out = []
        for r in rows.sort_values(["seq", "request_id", "seg_no", "start", "type", "norm"]).itertuples():
            made = (pseudonym(bytes(r.session_key), r.type, r.value, k) for k in range(50))
            got = next((x for x in made if x not in used and x != r.value), f"[{r.type}_P{len(used) + 1:03}]")
            used.add(got)
            out.append((r.session_id, r.type, r.norm, r.value, bool(r.restorable), got))
        return pd.DataFrame(out, columns=["session_id", "type", "norm", "value", "restorable", "replacement"])

    firsts = mentions.groupBy("session_id", "type", "norm").agg(F.min("ord").alias("first_ord"), F.min_by("value", "ord").alias("value"), F.min_by("restorable", "ord").alias("restorable"))
    firsts = firsts.select("session_id", "type", "norm", "value", "restorable", "first_ord.*")
    return firsts.join(keys, "session_id").groupBy("session_id").applyInPandas(run, "session_id string, type string, norm string, value string, restorable boolean, replacement string")


def replaced(decided: DataFrame, requests: DataFrame, earlier: DataFrame | None = None, keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities with their replacement, mappings). Order of use in a session: request, then segment if there are several, then place."""
    seg_no = F.col("seg_no") if "seg_no" in decided.columns else F.lit(0)
    kept = decided.where("kept").withColumn("ord", F.struct("seq", "request_id", seg_no.alias("seg_no"), "start"))
    mappings = assign_tokens(kept.where(F.col("action") == "tokenize"), requests, earlier)
    rows = kept.join(mappings.select("session_id", "type", "norm", "token"), ["session_id", "type", "norm"], "left")
    fake = F.lit(None).cast("string")
    if keys is not None:
        made = pseudonyms(kept.where(F.col("action") == "pseudonymize"), keys)
        rows = rows.join(made.select("session_id", "type", "norm", F.col("replacement").alias("fake")), ["session_id", "type", "norm"], "left")
        fake = F.col("fake")
        mappings = mappings.unionByName(made.select("session_id", "type", "norm", "value", "restorable", F.lit(None).cast("long").alias("number"), F.col("replacement").alias("token")))
    what = F.when(F.col("action") == "allow", None).when(F.col("action") == "tokenize", F.col("token")).when(F.col("action") == "pseudonymize", F.coalesce(fake, marker_col(F.col("type")))).otherwise(marker_col(F.col("type")))
    return rows.withColumn("replacement", what), mappings


def _summary(*more: Column) -> tuple[list[Column], list[Column]]:
    """Aggregates over kept entities (start, type, action, risk_rank), and what is read off them."""
    used = F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("start", "type", "action"))))
    made = [used.alias("used"), F.count_if("kept").alias("total"), F.max(F.when(F.col("kept"), F.col("risk_rank"))).alias("rank"), *more]
    types = F.array_sort(F.array_distinct(F.transform("used", lambda x: x.type)))
    counts = F.map_from_entries(F.transform(types, lambda t: F.struct(t, F.size(F.filter("used", lambda x: x.type == t)).cast("long"))))
    named = lambda *actions: F.array_distinct(F.transform(F.filter("used", lambda x: x.action.isin(*actions)), lambda x: x.type))
    risk = F.element_at(F.array(*map(F.lit, RISKS)), F.coalesce("rank", F.lit(0)) + 1)
    return made, [counts.alias("counts"), F.col("total"), risk.alias("risk"), named("redact").alias("removed"), named("allow").alias("retained"), named("tokenize", "pseudonymize").alias("tokenized"), named("block").alias("blocked_types")]


def summary_of(rows: DataFrame, key: str) -> DataFrame:
    """Counts by type, risk, and types by what was done with them in order of first use, from one aggregation."""
    made, read = _summary()
    return rows.withColumn("kept", F.lit(True)).groupBy(key).agg(*made).select(key, *read)


def requests_summary(rows: DataFrame, edit: Column | None = None) -> DataFrame:
    """Per request: the summary, edits, whether something blocks, and entities below the threshold (kept is false)."""
    edit = F.when(F.col("replacement").isNotNull(), F.struct("start", "end", F.col("replacement").alias("repl"))) if edit is None else edit
    made, read = _summary(F.collect_list(edit).alias("edits"), F.bool_or(F.col("action") == "block").alias("has_block"), F.count_if(~F.col("kept")).alias("below_threshold"))
    return rows.groupBy("request_id").agg(*made).select("request_id", *read, "edits", "has_block", "below_threshold")


def status_of(blocked: Column, incomplete: Column, warnings: Column, fail_mode: str) -> tuple[Column, Column, Column]:
    """(status, whether data is withheld, warnings): blocked before uncertain before safe.

    A text that was not scanned at all is never given out, in no fail mode; what was scanned in part is withheld if the mode is closed.
    """
    unread = F.exists(warnings, lambda w: (w == "TEXT_TOO_LARGE") | w.startswith("REFUSED"))
    status = F.when(blocked, "blocked").when(incomplete, "uncertain").otherwise("safe")
    closed = ~blocked & incomplete & F.lit(fail_mode == "closed")
    told = F.when(closed, F.concat(warnings, F.array(F.lit("FAIL_CLOSED_WITHHELD")))).otherwise(warnings)
    return status, blocked | unread | closed, told


NO_NAMES, NO_COUNTS = "cast(array() as array<string>)", "cast(map() as map<string, bigint>)"


def protect(requests: DataFrame, policy: Policy | str | dict | None = None, how: Detection | None = None, earlier: DataFrame | None = None, keys: DataFrame | None = None, registry: Registry | None = None) -> tuple[DataFrame, DataFrame]:
    """(a result for each request, the sessions' mappings). Texts are shuffled once, to meet what is to be replaced in them."""
    p = resolve_policy(policy)
    base, decided = decided_entities(requests, p, how, registry)
    rows, mappings = replaced(decided, requests, earlier, keys)
    low = decided.where(~F.col("kept")).select("request_id")
    rows = rows.select("request_id", "start", "end", "type", "action", "replacement", "risk_rank", F.lit(True).alias("kept")).unionByName(low.withColumn("kept", F.lit(False)), allowMissingColumns=True)
    per = requests_summary(rows)
    out = base.select("request_id", "session_id", "text", "warnings", "incomplete").join(per, "request_id", "left")
    none = F.expr(NO_NAMES)
    status, withheld, told = status_of(F.coalesce("has_block", F.lit(False)), F.col("incomplete"), F.coalesce("warnings", none), p.fail_mode)
    edited = F.when(F.col("edits").isNull(), F.col("text")).otherwise(splice(F.col("text"), F.col("edits")))
    lists = [F.coalesce(c, none).alias(c) for c in ("removed", "retained", "tokenized", "blocked_types")]
    return out.select(
        "request_id", "session_id", status.alias("status"), F.when(~withheld, edited).alias("safe_text"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("counts", F.expr(NO_COUNTS)).alias("counts"),
        F.coalesce("risk", F.lit("NONE")).alias("risk"), *lists, F.coalesce("below_threshold", F.lit(0)).alias("below_threshold"), told.alias("warnings"), "incomplete",
    ), mappings


#: The first run of these letters in a pseudonym is what a response is searched for first.
WORD = r"[A-Za-z0-9]+"
LOOSE = r"\[?(?<![A-Za-z0-9_])([A-Za-z][A-Za-z0-9]*(?:_[A-Za-z][A-Za-z0-9]*)*)[_ ](\d{3,})(?![A-Za-z0-9_])\]?"


def _restored_text(text: str, known: dict[str, dict]) -> tuple[str, int, int]:
    """(text with values for tokens, how many, how many bracketed tokens are unknown or may not be restored)."""
    from ..functions.rules import compiled

    pieces, at, done, missing = [], 0, 0, 0
    for m in compiled(LOOSE).finditer(text):
        found = known.get(f"[{m.group(1).upper()}_{m.group(2)}]")
        whole = m.group().startswith("[") and m.group().endswith("]")
        if found is None:
            missing += whole
        elif not found["restorable"]:
            missing += 1
        else:
            start, end = m.span() if whole else (m.start(1), m.end(2))  # brackets go in pairs only
            pieces += [text[at:start], found["value"]]
            at, done = end, done + 1
    body = "".join([*pieces, text[at:]])
    for fake in sorted((k for k in known if not k.startswith("[")), key=lambda k: (-len(k), k)):
        if known[fake]["restorable"] and fake in body:
            done += body.count(fake)
            body = body.replace(fake, known[fake]["value"])
    return body, done, missing


def _restore(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for text, known in zip(batch.column("text").to_pylist(), batch.column("known").to_pylist(), strict=True):
                got.append((None, 0, 0) if text is None else _restored_text(text, {m["token"]: m for m in known or []}))
            made = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, "data", "restored", "unrestored"])

    return run


def restored(responses: DataFrame, mappings: DataFrame) -> DataFrame:
    """responses (response_id, session_id, text, ...) with data, restored and unrestored: a session's own tokens, in loose spellings too, become their values again.

    Tokens and pseudonyms are looked up by what stands in the text (pseudonyms by their first word), so that a session's responses don't meet all its
    pseudonyms. A pseudonym that is glued to other letters or digits in front is not one.
    """
    loose = r"\b([A-Za-z][A-Za-z0-9]*(?:_[A-Za-z][A-Za-z0-9]*)*[_ ][0-9]{3,})\b"
    asked = responses.select("response_id", "session_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(loose), 1), lambda t: F.concat(F.lit("["), F.upper(F.regexp_replace(t, " ", "_")), F.lit("]"))))).alias("token"))
    hits = asked.join(mappings.select("session_id", "token", "value", "restorable"), ["session_id", "token"])
    fakes = mappings.where(~F.col("token").startswith("[")).select("session_id", "token", "value", "restorable", F.regexp_extract("token", WORD, 0).alias("word"))
    words = responses.select("response_id", "session_id", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), 0))).alias("word"))
    words = words.join(fakes.select("session_id", "word").distinct(), ["session_id", "word"], "left_semi")
    named = words.join(fakes, ["session_id", "word"]).where(F.contains("text", "token")).select("response_id", "token", "value", "restorable").distinct()
    known = hits.select("response_id", "token", "value", "restorable").unionByName(named).groupBy("response_id").agg(F.collect_list(F.struct("token", "value", "restorable")).alias("known"))
    keep = [c for c in responses.columns if c != "text"]
    rows = responses.join(known, "response_id", "left").select(*keep, "text", "known")
    schema = rows.select(*keep).schema.add("data", "string").add("restored", "integer").add("unrestored", "integer")
    return rows.mapInArrow(_restore(keep), schema)


def restore(responses: DataFrame, mappings: DataFrame) -> DataFrame:
    """(response_id, data, restored, unrestored) of responses (response_id, session_id, text)."""
    return restored(responses.select("response_id", "session_id", "text"), mappings).drop("session_id")


def release(responses: DataFrame, mappings: DataFrame, policy: Policy | str | dict | None = None, how: Detection | None = None) -> DataFrame:
    """Scans responses, applies the output policy to what the session did not place there, then restores tokens.

    A response that was not scanned at all is blocked; one scanned in part is blocked if the policy fails closed, else it is given out as
    warned. `warnings` says why.
    """
    p = resolve_policy(policy)
    spark = responses.sparkSession
    base = detect(responses.select("response_id", "session_id", "text"), how=how, values=True).persist(StorageLevel.MEMORY_AND_DISK)
    found = base.select("response_id", "session_id", F.explode("entities").alias("e")).select("response_id", "session_id", "e.*")
    rules = [(t, p.entities[t].min_confidence if t in p.entities else None, (p.entities[t].action if t in p.entities else p.default_action), p.output_entities.get(t, p.output_default)) for t in {*p.entities, *p.output_entities}]
    small = F.broadcast(spark.createDataFrame(rules, "type string, rule_min double, input_action string, output_action string"))  # a row for each type of the policy
    acted = found.join(small, "type", "left").where(F.col("confidence") >= F.coalesce("rule_min", F.lit(p.min_confidence)))
    placed = mappings.where(~F.col("token").startswith("[")).select("session_id", F.col("token").alias("value")).distinct()
    acted = acted.join(placed, ["session_id", "value"], "left_anti")
    acted = acted.where(F.coalesce("input_action", F.lit(p.default_action)) != "allow").withColumn("action", F.coalesce("output_action", F.lit(p.output_default))).where(F.col("action") != "allow")
    acted = acted.withColumn("repl", F.when(F.col("action").isin("redact", "tokenize"), marker_col(F.col("type"))))
    per = acted.groupBy("response_id").agg(
        F.bool_or(F.col("action") == "block").alias("blocked"), F.bool_or(F.col("action") == "warn").alias("warned"), F.count("*").alias("unexpected"),
        F.filter(F.collect_list(F.struct("start", "end", "repl")), lambda x: x.repl.isNotNull()).alias("edits"),
    )
    clean = base.select("response_id", "session_id", "text", "warnings", "incomplete").join(per, "response_id", "left")
    none = F.expr(NO_NAMES)
    _, withheld, told = status_of(F.coalesce("blocked", F.lit(False)), F.col("incomplete"), F.coalesce("warnings", none), p.fail_mode)
    told = F.when(F.col("unexpected") > 0, F.concat(told, F.array(F.lit("OUTPUT_SENSITIVE_DATA")))).otherwise(told)
    clean = clean.withColumn("text", F.when(F.col("edits").isNull(), F.col("text")).otherwise(splice(F.col("text"), F.col("edits"))))
    clean = clean.select("response_id", "session_id", "text", withheld.alias("withheld"), (F.coalesce("warned", F.lit(False)) | F.col("incomplete")).alias("warned"), F.coalesce("unexpected", F.lit(0)).alias("unexpected"), told.alias("warnings"))
    back = restored(clean, mappings if p.restore_tokens else mappings.limit(0))
    open_ = ~F.col("withheld")
    return back.select(
        "response_id", "session_id", F.when(~open_, "blocked").when(F.col("warned"), "warned").otherwise("safe").alias("status"), F.when(open_, F.col("data")).alias("data"),
        F.when(open_, F.col("restored")).otherwise(0).alias("restored"), F.when(open_, F.col("unrestored")).otherwise(0).alias("unrestored"), "unexpected", "warnings",
    )
