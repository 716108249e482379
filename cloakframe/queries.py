"""Registered queries of the privacy operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rule_queries
from .functions import catalog, checks
from .functions.checks import language_supported
from .functions.fields import HINTS, field_type_col
from .functions.rules import PII_RULES
from .operators.detect import Detection, detect, entities_of
from .operators.geometry import image_text, layout, span_boxes
from .operators.json_protect import protect_json
from .operators.protect import assign_tokens, decided_entities, normal_udf, protect, release, summary_of
from .operators.sessions import destroyed, touched
from .operators.vault import opened, sealed, unexpired
from .operators.warnings import distinct_warnings
from .plans.policy import NAMES, built_in, decide, match_purposes, type_table
from .sql import register
from .streaming.monitor import sessions, windowed_counts

RULE = {r.id: r for r in PII_RULES}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(*ids: str) -> Detection:
    """These rules and nothing else."""
    return Detection(disabled=("pii", "secrets", "names"), rules=tuple(RULE[i] for i in ids))


def _values(spark: SparkSession, sf_dir: str, rule: str, source: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    rows = table(spark, sf_dir, source).select(key, F.col(text).alias("text"))
    found = entities_of(detect(rows, how=only(rule)), key, value_of="text")
    return found.groupBy(key, "value").agg(F.count("*").alias("n"))


def _spark_values(rule: str, **more):
    return lambda spark, sf_dir: _values(spark, sf_dir, rule, **more)


# SQL of single rules: runs of allowed characters that match as a whole, or matches after a consumed boundary.
_EDGE_L = r"(?:^|[^\p{L}\p{N}_])"


def _runs_sql(allowed: str, strip: str, whole: str, source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return rf"""
WITH r AS (SELECT {key}, unnest(regexp_extract_all({text}, '{allowed}')) AS run FROM {source}),
s AS (SELECT {key}, regexp_replace(regexp_replace(run, '{strip}$', ''), '^{strip}', '') AS value FROM r)
SELECT {key}, value, COUNT(*) AS n FROM s WHERE regexp_full_match(value, '{whole}') GROUP BY ALL"""


def _edges_sql(pattern: str, where: str = "true", source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return rf"""
WITH v AS (SELECT {key}, unnest(regexp_extract_all({text}, '{_EDGE_L}({pattern})\b', 1)) AS value FROM {source})
SELECT {key}, value, COUNT(*) AS n FROM v WHERE {where} GROUP BY ALL"""


EMAIL_WHOLE = r"[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}"
EMAIL_RUN, EMAIL_STRIP = r"[\p{L}\p{N}_.%+@\-]+", r"[._%+\-]+"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
CARD = r"[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}[0-9]{0,3}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}[0-9]{0,3}|[0-9]{4} [0-9]{6} [0-9]{4,5}|[0-9]{4}-[0-9]{6}-[0-9]{4,5}|[0-9]{13,19}"


def luhn_sql(digits: str) -> str:
    at = f"CAST(substr({digits}, length({digits}) - k + 1, 1) AS INTEGER)"
    return f"list_sum(list_transform(range(1, length({digits}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN {at} WHEN {at} > 4 THEN {at} * 2 - 9 ELSE {at} * 2 END)) % 10 = 0"


_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
EMAIL_SQL = _runs_sql(EMAIL_RUN, EMAIL_STRIP, EMAIL_WHOLE)
IPV4_SQL = _runs_sql(r"[\p{L}\p{N}_.]+", r"[.]+", rf"{OCTET}(?:\.{OCTET}){{3}}")
CARD_SQL = _edges_sql(CARD, f"regexp_matches({_DIGITS}, '{checks.CARD_PREFIX}') AND len(list_distinct(string_split({_DIGITS}, ''))) > 1 AND {luhn_sql(_DIGITS)}")
NANP_SQL = _edges_sql(r"(?:\+?1[ \t\n\r.\-]?)?(?:\([2-9][0-9]{2}\)[ \t\n\r]?|[2-9][0-9]{2}[ \t\n\r.\-])[2-9][0-9]{2}[ \t\n\r.\-][0-9]{4}")
PAGES_SQL = _runs_sql(EMAIL_RUN, EMAIL_STRIP, EMAIL_WHOLE, "pages", "page_id", "html")


def risk_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = entities_of(detect(docs, how=only("email", "ipv4", "card")), "doc_id", "source")
    ranked = found.join(F.broadcast(type_table(spark)), "type")  # a row for each built-in type
    by = ranked.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"), F.max("risk_rank").alias("rank"))
    return by.select("source", "n", "docs", F.element_at(F.array(*map(F.lit, catalog.RISKS)), F.col("rank") + 1).alias("risk"))


RISK_SQL = f"""
WITH e AS ({EMAIL_SQL}), i AS ({IPV4_SQL}), c AS ({CARD_SQL}),
a AS (SELECT doc_id, n, 2 AS rank FROM e UNION ALL SELECT doc_id, n, 1 FROM i UNION ALL SELECT doc_id, n, 3 FROM c)
SELECT source, CAST(SUM(n) AS BIGINT) AS n, COUNT(DISTINCT doc_id) AS docs, CASE MAX(rank) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk
FROM a JOIN documents USING (doc_id) GROUP BY source"""


def email_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    found = entities_of(detect(docs, how=only("email")), "lang", "source")
    return found.rollup("lang", "source").agg(F.count("*").alias("n"))


ROLLUP_SQL = f"WITH e AS ({EMAIL_SQL}) SELECT lang, source, CAST(SUM(n) AS BIGINT) AS n FROM e JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, source)"


def language_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", checks.language_col(F.col("text")).alias("language"))


LANGUAGE_SQL = r"""
WITH c AS (SELECT doc_id, length(regexp_replace(left(text, 20000), '[^\p{Latin}]', '', 'g')) AS l, length(regexp_replace(left(text, 20000), '[^\p{Devanagari}]', '', 'g')) AS d,
                  length(regexp_replace(left(text, 20000), '[^\p{Tamil}]', '', 'g')) AS t FROM documents),
s AS (SELECT *, l + d + t AS n FROM c)
SELECT doc_id, CASE WHEN n = 0 THEN NULL WHEN (l >= 0.15 * n)::INT + (d >= 0.15 * n)::INT + (t >= 0.15 * n)::INT > 1 THEN 'mixed'
  WHEN d >= 0.15 * n THEN 'hi' WHEN t >= 0.15 * n THEN 'ta' ELSE 'en' END AS language FROM s"""

_FIELD_WORDS = ["email", "E-Mail", "phone_number", "contact-number", "full_name", "FirstName", "first_name", "street", "addr", "dob", "userid", "user_id", "uid", "pan", "ssn", "card_no", "iban", "vpa", "pwd", "api-key", "id_token", "client_secret", "dsn", "mrn", "policy_no", "ip", "mac", "notes", "total", "email2", "names", "pan_card_number"]


def field_hint_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select((F.col("c_custkey") % len(_FIELD_WORDS)).cast("int").alias("k")).distinct()
    return names.select(F.element_at(F.array(*map(F.lit, _FIELD_WORDS)), F.col("k") + 1).alias("field")).select("field", field_type_col(F.col("field")).alias("type"))


FIELD_SQL = "WITH k AS (SELECT DISTINCT CAST(c_custkey % {n} AS INTEGER) AS k FROM customer), f AS (SELECT [{w}][k + 1] AS field FROM k) SELECT field, CASE {c} END AS type FROM f".format(
    n=len(_FIELD_WORDS), w=", ".join(f"'{w}'" for w in _FIELD_WORDS), c=" ".join(f"WHEN regexp_full_match(field, '(?i)({p.replace(chr(39), chr(39) * 2)})') THEN '{t}'" for t, p in HINTS)
)


def host_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    addresses = F.concat_ws(".", (k * 37) % 256, (k * 11) % 256, k % 256, F.lit(7))
    names = F.concat(F.lit("n"), k % 50, F.element_at(F.array(*map(F.lit, ("", ".corp", ".example.com", ".svc.", ".home.arpa", ".ORG"))), (k % 6 + 1).cast("int")))
    sixes = F.concat(F.element_at(F.array(*map(F.lit, ("fe80::", "[fd00::", "2001:db8::", "ff02::", "::ffff:10.0.0."))), (k % 5 + 1).cast("int")), k % 90 + 10, F.when(k % 5 == 1, "]").otherwise(""))
    hosts = table(spark, sf_dir, "customer").select(F.explode(F.array(addresses, names, sixes)).alias("host")).distinct()
    return hosts.select("host", checks.host_class_col(F.col("host")).alias("class"))


HOST_SQL = """
WITH h AS (SELECT DISTINCT (c_custkey * 37) % 256 AS a, (c_custkey * 11) % 256 AS b, c_custkey % 256 AS c FROM customer),
n AS (SELECT DISTINCT c_custkey % 50 AS i, c_custkey % 6 AS s FROM customer),
x AS (SELECT DISTINCT c_custkey % 5 AS p, c_custkey % 90 + 10 AS i FROM customer)
SELECT a || '.' || b || '.' || c || '.7' AS host, CASE WHEN a = 0 THEN 'unspecified' WHEN a = 127 THEN 'loopback'
  WHEN a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127) THEN 'private' WHEN a = 169 AND b = 254 THEN 'link-local'
  WHEN (a = 192 AND b = 0 AND c = 0) OR (a = 198 AND b IN (18, 19)) THEN 'reserved' WHEN a BETWEEN 224 AND 239 THEN 'multicast' WHEN a >= 240 THEN 'reserved' ELSE 'public' END AS class FROM h
UNION ALL SELECT 'n' || i || ['', '.corp', '.example.com', '.svc.', '.home.arpa', '.ORG'][s + 1], CASE WHEN s IN (2, 5) THEN 'public' ELSE 'internal-name' END FROM n
UNION ALL SELECT ['fe80::', '[fd00::', '2001:db8::', 'ff02::', '::ffff:10.0.0.'][p + 1] || i || CASE WHEN p = 1 THEN ']' ELSE '' END, ['link-local', 'private', 'public', 'multicast', 'private'][p + 1] FROM x"""


def _all_policies() -> list:
    return [built_in(n) for n in NAMES]


_PURPOSE_TEXTS = ["Billing", "clinical risk summary", "letter about a claim", "AML patterns", "anything", "fraud-analysis", "  CLINICAL-ANALYSIS ", "insurance invoice"]


def policy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic entities of line items under every policy: counts of kept entities by action and reason."""
    items = table(spark, sf_dir, "lineitem")
    types = sorted(catalog.CATEGORY)
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    rows = items.select(pick(types, F.col("l_partkey")).alias("type"), pick(NAMES, F.col("l_suppkey")).alias("policy"), pick(_PURPOSE_TEXTS, F.col("l_orderkey")).alias("purpose"), F.round(F.col("l_discount") * 10, 2).alias("confidence"))
    done = decide(rows, _all_policies()).where("kept")
    return done.groupBy("policy", "type", "action", "reason", "restorable").agg(F.count("*").alias("n"))


def _rows_sql(name: str, columns: list[str], rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"{name}({', '.join(columns)}) AS (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)})"


def _list_sql(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _purpose_sql() -> str:
    words = [(p.name, k, u.id, w) for p in _all_policies() for k, u in enumerate(p.purposes) for w in u.keywords]
    return _rows_sql("pw", ["policy", "ord", "purpose_id", "word"], words) + """,
hit AS (SELECT DISTINCT e.policy, e.purpose, pw.purpose_id, ord, CASE WHEN lower(trim(purpose)) = lower(purpose_id) THEN 1 ELSE 0 END AS exact, CASE WHEN lower(trim(purpose)) = lower(purpose_id) THEN 0 ELSE length(word) END AS n
        FROM (SELECT DISTINCT policy, purpose FROM e) e JOIN pw ON pw.policy = e.policy WHERE lower(trim(purpose)) = lower(purpose_id) OR contains(lower(trim(purpose)), word)),
pm AS (SELECT policy, purpose, purpose_id FROM hit QUALIFY row_number() OVER (PARTITION BY policy, purpose ORDER BY exact DESC, n DESC, ord) = 1)"""


DECISION_SQL = (
    "WITH " + _rows_sql("rl", ["policy", "type", "action"], [(p.name, t, r.action) for p in _all_policies() for t, r in p.entities.items()]) + ", "
    + _rows_sql("pe", ["policy", "purpose_id", "type", "action"], [(p.name, u.id, t, a) for p in _all_policies() for u in p.purposes for t, a in u.entities.items()]) + ", "
    + _rows_sql("po", ["policy", "least"], [(p.name, p.min_confidence) for p in _all_policies()])
    + f""",
e AS (SELECT {_list_sql(sorted(catalog.CATEGORY))}[CAST(l_partkey % {len(catalog.CATEGORY)} AS INTEGER) + 1] AS type, {_list_sql(NAMES)}[CAST(l_suppkey % {len(NAMES)} AS INTEGER) + 1] AS policy,
             {_list_sql(_PURPOSE_TEXTS)}[CAST(l_orderkey % {len(_PURPOSE_TEXTS)} AS INTEGER) + 1] AS purpose, round(l_discount * 10, 2) AS confidence FROM lineitem),
{_purpose_sql()},
d AS (SELECT e.policy, e.type, COALESCE(pe.action, rl.action, 'redact') AS action, CASE WHEN pe.action IS NOT NULL THEN 'purpose' WHEN rl.action IS NOT NULL THEN 'policy' ELSE 'default' END AS reason
      FROM e JOIN po USING (policy) LEFT JOIN pm ON pm.policy = e.policy AND pm.purpose = e.purpose LEFT JOIN rl ON rl.policy = e.policy AND rl.type = e.type
      LEFT JOIN pe ON pe.policy = e.policy AND pe.purpose_id = pm.purpose_id AND pe.type = e.type WHERE confidence >= least)
SELECT policy, type, action, reason, action IN ('tokenize', 'pseudonymize') AS restorable, COUNT(*) AS n FROM d GROUP BY ALL"""
)


def purpose_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    asked = table(spark, sf_dir, "orders").select(pick(NAMES, F.col("o_custkey")).alias("policy"), pick(_PURPOSE_TEXTS, F.col("o_orderkey")).alias("purpose"))
    return match_purposes(asked, _all_policies())


PURPOSE_SQL = (
    f"WITH e AS (SELECT {_list_sql(NAMES)}[CAST(o_custkey % {len(NAMES)} AS INTEGER) + 1] AS policy, {_list_sql(_PURPOSE_TEXTS)}[CAST(o_orderkey % {len(_PURPOSE_TEXTS)} AS INTEGER) + 1] AS purpose FROM orders), "
    + _purpose_sql() + " SELECT policy, purpose, purpose_id FROM pm"
)


def token_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as sessions: every address of a source has one token."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("session_id"), "doc_id", "text")
    found = entities_of(detect(docs, how=only("email")), "session_id", "doc_id", value_of="text")
    mentions = found.select("session_id", "type", "value", normal_udf("type", "value").alias("norm"), F.struct("doc_id", "start").alias("ord"), F.lit(True).alias("restorable"))
    return assign_tokens(mentions).select("session_id", "norm", "value", "token")


TOKEN_SQL = rf"""
WITH d AS (SELECT source, doc_id, regexp_extract_all(text, '{EMAIL_RUN}') AS runs FROM documents),
r AS (SELECT source, doc_id, unnest(runs) AS run, unnest(range(len(runs))) AS k FROM d),
s AS (SELECT source, doc_id, k, regexp_replace(regexp_replace(run, '{EMAIL_STRIP}$', ''), '^{EMAIL_STRIP}', '') AS value FROM r),
m AS (SELECT source, lower(value) AS norm, min((doc_id, k)) AS first, arg_min(value, (doc_id, k)) AS value FROM s WHERE regexp_full_match(value, '{EMAIL_WHOLE}') GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY first) AS n FROM m)
SELECT source AS session_id, norm, value, '[EMAIL_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END || ']' AS token FROM n"""


def validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.lpad((k * 7919).cast("string"), 16, "4").alias("card"), F.concat(F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("-"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("-"), F.lpad((k * 31 % 10000).cast("string"), 4, "0")).alias("ssn"), F.md5(k.cast("string")).alias("hex"))
    return rows.select("o_orderkey", checks.luhn_col(F.col("card")).alias("luhn"), checks.card_col(F.col("card")).alias("card_ok"), checks.ssn_col(F.col("ssn")).alias("ssn_ok"), F.round(checks.entropy_col(F.col("hex")), 6).alias("entropy"))


VALIDATOR_SQL = f"""
WITH v AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 AS VARCHAR), 16, '4') AS value, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS a, lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS g,
                  lpad(CAST(o_orderkey * 31 % 10000 AS VARCHAR), 4, '0') AS s, md5(CAST(o_orderkey AS VARCHAR)) AS hex FROM orders),
c AS (SELECT *, {luhn_sql('value')} AS luhn, list_filter(string_split(hex, ''), lambda x: x <> '') AS letters FROM v)
SELECT o_orderkey, luhn, luhn AND len(list_distinct(string_split(value, ''))) > 1 AND regexp_matches(value, '{checks.CARD_PREFIX}') AS card_ok,
  a NOT IN ('000', '666') AND a NOT LIKE '9%' AND g <> '00' AND s <> '0000' AS ssn_ok,
  round(-list_sum(list_transform(list_sort(list_distinct(letters)), lambda x: (len(list_filter(letters, lambda y: y = x)) / 32.0) * log2(len(list_filter(letters, lambda y: y = x)) / 32.0))), 6) AS entropy FROM c"""


def iban_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    value = F.concat(F.element_at(F.array(*map(F.lit, ("GB", "DE", "XX"))), (k % 3 + 1).cast("int")), F.lpad((k % 97).cast("string"), 2, "0"), F.when(k % 3 == 0, "WEST").otherwise(""), F.lpad((k * 104729).cast("string"), 18, "0"))
    value = F.when(k % 3 == 0, F.concat(F.substring(value, 1, 8), F.substring(value, 13, 14))).otherwise(value)
    return table(spark, sf_dir, "customer").select("c_custkey", value.alias("value")).select("c_custkey", "value", checks.iban_col(F.col("value")).alias("ok"))


IBAN_SQL = """
WITH b AS (SELECT c_custkey, c_custkey % 3 AS m, ['GB', 'DE', 'XX'][CAST(c_custkey % 3 AS INTEGER) + 1] || lpad(CAST(c_custkey % 97 AS VARCHAR), 2, '0') AS head, lpad(CAST(c_custkey * 104729 AS VARCHAR), 18, '0') AS num FROM customer),
v AS (SELECT c_custkey, CASE WHEN m = 0 THEN head || 'WEST' || substr(num, 5, 14) ELSE head || num END AS value FROM b),
n AS (SELECT *, array_to_string(list_transform(string_split(substr(value, 5) || substr(value, 1, 4), ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), '') AS digits FROM v)
SELECT c_custkey, value, CAST(digits AS HUGEINT) % 97 = 1 AND CASE substr(value, 1, 2) WHEN 'XX' THEN length(value) BETWEEN 15 AND 34 ELSE length(value) = 22 END AS ok FROM n"""


def ocr_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents as recognised words: their places in the text, summed up for each image."""
    split = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.posexplode(F.filter(F.split("text", r"[ \n]"), lambda w: w != "")).alias("word_no", "text")).withColumn("line", F.floor(F.col("word_no") / 9).cast("int"))
    return layout(split).groupBy("image_id").agg(F.count("*").alias("words"), F.max("char_end").alias("chars"), F.sum(F.col("char_start") * (F.col("word_no") % 7)).alias("weighed"))


OCR_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \n]'), lambda x: x <> '') AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS t, unnest(range(len(ws))) AS k FROM w),
s AS (SELECT doc_id, t, k, COALESCE(SUM(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM u)
SELECT doc_id AS image_id, COUNT(*) AS words, CAST(MAX(a + length(t)) AS BIGINT) AS chars, CAST(SUM(a * (k % 7)) AS BIGINT) AS weighed FROM s GROUP BY doc_id"""


def image_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised words of several lines: the text with its line breaks, mean confidence and quality, and boxes of spans over line ends."""
    split = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn", "role").alias("image_id"), F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("word_no", "text"))
    at = F.col("word_no")
    words = split.select("image_id", "word_no", "text", F.floor(at / 5).cast("int").alias("line"), (at % 5 * 50).cast("double").alias("x"), (F.floor(at / 5) * 20).cast("double").alias("y"), F.lit(40.0).alias("w"), F.lit(12.0).alias("h"), (F.col("word_no") * 37 % 100).cast("double").alias("confidence"))
    laid = layout(words)
    spans = laid.where("word_no = 4").select("image_id", (F.col("char_end") - 1).alias("start"), (F.col("char_end") + 2).alias("end"))
    boxes = span_boxes(laid, spans).groupBy("image_id").agg(F.count("*").alias("boxes"), F.sum("x").alias("left"), F.max(F.col("y") + F.col("h")).alias("bottom"))
    texts = image_text(laid).select("image_id", F.md5("text").alias("text_md5"), F.round("confidence", 4).alias("confidence"), F.coalesce("quality", F.lit("good")).alias("quality"))
    return texts.join(boxes, "image_id", "left").na.fill(0, ["boxes", "left", "bottom"])


IMAGE_TEXT_SQL = r"""
WITH w AS (SELECT conv_id || '-' || turn || '-' || role AS image_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM conversations),
u AS (SELECT image_id, unnest(ws) AS t, unnest(range(len(ws))) AS k FROM w),
l AS (SELECT image_id, k // 5 AS line, string_agg(t, ' ' ORDER BY k) AS t FROM u GROUP BY ALL),
x AS (SELECT image_id, string_agg(t, chr(10) ORDER BY line) AS t FROM l GROUP BY image_id),
c AS (SELECT image_id, AVG(CAST(k * 37 % 100 AS DOUBLE)) AS confidence, MAX(k) AS last FROM u GROUP BY image_id)
SELECT image_id, md5(x.t) AS text_md5, round(confidence, 4) AS confidence, CASE WHEN confidence < 40 THEN 'error' WHEN confidence < 60 THEN 'warning' ELSE 'good' END AS quality,
  CAST(CASE WHEN last >= 5 THEN 2 WHEN last = 4 THEN 1 ELSE 0 END AS BIGINT) AS boxes, CAST(CASE WHEN last >= 4 THEN 198 ELSE 0 END AS DOUBLE) AS left, CAST(CASE WHEN last >= 5 THEN 34 WHEN last = 4 THEN 14 ELSE 0 END AS DOUBLE) AS bottom
FROM x JOIN c USING (image_id)"""


def scalar_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars without a query of their own: check digits, field types, URLs and languages, through the SQL functions."""
    register(spark)
    k = F.col("c_custkey")
    number = F.concat(F.lit("23"), F.lpad((k * 7919 % 10**10).cast("string"), 10, "0"))
    url = F.concat(F.element_at(F.array(*map(F.lit, ("https://", "http://", "https://u:p@", "ftp://"))), (k % 4 + 1).cast("int")), F.element_at(F.array(*map(F.lit, ("example.com", "10.0.0.1", "wiki.corp"))), (k % 3 + 1).cast("int")), F.lit("/a"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", number.alias("number"), url.alias("url"))
    rows = rows.select("c_custkey", F.call_function("is_aadhaar", "number").alias("aadhaar"), F.call_function("is_public_url", "url").alias("public_url"))
    return rows.withColumn("language_ok", language_supported(["en", "hi"], F.element_at(F.array(*map(F.lit, ("en-GB", "ta", "mixed", "HI"))), (k % 4 + 1).cast("int"))))


SCALAR_SQL = f"""
WITH v AS (SELECT c_custkey, '23' || lpad(CAST(c_custkey * 7919 % 10000000000 AS VARCHAR), 10, '0') AS value FROM customer)
SELECT c_custkey, {rule_queries._verhoeff} AS aadhaar, c_custkey % 4 = 0 AND c_custkey % 3 = 0 AS public_url, c_custkey % 4 <> 1 AS language_ok FROM v"""


def output_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that hold an own token, another session's token, a new address and a card number, under three policies."""
    k = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(k.cast("string").alias("request_id"), k.cast("string").alias("session_id"), k.alias("seq"), F.concat(F.lit("write to c"), k.cast("string"), F.lit("@example.com")).alias("text"))
    only_mail = only("email", "card")
    results, mappings = protect(asked, {"EMAIL": "tokenize"}, only_mail)
    answer = F.element_at(F.array(F.concat(F.lit("to "), F.regexp_extract("safe_text", r"(\[.*\])", 1)), F.lit("to [EMAIL_007]"), F.lit("to new@example.org"), F.lit("card 4111 1111 1111 1111")), (F.col("request_id").cast("int") % 4 + 1))
    said = results.select(F.col("request_id").alias("response_id"), "session_id", answer.alias("text"))
    out = None
    for policy in ("default", "strict", "financial"):
        one = release(said, mappings, policy, only_mail).select(F.lit(policy).alias("policy"), "response_id", "status", "data", "restored", "unrestored", "unexpected")
        out = one if out is None else out.unionByName(one)
    return out


RELEASE_SQL = """
WITH p(policy, mail, card) AS (VALUES ('default', 'warn', 'redact'), ('strict', 'redact', 'redact'), ('financial', 'redact', 'block'))
SELECT policy, CAST(c_custkey AS VARCHAR) AS response_id,
  CASE WHEN c_custkey % 4 = 2 AND mail = 'warn' THEN 'warned' WHEN c_custkey % 4 = 3 AND card = 'block' THEN 'blocked' ELSE 'safe' END AS status,
  CASE c_custkey % 4 WHEN 0 THEN 'to c' || c_custkey || '@example.com' WHEN 1 THEN 'to [EMAIL_007]' WHEN 2 THEN CASE mail WHEN 'warn' THEN 'to new@example.org' ELSE 'to [EMAIL_REDACTED]' END
    ELSE CASE card WHEN 'redact' THEN 'card [CREDIT_CARD_REDACTED]' END END AS data,
  CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS restored, CASE WHEN c_custkey % 4 = 1 THEN 1 ELSE 0 END AS unrestored, CASE WHEN c_custkey % 4 >= 2 THEN 1 ELSE 0 END AS unexpected FROM customer, p"""


def audit_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(table(spark, sf_dir, "events"), "event_type")


AUDIT_SQL = "SELECT date_trunc('hour', ts) AS window_start, event_type, COUNT(*) AS n FROM events GROUP BY ALL"


def session_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events"), "user_id").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


SESSION_SQL = """
WITH g AS (SELECT user_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS first FROM events)
SELECT user_id, CAST(SUM(first) AS BIGINT) AS sessions, COUNT(*) AS events FROM g GROUP BY user_id"""


def _document_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("request_id"), F.col("source").alias("session_id"), F.col("doc_id").alias("seq"), "text")


def protect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document protected under the default policy; safe texts as digests."""
    results, _ = protect(_document_requests(spark, sf_dir))
    return results.select("request_id", "status", F.md5("safe_text").alias("safe_md5"), "total", "risk", F.array_join("tokenized", ",").alias("tokenized"), F.array_join("removed", ",").alias("removed"), "below_threshold")


def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return entities_of(detect(docs), "lang").groupBy("lang", "type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 3).alias("confidence"))


def minimization_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, decided = decided_entities(_document_requests(spark, sf_dir).withColumn("purpose", F.lit("billing")), "healthcare")
    got = summary_of(decided.where("kept"), "request_id")
    return got.select("request_id", "total", "risk", *[F.array_join(c, ",").alias(c) for c in ("removed", "retained", "tokenized", "blocked_types")])


def _conversation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    text = F.concat("text", F.lit(" email user"), (F.col("conv_id") % 7).cast("string"), F.lit("@example.com"))
    return turns.select(F.concat_ws("-", "conv_id", "turn", "role").alias("request_id"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), text.alias("text"))


def restore_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with an address in every turn: protected, then restored from the session's tokens."""
    asked = _conversation_requests(spark, sf_dir)
    results, mappings = protect(asked, {"EMAIL": "tokenize"}, only("email"))
    said = results.select(F.col("request_id").alias("response_id"), "session_id", F.col("safe_text").alias("text"))
    return release(said, mappings, {"EMAIL": "tokenize"}, only("email")).select("response_id", "status", F.md5("data").alias("data_md5"), "restored", "unrestored")


ROUNDTRIP_SQL = "SELECT concat_ws('-', conv_id, turn, role) AS response_id, 'safe' AS status, md5(text || ' email user' || (conv_id % 7) || '@example.com') AS data_md5, 1 AS restored, 0 AS unrestored FROM conversations"


def json_protect_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of customers; every seventh is null, every eleventh is cut off and no JSON."""
    c = table(spark, sf_dir, "customer")
    contact = F.struct(F.concat(F.lit("c"), F.col("c_custkey"), F.lit("@example.com")).alias("email"))
    doc = F.to_json(F.struct(F.concat(F.lit("Customer "), F.col("c_custkey").cast("string")).alias("name"), contact.alias("contact"), F.col("c_acctbal").alias("balance")))
    doc = F.when(F.col("c_custkey") % 7 == 0, None).when(F.col("c_custkey") % 11 == 0, F.substring(doc, 1, 20)).otherwise(doc)
    asked = c.select(F.col("c_custkey").cast("string").alias("request_id"), F.col("c_nationkey").cast("string").alias("session_id"), F.col("c_custkey").alias("seq"), doc.alias("document"))
    results, _ = protect_json(asked)
    # a name and an address in each document; numbers of tokens follow the session's order
    safe = F.col("safe_document")
    return results.select("request_id", "status", "total", "risk", F.array_join("tokenized", ",").alias("tokenized"), F.array_join("warnings", ",").alias("warnings"), F.get_json_object(safe, "$.name").alias("name"), F.get_json_object(safe, "$.contact.email").alias("email"))


JSON_SQL = """
WITH k AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN 'null' WHEN c_custkey % 11 = 0 THEN 'bad' ELSE 'good' END AS kind FROM customer),
n AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM k WHERE kind = 'good'),
t AS (SELECT k.c_custkey, kind, CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS d FROM k LEFT JOIN n USING (c_custkey))
SELECT CAST(c_custkey AS VARCHAR) AS request_id, CASE kind WHEN 'bad' THEN 'uncertain' ELSE 'safe' END AS status, CASE kind WHEN 'good' THEN 2 ELSE 0 END AS total, CASE kind WHEN 'good' THEN 'MEDIUM' ELSE 'NONE' END AS risk,
  CASE kind WHEN 'good' THEN 'PERSON,EMAIL' ELSE '' END AS tokenized, CASE kind WHEN 'bad' THEN 'REFUSED:not JSON' ELSE '' END AS warnings, '[PERSON_' || d || ']' AS name, '[EMAIL_' || d || ']' AS email FROM t"""


def session_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings of suppliers with a life of an hour; a third of the sessions is used again after 40 minutes, one of seven is destroyed; what is left after 70 minutes."""
    minutes = lambda n: F.timestamp_seconds(F.lit(60 * n))
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select((k % 30).cast("string").alias("session_id"), F.concat(F.lit("[EMAIL_"), k.cast("string"), F.lit("]")).alias("token"), minutes(60).alias("expires_at"))
    sessions_ = rows.select("session_id").distinct()
    used = sessions_.where(F.col("session_id").cast("int") % 3 == 0).withColumn("used_at", minutes(40))
    rows = destroyed(touched(rows, used, 3600), sessions_.where(F.col("session_id").cast("int") % 7 == 0))
    return unexpired(rows, minutes(70)).select("session_id", "token", F.unix_timestamp("expires_at").alias("expires"))


LIFECYCLE_SQL = "SELECT CAST(s_suppkey % 30 AS VARCHAR) AS session_id, '[EMAIL_' || s_suppkey || ']' AS token, CAST(6000 AS BIGINT) AS expires FROM supplier WHERE (s_suppkey % 30) % 3 = 0 AND (s_suppkey % 30) % 7 <> 0"


def vault_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encrypted mappings open under their own key and binding only."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("session_id"), F.lit("PERSON").alias("type"), F.col("s_name").alias("value"), F.concat(F.lit("[PERSON_"), F.col("s_suppkey").cast("string"), F.lit("]")).alias("token"), F.lit(True).alias("restorable"))
    key = spark.range(1).select(F.sha2(F.lit("test key"), 256).alias("h")).select(F.unhex("h").alias("secret"))
    box = sealed(rows, key)
    moved = opened(box.withColumn("type", F.when(F.length("token") % 2 == 0, "EMAIL").otherwise(F.col("type"))), key)
    return moved.select("session_id", "token", "value")


VAULT_SQL = "SELECT CAST(s_nationkey AS VARCHAR) AS session_id, '[PERSON_' || s_suppkey || ']' AS token, s_name AS value FROM supplier WHERE length('[PERSON_' || s_suppkey || ']') % 2 = 1"


def warning_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of equal warnings (code, message, page) of a request."""
    ev = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("request_id"), F.col("event_type").alias("code"), F.lit("").alias("message"), (F.col("event_id") % 3).cast("int").alias("page"), F.col("event_id").alias("ord"))
    return distinct_warnings(ev).select(F.col("request_id").alias("request"), "code", "page", F.col("ord").alias("event_id"))


WARNING_SQL = "SELECT user_id % 50 AS request, event_type AS code, event_id % 3 AS page, MIN(event_id) AS event_id FROM events GROUP BY ALL"

QUERIES = {
    "protect_documents": protect_documents, "detect_email": _spark_values("email"), "detect_ipv4": _spark_values("ipv4"), "detect_card": _spark_values("card"), "detect_phone_nanp": _spark_values("phone-nanp"),
    "detect_email_pages": _spark_values("email", source="pages", key="page_id", text="html"), "risk_by_source": risk_by_source, "email_rollup": email_rollup, "language_guess": language_guess, "field_hint_types": field_hint_types,
    "host_classes": host_classes, "policy_decisions": policy_decisions, "purpose_match": purpose_match, "token_assignment": token_assignment, "validators": validators, "iban_checks": iban_checks, "ocr_layout": ocr_layout,
    "audit_windowed_counts": audit_windowed_counts, "session_ttl": session_ttl, "scan_summary": scan_summary, "minimization_report": minimization_report, "restore_roundtrip": restore_roundtrip, "json_protect_customer": json_protect_customer,
    "vault_roundtrip": vault_roundtrip, "warning_dedup": warning_dedup, "session_lifecycle": session_lifecycle, "image_text": image_texts, "scalar_checks": scalar_checks, "output_release": output_release,
}
SQL = {
    "detect_email": EMAIL_SQL, "detect_ipv4": IPV4_SQL, "detect_card": CARD_SQL, "detect_phone_nanp": NANP_SQL, "detect_email_pages": PAGES_SQL, "risk_by_source": RISK_SQL, "email_rollup": ROLLUP_SQL, "language_guess": LANGUAGE_SQL,
    "field_hint_types": FIELD_SQL, "host_classes": HOST_SQL, "policy_decisions": DECISION_SQL, "purpose_match": PURPOSE_SQL, "token_assignment": TOKEN_SQL, "validators": VALIDATOR_SQL, "iban_checks": IBAN_SQL, "ocr_layout": OCR_SQL,
    "audit_windowed_counts": AUDIT_SQL, "session_ttl": SESSION_SQL, "restore_roundtrip": ROUNDTRIP_SQL, "json_protect_customer": JSON_SQL, "vault_roundtrip": VAULT_SQL, "warning_dedup": WARNING_SQL, "session_lifecycle": LIFECYCLE_SQL, "image_text": IMAGE_TEXT_SQL, "scalar_checks": SCALAR_SQL, "output_release": RELEASE_SQL,
}
QUERIES |= rule_queries.QUERIES
SQL |= rule_queries.SQL
