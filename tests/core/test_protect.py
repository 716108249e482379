import pytest
from pyspark.sql import Row

from cloakframe.operators.detect import Detection, Scanner, pattern_rule, timed
from cloakframe.operators.protect import protect, release
from cloakframe.plans.policy import built_in, load_policy, problems, resolve_policy

SCAN = Scanner(Detection())


def found(text, least=0.5):
    return [(s.type, text[s.start : s.end]) for s in SCAN(text)[0] if s.confidence >= least]


CASES = [
    ("Write to anna.k@example.com or b@y.io b2@y.io", [("EMAIL", "anna.k@example.com"), ("EMAIL", "b@y.io"), ("EMAIL", "b2@y.io")]),
    ("call (415) 555-0123 now", [("PHONE", "(415) 555-0123")]),
    ("phone: +91 98765 43210", [("PHONE", "+91 98765 43210")]),
    ("card 4111 1111 1111 1111 ok", [("CREDIT_CARD", "4111 1111 1111 1111")]),
    ("card 4111 1111 1111 1112 no", []),
    ("SSN 123-45-6789 and 000-12-3456", [("SSN", "123-45-6789")]),
    ("host 10.0.0.1 but version 1.2.3.4", [("IP_ADDRESS", "10.0.0.1")]),
    ("IBAN GB82 WEST 1234 5698 7654 32", [("IBAN", "GB82 WEST 1234 5698 7654 32")]),
    ("DOB: 12/03/1980, aged 44", [("DATE_OF_BIRTH", "12/03/1980"), ("AGE", "44")]),
    ("see https://wiki.corp/a. and https://example.com/b", [("INTERNAL_URL", "https://wiki.corp/a"), ("URL", "https://example.com/b")]),
    ("Patient name: RAVI KUMAR", [("PERSON", "RAVI KUMAR")]),
    ("Dear Priya Sharma, hello", [("PERSON", "Priya Sharma")]),
    ("at Apollo General Hospital today", [("HEALTHCARE_PROVIDER", "Apollo General Hospital")]),
    ("मरीज़ का नाम: राहुल शर्मा है", [("PERSON", "राहुल शर्मा")]),
    ("Portal password: Hunter2025!", [("PASSWORD", "Hunter2025!")]),
    ("id [EMAIL_001] stays", []),
    ("pay me@okaxis soon", [("UPI_ID", "me@okaxis")]),
    ("mac 00:1A:2b:3c:4D:5e", [("MAC_ADDRESS", "00:1A:2b:3c:4D:5e")]),
    ("addr 2001:db8::ff00:42:8329", [("IP_ADDRESS", "2001:db8::ff00:42:8329")]),
    ("postgres://u:p4ss@db.local:5432/x", [("DATABASE_URL", "postgres://u:p4ss@db.local:5432/x")]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_rules(text, want):
    assert found(text) == want


@pytest.mark.parametrize("text", ["1" * 50000, "1234 " * 10000, "a@" * 20000, "Aa " * 20000, "12 Aa " * 8000, "." * 50000, ":" * 50000, "http://" * 8000, "password=" * 5000, "राम " * 8000, "Mr. " * 10000, "\0\1\x1f" * 9000])
def test_hostile_texts_are_quick(text):
    assert timed(SCAN, text) < 6  # a bound for slow machines; the scan is linear


def test_own_detectors_and_failures():
    bad = Detection(rules=(pattern_rule("TICKET", "ticket", r"TCK-\d{4}"),), functions=(("broken", lambda t: 1 / 0),))
    spans, warnings, incomplete = Scanner(bad)("see TCK-1234")
    assert [s.type for s in spans] == ["TICKET"] and incomplete and warnings == ["DETECTOR_FAILED:broken"]
    with pytest.raises(ValueError):
        pattern_rule("TICKET", "x", "a*")
    assert Scanner(Detection(max_text_bytes=3))("abcd")[2]


def test_registered_queries_read_whole_texts():
    from cloakframe.queries import only

    spans, warnings, incomplete = Scanner(only("email"))("".join(f"u{i}@ex.org " for i in range(100_001)))
    assert len(spans) == 100_001 and not warnings and not incomplete
    spans, warnings, incomplete = Scanner(only("email"))("- " * (6 << 20) + "last@ex.org")
    assert len(spans) == 1 and not warnings and not incomplete


def test_texts_over_a_limit_are_withheld(spark):
    from cloakframe.limits import Limits
    from cloakframe.operators.protect import protect, release

    how = Limits(max_text_bytes=30).detection()
    asked = requests(spark, [("a", "s", "mail me: someone@example.org, or don't", None), ("b", "s", "hi someone@example.org", None)])
    results, mappings = protect(asked, "default", how)
    got = {r.request_id: r for r in results.collect()}
    assert got["a"].safe_text is None and got["a"].status == "uncertain" and got["b"].safe_text is not None
    said = spark.createDataFrame([("a", "s", "write to other@example.org, or better don't"), ("b", "s", "fine")], "response_id string, session_id string, text string")
    assert {r.response_id: r.data for r in release(said, mappings, "default", how).collect()} == {"a": None, "b": "fine"}


def requests(spark, rows):
    return spark.createDataFrame([Row(request_id=r, session_id=s, seq=k, text=t, purpose=p) for k, (r, s, t, p) in enumerate(rows)], "request_id string, session_id string, seq long, text string, purpose string")


def test_protect_and_release(spark):
    asked = requests(spark, [
        ("a", "s1", "Mail anna@example.com or ANNA@example.com, not bob@example.com [EMAIL_002]", None),
        ("b", "s1", "again bob@example.com", None), ("c", "s2", "bob@example.com", None), ("d", "s2", None, None), ("e", "s2", "nothing here", None),
    ])
    results, mappings = protect(asked)
    got = {r.request_id: r for r in results.collect()}
    assert got["a"].safe_text == "Mail [EMAIL_001] or [EMAIL_001], not [EMAIL_003] [EMAIL_002]"
    assert got["b"].safe_text == "again [EMAIL_003]" and got["c"].safe_text == "[EMAIL_001]"
    assert (got["a"].counts, got["a"].risk, got["a"].tokenized) == ({"EMAIL": 3}, "MEDIUM", ["EMAIL"])
    assert got["d"].safe_text is None and got["e"].safe_text == "nothing here" and got["e"].risk == "NONE"
    said = [("r1", "s1", "Hi [EMAIL_001], email_003 and [Email 001] [EMAIL_009]"), ("r2", "s2", "[EMAIL_003]"), ("r3", "s1", "new: carl@example.com card 4111 1111 1111 1111")]
    back = {r.response_id: r for r in release(spark.createDataFrame(said, "response_id string, session_id string, text string"), mappings).collect()}
    assert back["r1"].data == "Hi anna@example.com, bob@example.com and anna@example.com [EMAIL_009]" and (back["r1"].restored, back["r1"].unrestored) == (3, 1)
    assert back["r2"].data == "[EMAIL_003]" and back["r2"].unrestored == 1
    assert back["r3"].status == "warned" and back["r3"].data == "new: carl@example.com card [CREDIT_CARD_REDACTED]"


def test_purposes_blocks_and_pseudonyms(spark):
    asked = requests(spark, [("a", "s", "Dr. Anita Desai wrote to anna@example.com", "Billing"), ("b", "s", "Dr. Anita Desai", "risk summary"), ("c", "s", "card 4111 1111 1111 1111", None)])
    got = {r.request_id: r for r in protect(asked, "healthcare")[0].collect()}
    assert got["a"].safe_text == "Dr. [PERSON_001] wrote to [EMAIL_REDACTED]" and got["b"].safe_text == "Dr. [PERSON_REDACTED]"
    assert got["c"].status == "blocked" and got["c"].safe_text is None and got["c"].blocked_types == ["CREDIT_CARD"]
    keys = spark.createDataFrame([("s", b"k" * 32)], "session_id string, session_key binary")
    results, mappings = protect(asked, {"EMAIL": "pseudonymize"}, keys=keys)
    fake = {r.request_id: r.safe_text for r in results.collect()}["a"]
    assert "user" in fake and "anna@" not in fake
    back = release(spark.createDataFrame([("r", "s", fake)], "response_id string, session_id string, text string"), mappings).first()
    assert back.data == "Dr. Anita Desai wrote to anna@example.com"


def test_policies():
    assert built_in("default").entities["EMAIL"].action == "tokenize" and built_in("financial").purpose("AML patterns").id == "fraud-analysis"
    p = load_policy("name: clinic\nextends: healthcare\nentities:\n  EMAIL: Allow\n  PHONE: {action: block, minConfidence: 0.9}\n")
    assert (p.entities["EMAIL"].action, p.entities["PHONE"].min_confidence, p.fail_mode) == ("allow", 0.9, "closed")
    assert resolve_policy({"EMAIL": "block"}).name == "custom"
    assert {x for x, _ in problems({"failMode": "x", "entities": {"EMAIL": "nope"}, "what": 1})} == {"failMode", "entities.EMAIL", "what"}
    for bad in ("a: 1\na: 2", "x: &a [1]\ny: {<<: *a}", "failMode: sometimes"):
        with pytest.raises(ValueError):
            load_policy(bad)
    assert built_in("default").strict().min_confidence == 0.35
