import pytest
from pyspark.sql import Row
from test_functions import word_file

import __spark_entry__
from cloakframe.__main__ import main
from cloakframe.limits import Limits
from cloakframe.operators.files import protect_files
from cloakframe.operators.generate import audit, generate, prompt
from cloakframe.operators.protect import decided_entities, protect
from cloakframe.operators.vault import opened, sealed
from cloakframe.sources.docx import docx_segments
from cloakframe.sql import register


def test_files(spark):
    doc = word_file("<w:p><w:t>Mail anna@example.com</w:t></w:p>")
    rows = [("a", "d.docx", doc), ("b", "t.txt", b"card 4111 1111 1111 1111"), ("c", "p.png", b"\x89PNG\r\n\x1a\n1"), ("d", "e.txt", b"")]
    files = spark.createDataFrame([Row(request_id=r, session_id="s", seq=k, path=p, content=bytearray(c)) for k, (r, p, c) in enumerate(rows)])
    got = {r.request_id: r for r in protect_files(files)[0].collect()}
    assert docx_segments(bytes(got["a"].content))[0].text == "Mail [EMAIL_001]\n"
    assert bytes(got["b"].content) == b"card [CREDIT_CARD_REDACTED]"
    assert (got["c"].status, got["c"].warnings, got["c"].content) == ("uncertain", ["OCR_UNAVAILABLE"], None)
    assert got["d"].warnings == ["REFUSED:empty"]
    seen = {r.request_id: r for r in protect_files(files, plugins={"png": lambda b: ["mail bob@example.com"]})[0].collect()}
    assert (seen["c"].status, seen["c"].total) == ("safe", 1)


def test_sql(spark):
    register(spark)
    spark.createDataFrame([(1, "anna@example.com at 10.0.0.1"), (2, None)], "doc_id long, text string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT doc_id, e.type FROM texts, LATERAL detect_entities(text) e ORDER BY e.start").collect()
    assert [tuple(r) for r in got] == [(1, "EMAIL"), (1, "IP_ADDRESS")]
    assert spark.sql("SELECT is_card('4111111111111111') AND host_class('10.0.0.1') = 'private' AND field_type('e-mail') = 'EMAIL'").first()[0]


def test_generate_and_audit(spark):
    asked = spark.createDataFrame([Row(request_id="a", session_id="s", seq=1, text="write to anna@example.com"), Row(request_id="b", session_id="s", seq=2, text="card 4111 1111 1111 1111")])
    got = {r.request_id: r for r in generate(asked, lambda t: t.replace("write to", "wrote to"), "enterprise").collect()}
    assert got["a"].data == "wrote to anna@example.com" and got["b"].status == "blocked" and got["b"].data is None
    _, decided = decided_entities(asked, "enterprise")
    rows = audit(decided, protect(asked, "enterprise")[0]).collect()
    assert sorted(r.event for r in rows) == ["ENTITY_PROTECTED", "ENTITY_PROTECTED", "REQUEST_BLOCKED", "REQUEST_COMPLETED"] and "anna" not in str(rows)
    assert prompt({"a": 1}, "be brief")[1]["content"] == '{\n  "a": 1\n}'


def test_tokens_go_on_in_later_batches(spark):
    first = spark.createDataFrame([Row(request_id="a", session_id="s", seq=1, text="x@y.io")])
    second = spark.createDataFrame([Row(request_id="b", session_id="s", seq=2, text="z@y.io X@y.io")])
    _, mappings = protect(first)
    assert protect(second, earlier=mappings)[0].first().safe_text == "[EMAIL_002] [EMAIL_001]"


def test_vault(spark):
    _, mappings = protect(spark.createDataFrame([Row(request_id="a", session_id="s", seq=1, text="x@y.io")]))
    key, other = (spark.createDataFrame([(bytearray(k * 32),)], "secret binary") for k in (b"k", b"j"))
    box = sealed(mappings, key)
    assert "value" not in box.columns and opened(box, key).first().value == "x@y.io" and opened(box, other).count() == 0
    assert "6b6b6b" not in box._jdf.queryExecution().toString().lower()


def test_command_line(tmp_path, capsys):
    (tmp_path / "t.txt").write_text("anna@example.com")
    (tmp_path / "bad.yaml").write_text("failMode: never")
    assert main(["scan", str(tmp_path / "t.txt")]) == 0 and "EMAIL" in capsys.readouterr().out
    assert main(["policy", str(tmp_path / "bad.yaml")]) == 2 and main(["lists"]) == 0 and main(["doctor"]) == 0 and main(["scan", str(tmp_path / "none")]) == 1


def test_limits():
    assert Limits(max_text_bytes=5).detection().max_text_bytes == 5
    for bad in (0, -1, float("inf"), float("nan"), True):
        with pytest.raises(ValueError):
            Limits(max_entities=bad)


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
