import io
import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from cloakframe.functions import checks
from cloakframe.functions.fields import field_type
from cloakframe.functions.values import normal, pseudonym
from cloakframe.operators.geometry import image_text, layout, span_boxes
from cloakframe.operators.json_protect import protect_json
from cloakframe.operators.protect import protect
from cloakframe.sources.docx import docx_apply, docx_segments, read_zip
from cloakframe.sources.json_doc import rewritten, segments
from cloakframe.sources.sniff import extension_col, file_problem_col, format_col
from cloakframe.streaming.monitor import detected_stream, sessions, windowed_counts


def test_validators_agree_with_native_expressions(spark):
    values = ["4111 1111 1111 1111", "4111111111111112", "378282246310005", "0", "", "2363", "236", "234123412346", "123-45-6789", "000-12-3456", "900121234", "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765431", "DE89370400440532013000", "XX00", "aaaa", "a1b2c3d4"]
    rows = spark.createDataFrame([Row(v=v) for v in values]).select("v", checks.card_col(F.col("v")).alias("card"), checks.luhn_col(F.col("v")).alias("luhn"), checks.verhoeff_col(F.col("v")).alias("verhoeff"), checks.aadhaar_col(F.col("v")).alias("aadhaar"), checks.ssn_col(F.col("v")).alias("ssn"), checks.iban_col(F.col("v")).alias("iban"), checks.entropy_col(F.col("v")).alias("entropy")).collect()
    for r in rows:
        for name in ("card", "luhn", "verhoeff", "aadhaar", "ssn", "iban"):
            assert bool(r[name]) == getattr(checks, name)(r.v), (name, r.v)
        assert r.entropy == pytest.approx(checks.entropy(r.v), abs=1e-9)
    assert checks.verhoeff("2363") and not checks.verhoeff("2364") and checks.iban("DE89 3704 0044 0532 0130 00")


@pytest.mark.parametrize(("host", "want"), [("10.1.2.3", "private"), ("127.0.0.1", "loopback"), ("localhost", "loopback"), ("0.0.0.0", "unspecified"), ("169.254.169.254", "metadata"), ("169.254.1.1", "link-local"), ("224.0.0.1", "multicast"), ("250.1.1.1", "reserved"), ("198.18.0.1", "reserved"), ("100.64.1.1", "private"), ("8.8.8.8", "public"), ("[::1]", "loopback"), ("::ffff:10.0.0.1", "private"), ("fe80::1", "link-local"), ("fd12::1", "private"), ("2130706433", "reserved"), ("intranet", "internal-name"), ("a.svc", "internal-name"), ("example.com.", "public"), ("metadata.google.internal", "metadata")])
def test_hosts(host, want):
    assert checks.host_class(host) == want


def test_fields_and_values():
    assert [field_type(x) for x in ("E-Mail", "first_name", "PIN", "note", "email\n")] == ["EMAIL", "PERSON", "PASSWORD", None, None]
    assert normal("EMAIL", " Ａnna@X.io ") == "anna@x.io" and normal("PHONE", "+91 98765 43210") == "9876543210" and normal("IBAN", "gb82 west-1") == "GB82WEST1"
    assert pseudonym(b"k", "EMAIL", "a@b.io") == pseudonym(b"k", "EMAIL", "A@B.io") != pseudonym(b"j", "EMAIL", "a@b.io")
    assert [c.isdigit() for c in pseudonym(b"k", "PASSPORT", "A12-3")] == [False, True, True, False, True]


json_values = st.recursive(st.none() | st.booleans() | st.integers(-999, 999) | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=5).filter(lambda k: k not in ("__proto__", "constructor", "prototype")), x, max_size=3), max_leaves=12)


@given(json_values)
@settings(max_examples=80, deadline=None)
def test_json_without_edits_stays(value):
    text = json.dumps(value)
    assert json.loads(rewritten(text, [t for t, _ in segments(text)])) == value


def test_json_documents(spark):
    doc = {"name": "Zed", "contact": {"email": "zed@example.com", "phone": 4155550123}, "notes": ["mail zed@example.com", "x"], "age": 41, "active": True, "nothing": None}
    asked = spark.createDataFrame([Row(request_id="a", session_id="s", seq=1, document=json.dumps(doc))])
    out = json.loads(protect_json(asked)[0].first().safe_document)
    assert out == {"name": "[PERSON_001]", "contact": {"email": "[EMAIL_001]", "phone": "[PHONE_001]"}, "notes": ["mail [EMAIL_001]", "x"], "age": 41, "active": True, "nothing": None}
    assert list(out) == list(doc)


def word_file(body, **more):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document><w:body>{body}</w:body></w:document>")
        z.writestr("docProps/core.xml", "<cp><dc:creator>Ann</dc:creator></cp>")
        for k, v in more.items():
            z.writestr(k, v)
    return buffer.getvalue()


def test_word_documents():
    content = word_file("<w:p><w:r><w:t>Mail an</w:t></w:r><w:r><w:t>na@x.io &amp; co</w:t></w:r></w:p><w:p><w:t>two</w:t></w:p>")
    found = docx_segments(content)
    assert [s.text for s in found] == ["Mail anna@x.io & co\ntwo\n"]
    out = read_zip(docx_apply(content, [(0, 5, 14, "[EMAIL_001]")]))
    xml = out["word/document.xml"].decode()
    assert "<w:t>Mail [EMAIL_001]</w:t>" in xml and "<w:t> &amp; co</w:t>" in xml and b"Ann" not in out["docProps/core.xml"]
    for bad in (word_file("", **{"word/vbaProject.bin": "x"}), word_file("", **{"../x": "y"}), word_file("", **{"word/x.xml": "<!DOCTYPE a>"}), word_file("", **{"big": "0" * (3 << 20)})):
        with pytest.raises(ValueError):
            buffer = io.BytesIO(bad)
            if b"big" in bad:  # a compressed bomb
                out_ = io.BytesIO()
                with zipfile.ZipFile(buffer) as z, zipfile.ZipFile(out_, "w", zipfile.ZIP_DEFLATED) as w:
                    for e in z.namelist():
                        w.writestr(e, z.read(e))
                bad = out_.getvalue()
            docx_segments(bad)


def test_files(spark):
    rows = [(b"\x89PNG\r\n\x1a\n123", "a/b.png", None), (b"\xff\xd8\xff\xe0", "x.png", None), (b"xx %PDF-1.7", "q.pdf", "application/pdf"), (b"PK\x03\x04..", ".docx", None), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "o.doc", None), (b"", "e.txt", None), (b"GIF89a", "g.gif", "image/png")]
    df = spark.createDataFrame([Row(content=bytearray(c), path=p, mime=m) for c, p, m in rows], "content binary, path string, mime string")
    got = df.select(format_col(F.col("content")).alias("f"), extension_col(F.col("path")).alias("e"), file_problem_col(F.col("content"), F.col("path"), F.col("mime")).alias("p")).collect()
    assert [r.f for r in got] == ["png", "jpeg", "pdf", "zip", "ole", "unknown", "gif"]
    assert [r.e for r in got] == ["png", "png", "pdf", None, "doc", "txt", "gif"]
    assert [r.p for r in got] == [None, None, None, None, "legacy document", "empty", "mime mismatch"]


def test_words_and_boxes(spark):
    words = spark.createDataFrame([Row(image_id=1, word_no=k, text=t, confidence=c, x=x, y=y, w=10.0, h=5.0, line=line) for k, (t, c, x, y, line) in enumerate([("Mail", 90.0, 0.0, 0.0, 0), ("anna", 50.0, 12.0, 0.0, 0), ("now", 10.0, 0.0, 8.0, 1)])])
    laid = layout(words)
    assert (image_text(laid).first().text, image_text(laid).first().quality) == ("Mail anna\nnow", "warning")
    boxes = span_boxes(laid, spark.createDataFrame([(1, 5, 13)], "image_id long, start int, end int")).orderBy("line").collect()
    assert [(b.x, b.y, b.w, b.h) for b in boxes] == [(10.0, 0.0, 14.0, 7.0), (0.0, 6.0, 12.0, 9.0)]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("1", "2026-01-01 10:00:00", "mail a@b.io"), ("2", "2026-01-01 10:30:00", "x"), ("3", "2026-01-01 13:00:00", "a@b.io c@d.io")], "request_id string, ts string, text string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = detected_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    counts = windowed_counts(stream, "type")
    query = counts.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.n for r in spark.table("counts").collect()) == [1, 2]
    own = sessions(rows.withColumn("k", F.lit(1)), "k").orderBy("started").collect()
    assert [r.n for r in own] == [2, 1]


def test_no_values_leave_by_default(spark):
    asked = spark.createDataFrame([Row(request_id="a", session_id="s", seq=1, text="anna@example.com and 4111 1111 1111 1111")])
    results, _ = protect(asked)
    assert "anna@" not in str(results.collect()) and "4111" not in str(results.collect())
