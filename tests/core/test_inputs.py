import json
import zlib

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Row
from test_functions import word_file

from cloakframe.functions.checks import public_url, supports_language
from cloakframe.keys import key_from_passphrase, key_of, key_table, new_key
from cloakframe.limits import Limits
from cloakframe.logs import safe_fields
from cloakframe.operators.detect import Detection
from cloakframe.operators.files import protect_files
from cloakframe.operators.images import protect_images
from cloakframe.operators.json_protect import protect_json
from cloakframe.operators.protect import protect, release
from cloakframe.operators.providers import ProviderError, answer_of, provider, request_of
from cloakframe.operators.sinks import save_files, save_results
from cloakframe.operators.vault import opened, sealed
from cloakframe.plans.policy import issues
from cloakframe.registry import Registry
from cloakframe.sources.docx import docx_apply, docx_read, read_zip
from cloakframe.sources.image import painted, read_png, write_png
from cloakframe.sources.pdf import pdf_pages, read_pdf


def pdf(pages, packed=True, extra=b""):
    """A file of one font, a content stream for each page."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica " + extra + b">>"]
    kids = []
    for c in pages:
        raw = zlib.compress(c) if packed else c
        objects.append(b"<< /Length %d %s>>\nstream\n" % (len(raw), b"/Filter /FlateDecode " if packed else b"") + raw + b"\nendstream")
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % len(objects))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<< /Type /Pages /Resources << /Font << /F1 3 0 R >> >> /Kids [" + b" ".join(kids) + b"] >>"
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % (i + 1) + o + b"\nendobj\n" for i, o in enumerate(objects)) + b"trailer << /Root 1 0 R >>"


PAGE = rb"BT /F1 12 Tf 72 700 Td (Mail anna@example.com) Tj 0 -14 Td [(Pho)-20(ne)-300(\(415\) 555-0123)] TJ ET"


@pytest.mark.parametrize("packed", [True, False])
def test_pdf_text(packed):
    assert pdf_pages(pdf([PAGE], packed)) == (["Mail anna@example.com\nPhone (415) 555-0123"], [])
    assert pdf_pages(pdf([PAGE, b"BT (x) Tj ET"], packed))[1] == ["PDF_SCANNED_PAGE"]
    mapped = zlib.compress(b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfrange <0001> <0003> <0061> endbfrange 1 beginbfchar <0009> <00e9> endbfchar")
    content = pdf([b"BT /F1 9 Tf <000100020003> Tj T* <0009> Tj (\x00\x01) Tj ET"], packed, b"/ToUnicode 99 0 R ") + b"\n99 0 obj\n<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(mapped) + mapped + b"\nendstream\nendobj\n"
    assert pdf_pages(content)[0] == ["abc\néa"]


def test_damaged_pdf_files():
    whole = pdf([PAGE])
    for cut in range(0, len(whole), 37):
        for content in (whole[:cut], whole[cut:], whole[:cut] + b"\0<<[(" + whole[cut:]):
            try:
                pdf_pages(content)
            except ValueError:
                pass
    with pytest.raises(ValueError):
        read_pdf(whole + b"/Encrypt")


def test_word_attributes_and_media():
    body = '<w:p><w:hyperlink w:tooltip="mail anna@x.io"><w:t>see</w:t></w:hyperlink></w:p><wp:docPr descr="photo of bob@x.io" title=""/>'
    found, warnings = docx_read(word_file(body))
    assert [s.text for s in found] == ["see\n", "mail anna@x.io", "photo of bob@x.io"] and warnings == []
    rels = {"word/_rels/document.xml.rels": '<Relationships><Relationship Id="1" TargetMode="External" Target="mailto:anna@x.io"/><Relationship Target="in.xml"/></Relationships>'}
    content = word_file(body, **rels, **{"word/media/image1.png": b"x", "word/people.xml": '<w15:person w15:author="Ann"/>', "docProps/custom.xml": "<vt:lpwstr>Ann</vt:lpwstr>"})
    found, warnings = docx_read(content)
    assert "mailto:anna@x.io" in [s.text for s in found] and warnings == ["EMBEDDED_MEDIA_NOT_INSPECTED"]
    out = read_zip(docx_apply(content, [(1, 5, 14, '[EMAIL_001]"')]))
    assert 'w:tooltip="mail [EMAIL_001]&quot;"' in out["word/document.xml"].decode() and b"Ann" not in b"".join(out.values())
    assert docx_read(word_file("<w:t><![CDATA[anna@x.io]]></w:t>"))[1] == ["DOCUMENT_STRUCTURE_UNSUPPORTED"]
    assert docx_read(word_file("<w:t>a<!-- x --> anna@x.io</w:t>"))[1] == ["DOCUMENT_STRUCTURE_UNSUPPORTED"]


def test_files_that_are_read_in_part(spark):
    """Nothing that was not inspected comes back as safe."""
    rows = [
        ("media", "d.docx", word_file("<w:p><w:t>Mail anna@example.com</w:t></w:p>", **{"word/media/a.png": b"x"})), ("pdf", "p.pdf", pdf([PAGE])), ("scan", "s.pdf", pdf([b"BT ET"])), ("bad", "b.pdf", b"%PDF-1.4 nothing"),
        ("zip", "z.docx", b"PK\x03\x04 no archive"), ("long", "l.txt", b"anna@example.com " * 40), ("text", "t.txt", b"anna@example.com"), ("none", "n.docx", word_file("")),
    ]
    files = spark.createDataFrame([Row(request_id=r, session_id="s", seq=k, path=p, content=bytearray(c)) for k, (r, p, c) in enumerate(rows)])
    how = Limits(max_text_bytes=300).detection()
    got = {p: {r.request_id: r for r in protect_files(files, p, how)[0].collect()} for p in ("default", "strict")}
    open_, closed = got["default"], got["strict"]
    assert {r: x.status for r, x in open_.items()} == {"media": "uncertain", "pdf": "safe", "scan": "uncertain", "bad": "uncertain", "zip": "uncertain", "long": "uncertain", "text": "safe", "none": "safe"}
    assert open_["pdf"].text == "Mail [EMAIL_001]\nPhone [PHONE_001]".replace("001", open_["pdf"].text[12:15], 1) and open_["pdf"].total == 2
    assert open_["media"].content is not None and closed["media"].content is None and "FAIL_CLOSED_WITHHELD" in closed["media"].warnings
    assert all(x[r].content is None and x[r].text is None for x in (open_, closed) for r in ("long", "bad", "zip"))
    assert open_["long"].warnings == ["TEXT_TOO_LARGE"] and open_["zip"].warnings[0].startswith("REFUSED:")
    assert not any("anna@" in str(r.text) or b"anna@" in bytes(r.content or b"") for x in got.values() for r in x.values())


def test_json_rows(spark):
    docs = ["", None, "{", '{"a": "anna@example.com"}', "[" * 90 + "]" * 90, '{"card": "4111 1111 1111 1111"}', "7", '"x"', "[" + "1," * 100_001 + "1]"]
    asked = spark.createDataFrame([Row(request_id=str(k), session_id="s", seq=(1 << 50) + k, document=d) for k, d in enumerate(docs)], "request_id string, session_id string, seq long, document string")
    got = {r.request_id: r for r in protect_json(asked, "financial")[0].collect()}
    assert [got[str(k)].status for k in range(9)] == ["uncertain", "safe", "uncertain", "safe", "uncertain", "blocked", "safe", "safe", "uncertain"]
    assert got["3"].safe_document == '{"a": "[EMAIL_001]"}' and got["1"].safe_document is None and got["5"].safe_document is None and got["7"].safe_document == '"x"'
    assert got["2"].warnings == ["REFUSED:not JSON", "FAIL_CLOSED_WITHHELD"] and got["5"].blocked_types == ["CREDIT_CARD"] and got["3"].counts == {"EMAIL": 1}
    small = protect_json(asked, most_bytes=3)[0].collect()
    assert {r.request_id for r in small if r.warnings == ["REFUSED:too large"]} == {"3", "4", "5", "8"}


def test_answers_that_are_scanned_in_part(spark):
    asked = spark.createDataFrame([Row(request_id="a", session_id="s", seq=1, text="anna@example.com")])
    _, mappings = protect(asked)
    said = spark.createDataFrame([("long", "s", "x@y.org " * 50), ("ok", "s", "fine [EMAIL_001]")], "response_id string, session_id string, text string")
    for policy in ("default", "strict"):
        got = {r.response_id: r for r in release(said, mappings, policy, Limits(max_text_bytes=60).detection()).collect()}
        assert (got["long"].status, got["long"].data) == ("blocked", None) and "TEXT_TOO_LARGE" in got["long"].warnings and got["ok"].data == "fine anna@example.com"
    broken = Detection(functions=(("broken", lambda t: 1 / 0),))
    assert [release(said.where("response_id = 'ok'"), mappings, p, broken).first().status for p in ("default", "strict")] == ["warned", "blocked"]


def test_images(spark):
    pixels = np.full((40, 200, 3), 255, np.uint8)
    assert (read_png(write_png(pixels))[0] == pixels).all()
    words = [("Mail", 90.0, 5.0, 5.0, 30.0, 10.0, 0), ("anna@example.com", 95.0, 40.0, 5.0, 100.0, 10.0, 0), ("now", 99.0, 5.0, 20.0, 30.0, 10.0, 1)]
    rows = [("a", write_png(pixels)), ("b", b"\x89PNG\r\n\x1a\nno"), ("c", None)]
    files = spark.createDataFrame([Row(request_id=r, session_id="s", seq=k, content=c) for k, (r, c) in enumerate(rows)], "request_id string, session_id string, seq int, content binary")
    got = {r.request_id: r for r in protect_images(files, lambda png: words, lambda png: [(150.0, 20.0, 20.0, 15.0, 0.9)])[0].collect()}
    out = read_png(bytes(got["a"].image))[0]
    assert (got["a"].status, got["a"].safe_text, got["a"].total) == ("safe", "Mail [EMAIL_001]\nnow", 2)
    assert not out[5:15, 40:140].any() and not out[20:35, 150:170].any() and (out[5:15, :37] == 255).all() and (out[20:30, :100] == 255).all()
    assert got["b"].image is None and got["b"].status == got["c"].status == "uncertain"
    plain = {r.request_id: r for r in protect_images(files)[0].collect()}
    assert plain["a"].warnings == ["OCR_UNAVAILABLE"] and plain["a"].status == "uncertain"
    assert {r.request_id: r.image for r in protect_images(files, policy="strict")[0].collect()}["a"] is None


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_png_filters(kind):
    rng = np.random.default_rng(kind)
    pixels = rng.integers(0, 256, (7, 9, 3)).astype(np.int64)
    lines, above = [], np.zeros((10, 3), np.int64)
    for row in pixels:
        own = np.concatenate([np.zeros((1, 3), np.int64), row])
        left, up, corner = own[:-1], above[1:], above[:-1]
        guess = {0: 0 * up, 1: left, 2: up, 3: (left + up) // 2}.get(kind)
        if guess is None:
            p = left + up - corner
            a, b, c = abs(p - left), abs(p - up), abs(p - corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        lines.append(bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes())
        above = own
    content = write_png(pixels.astype(np.uint8))
    start = content.index(b"IDAT") - 4
    body = zlib.compress(b"".join(lines))
    made = content[:start] + len(body).to_bytes(4, "big") + b"IDAT" + body + zlib.crc32(b"IDAT" + body).to_bytes(4, "big") + content[-12:]
    assert (read_png(made)[0] == pixels).all()
    assert not painted(pixels.astype(np.uint8), [(-3.0, 1.2, 100.0, 1.0)])[1:3].any()


def test_registry(spark):
    known = Registry()
    known.register("TICKET", r"TCK-\d{4}", category="financial", default_action="redact")
    known.register("EMAIL", lambda t: [("EMAIL", 0, 3, 0.9)] if t.startswith("me@") else [])
    for bad in (("EMAIL", None), ("ticket", "x"), ("T", "x")):
        with pytest.raises(ValueError):
            known.register(*bad)
    with pytest.raises(ValueError):
        known.register("OTHER", "x", category="none")
    asked = spark.createDataFrame([Row(request_id="a", session_id="s", seq=1, text="me@ TCK-1234")])
    got = protect(asked, {"defaultAction": "tokenize"}, registry=known)[0].first()
    assert got.safe_text == "[EMAIL_001] [TICKET_REDACTED]" and got.risk == "HIGH"


def test_keys_and_logs(spark):
    key = new_key()
    assert key_of(key.hex()) == key and len(key_from_passphrase("a long passphrase", "salt")) == 32
    for bad in (b"short", "short", "zz" * 32):
        with pytest.raises(ValueError):
            key_of(bad)
    with pytest.raises(ValueError):
        key_from_passphrase("short", "salt")
    _, mappings = protect(spark.createDataFrame([Row(request_id="a", session_id="s", seq=1, text="x@y.io")]))
    box = sealed(mappings, key_table(spark, key))
    assert opened(box, key_table(spark, key.hex())).first().value == "x@y.io"
    assert safe_fields({"requestId": "r" * 200, "text": "anna@x.io", "entityCounts": {"EMAIL": 2, "x": "anna"}, "warningCodes": ["A", {"v": 1}], "count": 3}) == {"requestId": "r" * 128 + "…", "entityCounts": {"EMAIL": 2}, "warningCodes": ["A"], "count": 3}
    assert safe_fields(None) is None


def test_urls_languages_and_issues():
    assert public_url("https://example.com/a") and not any(map(public_url, ("http://example.com", "https://u:p@example.com", "https://10.0.0.1", "https://[::1]/", "https://intranet", "nothing", "https://[bad")))
    assert supports_language(["en"], "en-GB") and supports_language([], "ta") and supports_language(["en"], "mixed") and supports_language(["*"], "ta") and not supports_language(["en"], "ta")
    assert [s for _, s, _ in issues({"entities": {"EMAIL": "nope", "BADGE": "redact"}, "purposes": [{"id": "x"}]})] == ["error", "warning", "warning"]


def test_providers():
    messages = [{"role": "system", "content": "be brief"}, {"role": "user", "content": "hi"}]
    replies = {
        "openai": {"choices": [{"message": {"content": "yes"}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 3}}, "anthropic": {"content": [{"type": "text", "text": "yes"}], "stop_reason": "end_turn"},
        "gemini": {"candidates": [{"content": {"parts": [{"text": "y"}, {"text": "es"}]}}]}, "ollama": {"message": {"content": "yes"}},
    }
    for kind, reply in replies.items():
        url, headers, body = request_of(kind, messages, "m-1", key="k", most_tokens=9)
        assert url.startswith("http") and "hi" in json.dumps(body)
        assert answer_of(kind, reply).text == "yes"
        assert provider(kind, lambda u, h, b, r=reply: r, "m-1")("hi") == "yes"
        with pytest.raises(ProviderError):
            answer_of(kind, {"error": {"message": "no"}})
        with pytest.raises(ProviderError):
            answer_of(kind, {})
    with pytest.raises(ProviderError):
        request_of("openai-compatible", messages, "m")

    def fails(*_):
        raise ConnectionError("secret text")

    with pytest.raises(ProviderError) as caught:
        provider("openai", fails, "m")("anna@x.io")
    assert "anna" not in str(caught.value) and "secret" not in str(caught.value)


def test_sinks(spark, tmp_path):
    results, _ = protect(spark.createDataFrame([Row(request_id="a", session_id="s", seq=1, text="mail anna@example.com"), Row(request_id="b", session_id="s", seq=2, text=None)]))
    save_results(results, str(tmp_path / "t"), "text")
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["mail [EMAIL_001]"]
    with pytest.raises(AnalysisException):
        save_results(results, str(tmp_path / "t"), "text")
    files = spark.createDataFrame([Row(request_id="../a", content=bytearray(b"one")), Row(request_id="b", content=None)], "request_id string, content binary")
    made = save_files(files, f"file://{tmp_path}/f").collect()
    assert [(m.key, m.size) for m in made] == [("../a", 3)] and open(made[0].path.removeprefix("file://"), "rb").read() == b"one" and ".." not in made[0].path
