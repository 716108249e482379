"""File formats by leading bytes, and checks of declared types; native expressions over a binary column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading bytes (hex) of formats; a dot stands for any digit.
MAGIC = [("png", "^89504E470D0A1A0A"), ("jpeg", "^FFD8FF"), ("webp", "^52494646........57454250"), ("tiff", "^(49492A00|4D4D002A)"), ("gif", "^474946383[79]61"), ("bmp", "^424D"), ("zip", "^504B(0304|0506|0708)"), ("ole", "^D0CF11E0A1B11AE1")]
# Input type by format or extension, and MIME types.
INPUT_TYPE = {"png": "image", "jpeg": "image", "jpg": "image", "webp": "image", "tiff": "image", "tif": "image", "gif": "image", "bmp": "image", "zip": "docx", "docx": "docx", "pdf": "pdf", "txt": "text", "md": "text", "csv": "text", "log": "text", "json": "text"}
MIME = {"image/png": "png", "image/jpeg": "jpeg", "image/webp": "webp", "image/tiff": "tiff", "image/gif": "gif", "image/bmp": "bmp", "application/pdf": "pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "zip"}
MAX_FILE_BYTES = 50 << 20


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def format_col(content: Column) -> Column:
    """png, jpeg, webp, tiff, gif, bmp, zip, ole, pdf (mark in the first 1,024 bytes) or unknown."""
    head = F.hex(F.substring(content, 1, 16))
    out = F
    for name, pattern in MAGIC:
        out = out.when(head.rlike(pattern), F.lit(name))
    return out.when(F.instr(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), "%PDF-") > 0, F.lit("pdf")).otherwise(F.lit("unknown"))


def extension_col(path: Column) -> Column:
    name = F.element_at(F.split(path, r"[/\\]"), -1)
    return F.lower(F.nullif(F.regexp_extract(name, r"^.+\.([^.]+)$", 1), F.lit("")))


def file_problem_col(content: Column, path: Column, mime: Column) -> Column:
    """Why a file is refused, or null."""
    found = format_col(content)
    by_name = _lookup(INPUT_TYPE, extension_col(path))
    by_content = _lookup(INPUT_TYPE, found)
    return (
        F.when(content.isNull() | (F.octet_length(content) == 0), "empty").when(F.octet_length(content) > MAX_FILE_BYTES, "too large").when(found == "ole", "legacy document")
        .when(mime.isNotNull() & (F.coalesce(_lookup(MIME, mime), F.lit("unknown")) != found), "mime mismatch").when(by_name.isNotNull() & (by_name != "text") & (F.coalesce(by_content, F.lit("unknown")) != by_name), "extension mismatch")
    )
