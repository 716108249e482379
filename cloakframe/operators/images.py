"""Images as requests: words that an OCR plug-in recognises become text, sensitive spans become boxes, boxes are painted over.

Plug-ins are callables on PNG bytes: `ocr` gives words (text, confidence, x, y, w, h, line), `faces` gives boxes (x, y, w, h, confidence).
An image that isn't read, has unsure words, several frames, or no OCR, is uncertain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..plans.policy import Policy, decide, resolve_policy
from ..sources.image import painted, read_png, write_png
from .detect import Detection, detect
from .geometry import image_text, layout, span_boxes
from .protect import NO_NAMES, replaced, splice, status_of

Ocr = Callable[[bytes], list[tuple[str, float, float, float, float, float, int]]]
Faces = Callable[[bytes], list[tuple[float, float, float, float, float]]]
SEEN = "image_id string, session_id string, seq long, words array<struct<text:string,confidence:double,x:double,y:double,w:double,h:double,line:int>>, faces array<struct<x:double,y:double,w:double,h:double,confidence:double>>, warnings array<string>"


def _recognise(ocr: Ocr | None, faces: Faces | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = pa.struct([("text", pa.string()), *((c, pa.float64()) for c in ("confidence", "x", "y", "w", "h")), ("line", pa.int32())])
        face = pa.struct([(c, pa.float64()) for c in ("x", "y", "w", "h", "confidence")])
        for batch in batches:
            words, found, warnings = [], [], []
            for content in batch.column("content").to_pylist():
                seen, heads, told = [], [], []
                try:
                    told = read_png(content or b"")[1]
                    if ocr is None:
                        told.append("OCR_UNAVAILABLE")
                    else:
                        seen = [dict(zip(("text", "confidence", "x", "y", "w", "h", "line"), w, strict=True)) for w in ocr(content)]
                    heads = [dict(zip(("x", "y", "w", "h", "confidence"), f, strict=True)) for f in faces(content)] if faces else []
                except Exception as error:  # an image that can't be read is a row that says so
                    told = [f"REFUSED:{error if isinstance(error, ValueError) else type(error).__name__}"]
                words.append(seen)
                found.append(heads)
                warnings.append(told)
            keep = [batch.column(c) for c in ("image_id", "session_id", "seq")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(words, pa.list_(word)), pa.array(found, pa.list_(face)), pa.array(warnings, pa.list_(pa.string()))], names=["image_id", "session_id", "seq", "words", "faces", "warnings"])

    return run


def _paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for content, withheld, boxes in zip(*(batch.column(c).to_pylist() for c in ("content", "withheld", "boxes")), strict=True):
            made.append(None if withheld else write_png(painted(read_png(content)[0], [(b["x"], b["y"], b["w"], b["h"]) for b in boxes or []])))
        keep = [c for c in batch.schema.names if c not in ("content", "withheld", "boxes")]
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()) if c == "image" else batch.column(c) for c in keep], names=keep)


def protect_images(files: DataFrame, ocr: Ocr | None = None, faces: Faces | None = None, policy: Policy | str | dict | None = None, how: Detection | None = None) -> tuple[DataFrame, DataFrame]:
    """files (request_id, session_id, seq, content) -> (request_id, status, image, safe_text, total, warnings), mappings.

    `image` is the PNG with boxes over everything that is not allowed and without metadata; faces are covered unless the policy allows or blocks them.
    """
    p = resolve_policy(policy)
    asked = files.select(F.col("request_id").alias("image_id"), "session_id", F.col("seq").cast("long").alias("seq"), "content")
    seen = asked.mapInArrow(_recognise(ocr, faces), SEEN).persist(StorageLevel.MEMORY_AND_DISK)
    words = seen.select("image_id", F.posexplode("words").alias("word_no", "e")).select("image_id", "word_no", "e.*")
    laid = layout(words)
    texts = seen.select("image_id", "session_id", "seq").join(image_text(laid), "image_id")
    detected = detect(texts, how=how, values=True).persist(StorageLevel.MEMORY_AND_DISK)
    named = F.lit(p.name).alias("policy"), F.lit(None).cast("string").alias("purpose")
    found = detected.select(F.col("image_id").alias("request_id"), "session_id", "seq", F.explode("entities").alias("e")).select("request_id", "session_id", "seq", "e.*", *named)
    decided = decide(found, [p])
    done, mappings = replaced(decided, detected.select("session_id", "text").limit(0))
    boxes = span_boxes(laid, done.where("action != 'allow'").select(F.col("request_id").alias("image_id"), "start", "end")).select("image_id", "x", "y", "w", "h")
    heads = seen.select("image_id", F.explode("faces").alias("f")).select("image_id", "f.*", F.lit("FACE").alias("type"), *named)
    heads = decide(heads, [p]).where("kept").withColumn("action", F.when(F.col("action").isin("allow", "block"), F.col("action")).otherwise("redact"))
    every = boxes.unionByName(heads.where("action != 'allow'").select("image_id", "x", "y", "w", "h")).groupBy("image_id").agg(F.collect_list(F.struct("x", "y", "w", "h")).alias("boxes"))
    edit = F.when(F.col("replacement").isNotNull(), F.struct("start", "end", F.col("replacement").alias("repl")))
    per = done.groupBy(F.col("request_id").alias("image_id")).agg(F.collect_list(edit).alias("edits"), F.count("*").alias("n"), F.bool_or(F.col("action") == "block").alias("stop"))
    shown = heads.groupBy("image_id").agg(F.count("*").alias("n_faces"), F.bool_or(F.col("action") == "block").alias("stop_faces"))
    rows = asked.select("image_id", "content").join(seen.select("image_id", "warnings"), "image_id").join(detected.select("image_id", "text", "quality", F.col("warnings").alias("told"), "incomplete"), "image_id", "left")
    rows = rows.join(per, "image_id", "left").join(shown, "image_id", "left").join(every, "image_id", "left")
    unsure = F.when(F.col("quality").isNotNull(), F.array(F.lit("OCR_LOW_CONFIDENCE"))).otherwise(F.expr(NO_NAMES))
    warnings = F.array_distinct(F.concat("warnings", F.coalesce("told", F.expr(NO_NAMES)), unsure))
    blocked = F.coalesce("stop", F.lit(False)) | F.coalesce("stop_faces", F.lit(False))
    status, withheld, told = status_of(blocked, F.size(warnings) > 0, warnings, p.fail_mode)
    safe = F.when(F.col("edits").isNull(), F.col("text")).otherwise(splice(F.col("text"), F.col("edits")))
    out = rows.select(
        F.col("image_id").alias("request_id"), status.alias("status"), F.lit(None).cast("binary").alias("image"), F.when(~withheld, safe).alias("safe_text"),
        (F.coalesce("n", F.lit(0)) + F.coalesce("n_faces", F.lit(0))).alias("total"), told.alias("warnings"), "content", withheld.alias("withheld"), "boxes",
    )
    return out.mapInArrow(_paint, "request_id string, status string, image binary, safe_text string, total long, warnings array<string>"), mappings
