"""OCR words to text and spans to boxes, as windows and range joins keyed by image."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOW, VERY_LOW = 60, 40


def layout(words: DataFrame) -> DataFrame:
    """words (image_id, word_no, text, line, ...) with char_start and char_end: a space inside a line, a newline between lines."""
    order = Window.partitionBy("image_id").orderBy("word_no")
    before = F.coalesce(F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return words.withColumn("char_start", before).withColumn("char_end", F.col("char_start") + F.length("text"))


def image_text(laid: DataFrame) -> DataFrame:
    parts = laid.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("word_no", "line", "text"))).alias("w"), F.coalesce(F.avg("confidence"), F.lit(100.0)).alias("confidence"))
    fold = F.aggregate("w", F.struct(F.lit("").alias("t"), F.lit(None).cast("int").alias("l")), lambda s, x: F.struct(F.when(s.l.isNull(), x.text).when(s.l == x.line, F.concat(s.t, F.lit(" "), x.text)).otherwise(F.concat(s.t, F.lit("\n"), x.text)).alias("t"), x.line.cast("int").alias("l")), lambda s: s.t)
    return parts.select("image_id", fold.alias("text"), "confidence", F.when(F.col("confidence") < VERY_LOW, "error").when(F.col("confidence") < LOW, "warning").alias("quality"))


def span_boxes(laid: DataFrame, spans: DataFrame, pad: float = 2.0) -> DataFrame:
    """spans (image_id, start, end) -> one padded box for each line that a span touches."""
    hit = laid.join(spans, "image_id").where((F.col("char_start") < F.col("end")) & (F.col("start") < F.col("char_end")))
    box = hit.groupBy("image_id", "start", "end", "line").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))
    left, top = F.greatest(F.col("x0") - pad, F.lit(0.0)), F.greatest(F.col("y0") - pad, F.lit(0.0))
    return box.select("image_id", "start", "end", "line", left.alias("x"), top.alias("y"), (F.col("x1") + pad - left).alias("w"), (F.col("y1") + pad - top).alias("h"))
