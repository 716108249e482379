"""Multi-party perspective rotation of conversations; DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant, all
others as named users and system turns as they are. A row of the result is one segment of one rendering,
with its place in the rendering (characters) and the part of it that is trained on: text and end marker of
the perspective's own turns. A rendering is its segments in order of `position`; it isn't built into one
string, so that a conversation of any length stays spread over tasks.

Places are prefix sums in two levels: over blocks of turns, then within a block.
Defined cases: null speaker is named `unknown`, null text is empty, null conv_id is a conversation of its
own, null turns come first; turns of equal number are ordered by speaker and text; repeated rows stay; a
conversation of system turns only has no perspective; other columns are ignored. Markers inside texts
lose their `<|`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, table

END = "<|end|>"
#: Turns of a block; a longer conversation is placed block by block.
BLOCK = 256


def rotate_perspectives(turns: DataFrame, speaker: str = "role", system: str = "system", block: int = BLOCK) -> DataFrame:
    prepare(turns.sparkSession)
    clean = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    rows = turns.select(
        "conv_id", "turn", F.coalesce(clean(F.col(speaker)), F.lit("unknown")).alias("speaker"), F.coalesce(clean(F.col("text")), F.lit("")).alias("text"),
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-1).cast("long")))
    people = rows.where(F.col("speaker") != system).groupBy("conv_id", F.col("speaker").alias("perspective")).agg(F.count("*").alias("own_turns"))
    blocks = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    inner = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text")
    placed = rows.withColumn("nth", F.row_number().over(inner) - 1).alias("r").join(
        blocks.alias("b"), F.col("r.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("r.block") == F.col("b.block"))
    ).select("r.*", (F.col("before") + F.col("nth")).alias("position"))
    each = placed.alias("r").join(people.alias("p"), F.col("r.conv_id").eqNullSafe(F.col("p.conv_id"))).select("r.*", "p.perspective")
    own = F.col("speaker") == F.col("perspective")
    chat_role = F.when(own, "assistant").when(F.col("speaker") == system, "system").otherwise("user")
    head = F.when(chat_role == "user", F.concat(F.lit("<|user name="), F.col("speaker"), F.lit("|>\n"))).otherwise(F.concat(F.lit("<|"), chat_role, F.lit("|>\n")))
    each = each.withColumn("chat_role", chat_role).withColumn("head_chars", F.length(head).cast("long"))
    each = each.withColumn("segment", F.concat(head, F.col("text"), F.lit(END + "\n"))).withColumn("n_chars", F.length("segment").cast("long")).drop("text")
    sums = each.groupBy("conv_id", "perspective", "block").agg(F.sum("n_chars").alias("n"))
    upto = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "perspective", "block", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    inner = Window.partitionBy("conv_id", "perspective", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("inside", F.coalesce(F.sum("n_chars").over(inner), F.lit(0))).alias("e").join(
        sums.alias("s"), F.col("e.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("e.perspective") == F.col("s.perspective")) & (F.col("e.block") == F.col("s.block"))
    ).select("e.*", (F.col("before") + F.col("inside")).alias("start"))
    end = F.col("start") + F.col("n_chars") - 1  # the newline after the end marker is not trained on
    mask_start = F.when(F.col("chat_role") == "assistant", F.col("start") + F.col("head_chars")).otherwise(end)
    return each.select("conv_id", "perspective", "position", "turn", "speaker", "chat_role", "segment", "start", "n_chars", mask_start.alias("mask_start"), end.alias("mask_end"))


def op6_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


OP6_SQL = """
WITH r AS (SELECT conv_id, turn, COALESCE(replace(role, '<|', '< |'), 'unknown') AS speaker, COALESCE(replace(text, '<|', '< |'), '') AS text FROM conversations),
q AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, text) - 1 AS BIGINT) AS position FROM r),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM r WHERE speaker <> 'system'),
e AS (SELECT q.*, perspective, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS chat_role
      FROM q JOIN p ON q.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, CASE WHEN chat_role = 'user' THEN '<|user name=' || speaker || '|>' ELSE '<|' || chat_role || '|>' END || chr(10) AS head FROM e),
s AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM h),
t AS (SELECT *, CAST(length(segment) AS BIGINT) AS n_chars,
        CAST(COALESCE(SUM(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s)
SELECT conv_id, perspective, position, turn, speaker, chat_role, segment, start, n_chars,
       CASE WHEN chat_role = 'assistant' THEN start + length(head) ELSE start + n_chars - 1 END AS mask_start, start + n_chars - 1 AS mask_end FROM t
"""
