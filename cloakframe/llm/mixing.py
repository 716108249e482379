"""Mixing sources to target weights by nested hash-threshold histograms; DataFrame functions only.

A document's hash is the md5 of its id and text. Words are summed by source and by the first hash digits;
running sums over those buckets find where a source's budget ends, and only that boundary bucket is summed
again by the next digits. The thresholds (a row for each source) then filter documents without a sort.

A target above its source's size takes every document once or twice and a threshold adds one copy more.
Defined cases: null text has size 0; null source is a source of its own, last in order; null ids hash as
empty; equal rows (same id and text) stand or fall together; sources without words have target 0; an empty
table gives no rows; other columns are kept by `mixed` and clash with nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, settled, stored, table

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of a level, and levels: 4,096 buckets for each source and level, 2^36 thresholds in all.
DIGITS, LEVELS = 3, 3
WEIGHTS = (3, 1, 2)


def size_of(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id, text) -> F.Column:
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.substring(F.md5(whole.cast("binary")), 1, DIGITS * LEVELS)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """(source, size) rows -> a row for each source with its target: shares of share[0]/share[1] of all words by
    weight, at most cap times the source; what is cut off goes to the others by weight."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cyclic = F.array(*[F.lit(int(w)) for w in weights])
    # windows over one row for each source
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("w", F.element_at(cyclic, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    everything = Window.partitionBy(F.lit(0))
    ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    earlier, later = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(0, Window.unboundedFollowing)
    by = by.withColumn("all_size", F.sum("source_size").over(everything))
    by = by.withColumn("capped_before", F.coalesce(F.sum("source_size").over(earlier), F.lit(0)) * cap).withColumn("w_from", F.sum("w").over(later))
    left = share[0] * big("all_size") - share[1] * big("capped_before")
    by = by.withColumn("capped", share[1] * cap * big("source_size") * F.col("w_from") <= F.col("w") * left)
    by = by.withColumn("c", F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size") * cap)).over(everything), F.lit(0)))
    by = by.withColumn("free_w", F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything))
    shared = (F.col("w") * (share[0] * big("all_size") - share[1] * big("c"))).cast("double") / (F.col("free_w") * share[1]).cast("double")
    return by.select("source", "source_size", F.when(F.col("capped"), (F.col("source_size") * cap).cast("double")).otherwise(shared).alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, size, h) rows and targets -> targets with whole copies and the hash prefix below which one more is taken."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = stored(targets, "mix-targets", 1)
    state = targets.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    state = state.withColumn("left", F.col("budget")).withColumn("prefix", F.lit("")).withColumn("over", F.lit(0).cast("long"))
    for level in range(LEVELS):
        # from the second level on, only rows of the boundary bucket are summed; a level's state is a table of one row for each
        # source, written so that the next level's plan starts from it
        inside = sizes.alias("d").join(state.select("source", "prefix").alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.substring("d.h", 1, DIGITS * level) == F.col("s.prefix")) if level else F.col("d.source").eqNullSafe(F.col("s.source")))
        buckets = inside.groupBy("d.source", F.substring("d.h", 1, DIGITS * (level + 1)).alias("bucket")).agg(F.sum("d.size").alias("n"))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        buckets = buckets.withColumn("upto", F.sum("n").over(running)).alias("b").join(state.select("source", "left").alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")) & (F.col("upto") > F.col("left")))
        edge = buckets.groupBy("b.source").agg(F.min(F.struct("bucket", "upto", "n")).alias("e"))
        state = (
            state.alias("t").join(edge.alias("g"), F.col("t.source").eqNullSafe(F.col("g.source")), "left")
            .select("t.source", "source_size", "target", "whole", "budget", (F.col("left") - F.col("e.upto") + F.col("e.n")).alias("left"), F.col("e.bucket").alias("prefix"), F.col("e.n").alias("over"))
        )
        state = stored(state, f"mix-level-{level}", 1)
    # the last bucket is taken if that comes nearer to the target
    nearer = F.col("over") - F.col("left") < F.col("left")
    return state.select("source", "source_size", "target", "whole", "prefix", nearer.alias("closed"))


def copies_of(h) -> F.Column:
    more = F.when(F.col("prefix").isNull(), F.lit(0)).when((h < F.col("prefix")) | (F.col("closed") & (h == F.col("prefix"))), F.lit(1)).otherwise(F.lit(0))
    return F.col("whole") + more


def mix_plan(docs: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """Slim rows (doc_id, source, size, h), stored once, and the thresholds."""
    prepare(docs.sparkSession)
    slim = stored(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id"), F.col("text")).alias("h")), "mix-sizes")
    return slim, settled(lambda: thresholds(slim, source_targets(slim, **how)), "mix-thresholds", 1)


def mix_counts(docs: DataFrame, **how) -> DataFrame:
    """Per document: size, source_size, target and taken words."""
    slim, edges = mix_plan(docs, **how)
    joined = slim.alias("d").join(edges.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies_of(F.col("h"))).cast("long").alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: docs' columns, a document as many times as it is taken."""
    edges = settled(lambda: mix_plan(docs, **how)[1], "mix-edges", 1)
    names = docs.columns
    inner = docs.select(F.struct("*").alias("row"), hash_of(F.col("doc_id"), F.col("text")).alias("h"), F.col("source").alias("from"))
    joined = inner.join(edges, F.col("from").eqNullSafe(F.col("source"))).withColumn("copies", copies_of(F.col("h")).cast("int"))
    return joined.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*[F.col("row").getField(c).alias(c) for c in names])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '') || '|' || COALESCE(text, '')), 1, 9) AS h
  FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS z FROM d GROUP BY source),
w AS (SELECT source, z, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w, SUM(z) OVER () AS total FROM s),
o AS (SELECT *, COALESCE(SUM(z) OVER (ORDER BY z / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2 AS before,
             SUM(w) OVER (ORDER BY z / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_from FROM w),
c AS (SELECT *, 4 * CAST(z AS HUGEINT) * w_from <= w * (3 * CAST(total AS HUGEINT) - 2 * before) AS capped FROM o),
t AS (SELECT source, z, CASE WHEN capped THEN CAST(2 * z AS DOUBLE)
        ELSE CAST(w * (3 * CAST(total AS HUGEINT) - 2 * COALESCE(SUM(CASE WHEN capped THEN 2 * z END) OVER (), 0)) AS DOUBLE)
             / CAST(2 * SUM(CASE WHEN NOT capped THEN w END) OVER () AS DOUBLE) END AS target FROM c),
u AS (SELECT *, CASE WHEN z > 0 THEN CAST(floor(target / z) AS BIGINT) ELSE 0 END AS whole FROM t),
g AS (SELECT source, h, CAST(SUM(size) AS BIGINT) AS n FROM d GROUP BY source, h),
r AS (SELECT source, h, n, SUM(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
k AS (SELECT r.source, r.h, u.whole + CASE WHEN upto <= target - whole * z THEN 1
        WHEN upto - n <= target - whole * z AND upto - (target - whole * z) < (target - whole * z) - (upto - n) THEN 1 ELSE 0 END AS copies
      FROM r JOIN u ON r.source IS NOT DISTINCT FROM u.source)
SELECT d.doc_id, d.size, u.z AS source_size, u.target, CAST(d.size * k.copies AS BIGINT) AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source JOIN k ON k.source IS NOT DISTINCT FROM d.source AND k.h = d.h
"""
