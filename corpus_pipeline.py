"""Corpus pipeline over `documents`: language, near duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. Stages need doc_id, text, lang and source; other columns, whatever their names, are
kept, and repeated rows are rows of their own unless a stage says otherwise. An empty table gives an empty one.
Operators drop their scratch tables themselves, but for the small ones that a result still reads. A stage starts with
collected heaps: executors live through all stages, and a heap stays as large as the stage before has made it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import language, mixing, ngram_join, packing, suffix_dedup
from cloakframe.llm.common import crc_mod, discard, prepare, scratch_paths, shrink_heaps, stored

#: Documents whose language is less likely than this go, and those without a letter.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those of no likely language; `lang` stays as it is.

    Null and empty texts have no letter. Null languages are not learned from; where no language can be learned, all
    documents with a letter stay. Equal texts stay or go together.
    """
    shrink_heaps(spark)
    prepare(spark)
    model = language.learn(docs, crc_mod("doc_id", 4) != 2)
    if model is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    # other columns travel in a struct, where their names clash with nothing
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")
    named = language.predict(rows, model, "row", "text")
    kept = named.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every component: that of the least id (nulls last), then of the least set and text.

    Repeated rows are duplicates of each other: one stays. Rows without a word stay.
    """
    shrink_heaps(spark)
    return ngram_join.representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages of 100 bytes or more out of the texts, whole characters at a time; `n_chars` follows.

    The first place keeps a passage: smaller id (nulls last), then smaller text hash, then earlier start. Null texts stay null.
    """
    shrink_heaps(spark)
    return suffix_dedup.deduplicated(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as many times as the mix takes it; equal rows alike, a null source is a source of its own."""
    shrink_heaps(spark)
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its sequence and offset. A null or empty text is its end id."""
    import public_tokenizers

    shrink_heaps(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL expresses neither the network nor the packing; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what a stage wrote goes once the next one's result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (name, stage) in enumerate(STAGES):
        with scratch_paths() as paths:
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = stored(docs, f"stage-{name}")
        if k < len(STAGES) - 1:
            discard(spark, [*before, *paths[:-1]])
            before = paths[-1:]
    return docs
