from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import Row
from test_ngram_join import brute as brute_components
from test_ngram_join import family
from test_suffix_dedup import brute as brute_repeats
from tokenizers import Tokenizer

import corpus_pipeline
from cloakframe.llm import language
from cloakframe.llm.common import crc_mod, stored
from cloakframe.llm.mixing import mix_counts


def test_stages_against_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = [None, "", "12 - 99 !", *family(rng, 12, 60, 3), *family(rng, 1, 400, 1)]
    passage = family(rng, 1, 40, 1)[0]
    texts += [t + " " + passage + " " + t[::-1] for t in family(rng, 12, 30, 60)]
    rows = [Row(doc_id=i, text=t, lang="en" if i % 3 else "de", source=f"s{i % 3}", n_chars=0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows)
    step = stored(corpus_pipeline.identify_language(spark, docs, ""), "t")
    model = language.learn(docs, crc_mod("doc_id", 4) != 2)
    likely = {r.doc_id for r in language.predict(docs, model, "doc_id").collect() if r.lang_pred != "und" and r.score >= 0.3}
    assert {r.doc_id for r in step.collect()} == likely == set(range(3, len(rows)))
    kept = sorted((i, texts[i]) for i in likely)
    step = stored(corpus_pipeline.drop_near_duplicates(spark, step, ""), "t")
    kept = [(i, t) for i, t in kept if i in {c for _, _, c in brute_components(kept)}]
    assert sorted((r.doc_id, r.text) for r in step.collect()) == kept and len(kept) < len(likely)
    step = stored(corpus_pipeline.cut_repeats(spark, step, ""), "t")
    kept = [(i, bytes(np.frombuffer(t.encode(), np.uint8)[~g]).decode()) for (i, t), g in zip(kept, brute_repeats(kept), strict=True)]
    assert sorted((r.doc_id, r.text) for r in step.collect()) == kept
    assert all(r.n_chars == len(r.text) for r in step.collect()) and step.columns == docs.columns
    times = {r.doc_id: r.taken // r.size if r.size else None for r in mix_counts(step).collect()}
    step = stored(corpus_pipeline.mix_sources(spark, step, ""), "t")
    got = Counter(r.doc_id for r in step.collect())
    assert all(times[i] is None or got[i] == times[i] for i, _ in kept) and step.columns == docs.columns
    packed = corpus_pipeline.pack_sequences(spark, step, "").collect()
    own, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for i, t in kept:
        want[i] += got[i] * (len(own.encode(t, add_special_tokens=False).ids) + 1)
    have = Counter()
    for r in packed:
        have[r.doc_id] += r.length
    assert have == +want
    assert all(n <= 4096 for n in Counter({s: sum(r.length for r in packed if r.sequence_id == s) for s in {r.sequence_id for r in packed}}).values())


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, row string, doc string, key long, node long, label long, h string, copies int, kept string"


def odd_docs(spark, rows):
    """Columns whose names clash with those that the stages make."""
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), 0.5, "clash", "clash", "clash", 1, 2, 3, "clash", 4, "clash") for i, t, g, s in rows], ODD)


def test_stages_on_odd_rows(spark):
    rng = np.random.default_rng(9)
    texts = family(rng, 6, 80, 60)
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else "s") for i, t in enumerate(texts)]
    rows += [(None, texts[0], "en", "s"), (None, None, None, None), (None, None, None, None), (7, "", "en", "s"), (8, None, "de", None), (9, "long " + "word" * 30_000, "en", "s"), (2, texts[2], None, "s"), (2, texts[2], None, "s")]
    docs = odd_docs(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stored(stage(spark, docs, ""), f"odd-{name}")
        assert docs.columns == odd_docs(spark, rows).columns, name
        got = docs.collect()
        if name == "language":
            assert sorted(-1 if r.doc_id is None else r.doc_id for r in got) == [-1, 0, 1, 2, 2, 2, 3, 4, 5, 9]
        if name == "near_duplicates":  # copies, in rows with and without an id, are one document
            assert sorted(r.doc_id for r in got) == [0, 1, 2, 3, 4, 5, 9]
        if name == "repeats":
            assert all(r.n_chars == len(r.text) for r in got) and {r.score for r in got} == {0.5}
    packed = corpus_pipeline.pack_sequences(spark, docs, "").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_stages_on_an_empty_table(spark):
    empty = odd_docs(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name


def test_documents_stay_where_no_language_can_be_learned(spark):
    docs = odd_docs(spark, [(1, "some words", None, "s"), (2, "12 34", None, "s"), (3, None, None, "s")])
    assert [r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()] == [1]
