import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from tokenizers import Tokenizer

from cloakframe.llm.packing import pack_documents, price, sequences, solve

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(0, 40), min_size=12, max_size=12))
@settings(max_examples=60, deadline=None)
def test_patterns_cover_and_fit(demand):
    d = np.array(demand)
    out = solve(d, 12)
    assert (sum((n * p for n, p in out), np.zeros(12, int)) >= d).all()
    assert all((p * np.arange(1, 13)).sum() <= 12 for _, p in out)
    bound = -(-int((d * np.arange(1, 13)).sum()) // 12)
    assert sum(n for n, _ in out) <= max(bound, int(d[6:].sum()) + bound) + 2


def test_price_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        y = rng.random(6)
        best = max((y * np.array(p)).sum() for p in np.ndindex(7, 4, 3, 2, 2, 2) if (np.array(p) * np.arange(1, 7)).sum() <= 6)
        value, pattern = price(y, 6)
        assert abs(value - best) < 1e-9 and abs((y * pattern).sum() - value) < 1e-9


def test_pieces_tile_documents_and_sequences(spark):
    texts = [None, "", "one two", "one two", "lange reihe " * 3000, *("wort " * n for n in range(1, 150, 7))]
    docs = spark.createDataFrame([Row(doc_id=None if i == 1 else i // 2, text=t, kind="clash", slot=1, n=2) for i, t in enumerate(texts)])
    packed = pack_documents(docs, PATH, with_ids=True)
    rows = packed.collect()
    own = Tokenizer.from_file(PATH)
    want = sorted(tuple(own.encode(t or "", add_special_tokens=False).ids + [2]) for t in texts)
    by_sequence = defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length and r.start + r.length <= r.doc_tokens
        by_sequence[r.sequence_id].append(r)
    assert sum(r.length for r in rows) == sum(map(len, want))
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    short = sorted(tuple(np.frombuffer(r.ids, "<u4").tolist()) for r in rows if r.length == r.doc_tokens)
    assert short == [w for w in want if len(w) <= 4096]
    built = {r.sequence_id: r for r in sequences(packed).collect()}
    for k, s in by_sequence.items():
        ids = b"".join(r.ids for r in sorted(s, key=lambda r: r.offset))
        n = len(ids) // 4
        assert bytes(built[k].ids) == ids + b"\0" * (0 if n & (n - 1) == 0 else 4 * 4096 - len(ids))


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
