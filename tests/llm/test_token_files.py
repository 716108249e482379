import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from tokenizers import Tokenizer

from cloakframe.llm.common import scratch
from cloakframe.llm.eliasfano import EliasFano
from cloakframe.llm.token_files import TokenShard, read_token_files, write_token_files
from cloakframe.llm.tokens import TokenEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
OWN, ENC = Tokenizer.from_file(PATH), TokenEncoder(PATH)


@given(st.lists(st.integers(0, 3000), max_size=900))
@settings(max_examples=40, deadline=None)
def test_elias_fano_round_trip(gaps):
    values = np.cumsum(np.array(gaps, dtype=np.int64))
    code = EliasFano.from_bytes(EliasFano.encode(values).to_bytes())
    assert [code.select(i) for i in range(code.n)] == values.tolist()
    assert code.select_range(0, code.n).tolist() == values.tolist()
    a = code.n // 3
    assert code.select_range(a, code.n - a // 2).tolist() == values[a : code.n - a // 2].tolist()


def test_elias_fano_is_near_minimal():
    values = np.cumsum(np.random.default_rng(1).integers(0, 2000, 20000))
    assert len(EliasFano.encode(values).to_bytes()) < 20000 * (11 + 2 + 1) / 8


@given(st.lists(st.text(alphabet="aB'sé ßΣ\n\t^~|<>0１.́ \u0085", max_size=40), max_size=5))
@settings(max_examples=150, deadline=None)
def test_pieces_give_the_tokenizers_own_ids(texts):
    own, enc = OWN, ENC
    assert enc.by_piece
    for text, got in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


def test_special_text_is_kept():
    own, enc = OWN, ENC
    text = "a<|endoftext|>b ^ <|startoftext|> ^^ c^d"
    assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("empty", [False, True])
def test_files_against_brute_force(spark, empty):
    rows = [(5, "the the"), (None, "last one"), (1, None), (3, ""), (3, "Zwei wörter"), (3, "Zwei wörter"), (2, "lang " * 5000), (9, "x")]
    docs = spark.createDataFrame([] if empty else [Row(doc_id=i, text=t, shard=7, width="x") for i, t in rows], "doc_id long, text string, shard int, width string")
    manifest = write_token_files(docs, scratch(spark, "t"), PATH)
    got = sorted(map(tuple, read_token_files(manifest).collect()), key=lambda r: r[1])
    own, want, at = Tokenizer.from_file(PATH), [], 0
    hashes = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) AS h").collect()}
    for i, t in [] if empty else sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashes[r[1]])):
        ids = own.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    for m in manifest.collect():
        shard = TokenShard(m.ids_path, m.idx_path, m.width)
        assert sum(len(shard.document(i)) for i in range(shard.n)) == m.n_tokens
        assert all(shard.document(i)[-1] == 2 for i in range(shard.n))
