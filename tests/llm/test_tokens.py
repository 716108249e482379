import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cloakframe.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
OWN = Tokenizer.from_file(PATH)
ODD = ["Été, ÉTÉ. été", "don't I'LL we've 's", "ΣΊΣΥΦΟΣ. İstanbul ﬁn", "été. É́", "µ ª º ÿ Ÿ ß. ẞ", "a\xa0b\x85c.\td\r\ne", "wait... what?! ...so .,;:!?", "<|endoftext|>. <|ENDOFTEXT|> x</w>", "^a^ a^ ~. `", "a1. 1. 2:3", None, "", " ", "\n\n"]


def test_ids_with_a_small_cache_and_small_groups(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 40)
    monkeypatch.setattr(tokens, "GROUP", 60)
    rng, enc = np.random.default_rng(5), tokens.TokenEncoder(PATH)
    words = ["".join(rng.choice(list("abeéEÉtrn"), rng.integers(1, 9))) + str(rng.choice(["", "", ".", ",", "?!"])) for _ in range(300)]
    texts = [*ODD, *(" ".join(rng.choice(words, 12)) for _ in range(60)), *ODD[::-1]]
    for _ in range(2):
        for text, got in zip(texts, enc.encode(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == OWN.encode(text or "", add_special_tokens=False).ids
        assert len(enc.cache) < 200


@pytest.mark.parametrize("first", ["Wörter", "wörter..."])
def test_a_word_is_encoded_once_whatever_its_case_and_punctuation(first):
    enc = tokens.TokenEncoder(PATH)
    seen, whole = [], enc._whole
    enc._whole = lambda texts: (seen.extend(texts), whole(texts))[1]
    enc.encode([first, "WÖRTER, wörter wörter."])
    enc.encode(["Wörter wörter."])
    assert sum(t.lower().count("wörter") for t in seen) <= 2  # one for each call that brought a new way to write it
