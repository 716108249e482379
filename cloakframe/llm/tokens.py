"""Token ids of whole texts by a tokenizers file, with a cache of space-delimited pieces.

Where a tokenizer maps white space to a separator that it drops (its pre-tokenizer keeps only pieces
without white space), the ids of a text are those of its space-delimited pieces in order. Pieces recur,
so each worker encodes a piece once and joins cached ids. Other tokenizers get whole texts.

Where the tokenizer also lower-cases and keeps runs of letters whole (`_WORDS`), a Latin-1 word in any case with
punctuation after it has the ids of the lower-cased word and those of the punctuation, and the last id of a word tells
its end: such words are encoded once, many in one text.
"""

from __future__ import annotations

import json
import os

import numpy as np

#: Cached pieces of a worker, in two halves: a full one takes the other's place. It bounds memory, not results.
CACHE_PIECES = 600_000
#: Pieces that are encoded in one text, and characters of texts that are split at a time.
CHUNK, GROUP = 200, 1 << 20
#: A punctuation character that is one id when it stands alone; it parts pieces that are encoded together.
MARKS = "^~`"
TAIL = ".,;:!?"
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_PLAIN = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


class TokenEncoder:
    """encode(texts) -> little-endian uint32 ids of each text as bytes. Null: no ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.by_piece = self._drops_space(spec)
        alone = {m: self.tokenizer.encode(m, add_special_tokens=False).ids for m in MARKS}
        self.mark = next((m for m, ids in alone.items() if len(ids) == 1), None)
        self.mark_id = alone[self.mark][0] if self.mark else None
        self.by_piece = self.by_piece and self.mark is not None
        self.cache: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.ends = self._word_ends(spec) if self.by_piece else None

    @staticmethod
    def _drops_space(spec: dict) -> bool:
        first = lambda x, kind: next((y for y in (x or {}).get(f"{kind}s", [x] if x else []) if y), {})
        split = first(spec.get("pre_tokenizer"), "pretokenizer")
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        space = any(s.get("type") == "Replace" and s.get("pattern", {}).get("Regex") == r"\s+" and s.get("content") == " " for s in steps)
        drops = split.get("type") == "Split" and split.get("invert") and split.get("behavior") == "Removed" and "[^\\s" in split.get("pattern", {}).get("Regex", "")
        plain = all(not t["single_word"] and not t["lstrip"] and not t["rstrip"] and " " not in t["content"] and "\n" not in t["content"] for t in spec.get("added_tokens", []))
        return bool(space and drops and plain and (spec.get("model") or {}).get("type") == "BPE")

    def _word_ends(self, spec: dict) -> np.ndarray | None:
        """By id: whether it ends a word. None where words can't be told by that."""
        model, steps = spec["model"], (spec["normalizer"].get("normalizers"), spec["pre_tokenizer"].get("pretokenizers"))
        suffix = model.get("end_of_word_suffix")
        if steps != (_NORMAL, [_SPLIT, _BYTES]) or not suffix or suffix.isalpha() or any(model.get(k) != v for k, v in _PLAIN.items()) or spec.get("post_processor"):
            return None
        if any(not set(t["content"]) - set(TAIL) or t["content"].isalpha() or t["normalized"] for t in spec.get("added_tokens", [])):
            return None
        ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        ends[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
        return ends

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Words are encoded together and cut at the ids that end them, once for each way to write them."""
        if self.ends is None:
            self._learn_marked(pieces)
            return
        cache, other, cores, words = self.cache, [], {}, {}
        for p in pieces:
            core = p.rstrip(TAIL)
            # Latin-1 is composed as it is, and each of its letters has one lower-case letter in Latin-1
            if core.isalpha() and (core.isascii() or max(core) < "\u0100"):
                cores[p] = low = core.lower()
                words[low] = cache.get(low)
            else:
                other.append(p)
        tails = {p[len(low) :] for p, low in cores.items()}.difference(other)
        self._learn_marked([*other, *(t for t in tails if t not in cache)])
        new = [w for w, ids in words.items() if ids is None]
        parts = [new[k : k + CHUNK] for k in range(0, len(new), CHUNK)]
        for part, raw in zip(parts, self._whole([" ".join(x) for x in parts]), strict=True):
            cuts = (4 * (np.flatnonzero(self.ends[np.frombuffer(raw, dtype="<u4")]) + 1)).tolist()
            if len(cuts) != len(part):  # a word has one such id at most, so that equal numbers mean one each
                words.update(zip(part, self._whole(part), strict=True))
                continue
            at = 0
            for w, cut in zip(part, cuts, strict=True):
                words[w] = raw[at:cut]
                at = cut
        for p, low in cores.items():
            cache[p] = words[low] if len(p) == len(low) else words[low] + cache[p[len(low) :]]

    def _learn_marked(self, pieces: list[str]) -> None:
        """Pieces parted by a mark that none of them holds are encoded together and cut at its id."""
        odd = [p for p in pieces if self.mark in p]
        even = [p for p in pieces if self.mark not in p] if odd else pieces
        self.cache.update(zip(odd, self._whole(odd), strict=True))
        parts, put = [even[k : k + CHUNK] for k in range(0, len(even), CHUNK)], f" {self.mark} "
        for part, raw in zip(parts, self._whole([put.join(x) for x in parts]), strict=True):
            ids, at = np.frombuffer(raw, dtype="<u4"), 0
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids)).tolist()
            if len(ends) != len(part):
                self.cache.update(zip(part, self._whole(part), strict=True))
                continue
            for p, end in zip(part, ends, strict=True):
                self.cache[p] = raw[4 * at : 4 * end]
                at = end + 1

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_piece:
            got = iter(self._whole([t for t in texts if t]))
            return [next(got) if t else b"" for t in texts]
        out, k = [], 0
        while k < len(texts):  # split texts take many times their size
            to, size = k + 1, len(texts[k] or "")
            while to < len(texts) and size + len(texts[to] or "") <= GROUP:
                size += len(texts[to] or "")
                to += 1
            out += self._encode_pieces(texts[k:to])
            k = to
        return out

    def _encode_pieces(self, texts: list[str | None]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") if t else () for t in texts]
        new: set[str] = set()
        for s in split:
            new.update(s)
        if 2 * len(self.cache) > CACHE_PIECES:
            self.cache, self.older = {"": b""}, self.cache
        cache, older, unknown = self.cache, self.older, []
        for p in new:  # set operations would go through all of the cache
            if p not in cache:
                if p in older:
                    cache[p] = older[p]
                else:
                    unknown.append(p)
        self._learn(unknown)
        get = cache.__getitem__
        return [b"".join(map(get, s)) for s in split]


_ENCODERS: dict[str, TokenEncoder] = {}


def encoder(path: str) -> TokenEncoder:
    """One encoder for each worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TokenEncoder(path)
    return _ENCODERS[path]
