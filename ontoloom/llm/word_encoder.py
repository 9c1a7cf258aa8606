"""Encoding with the tokenizers library, once per distinct word where the tokenizer drops white space.

A tokenizer that normalises with NFC, white-space replacement and lower case, and splits as SPLIT says, gives
a text the ids of the words between white space, in order. Words are remembered; a new one that is letters,
perhaps with signs at its end, goes straight to the library's BPE model, any other to the whole tokenizer.
U+001C to U+001F are white space to str.split but not to the tokenizer, and a capital sigma has two lower
forms for str.lower; a text with one of them goes to the library as a whole, as do texts that hold a special
token of the tokenizer in any case, and all texts for a tokenizer of another kind. The library is used as it is
loaded, without any switch of its own changed.
"""

from __future__ import annotations

import json
import os
import re
from functools import cache
from unicodedata import is_normalized

import numpy as np
import public_tokenizers

from .byte_bpe import LONGEST, Cache

DEFAULT = public_tokenizers.path("word_bpe_49k.json")
#: The normalisers and the split pattern of such a tokenizer, as its file states them.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WHOLE = re.compile("[\x1c-\x1fΣİ]")
#: No letters, digits or apostrophes: at the end of a word they are one match of SPLIT.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from 256 on."""
    same = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in same)
    return {b: b for b in same} | {b: 256 + k for k, b in enumerate(rest)}


class WordEncoder:
    def __init__(self, path: str = DEFAULT, size: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        first = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        added = spec.get("added_tokens") or []
        self.special = re.compile("|".join(re.escape(t["content"].lower()) for t in added) or r"(?!)")
        plain = not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"].isascii() for t in added)
        self.by_word = plain and kinds == NORMALIZERS and first.get("pattern") == {"Regex": SPLIT} and first["behavior"] == "Removed"
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.dtype = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.words = Cache(size)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _word(self, w: str) -> bytes:
        ids = self.words.get(w)
        if ids is None:
            core = w.rstrip(SIGNS)
            if core.isalpha() and core == core.lower() and is_normalized("NFC", core):
                if len(core) < len(w):
                    ids = self._word(core) + self._word(w[len(core) :])
                else:
                    tokens = self.model.tokenize(core.encode().decode("latin-1").translate(self.letters))
                    ids = np.array([t.id for t in tokens], self.dtype).tobytes()
            else:
                ids = self.whole(w)
            if len(w) <= LONGEST:
                self.words.put(w, ids)
        return ids

    def encode(self, text: str) -> bytes:
        """The ids, as little-endian integers of self.dtype."""
        if not self.by_word or _WHOLE.search(text):
            return self.whole(text)
        low = text.lower()
        if self.special.search(low):
            return self.whole(text)
        words = low.split()
        found = list(map(self.words.young.get, words))
        if None in found:
            found = [self._word(w) if x is None else x for w, x in zip(words, found, strict=True)]
        return b"".join(found)


@cache
def word_encoder(path: str = DEFAULT) -> WordEncoder:
    return WordEncoder(path)
