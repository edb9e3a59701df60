"""Ids of a word-level BPE tokenizer file, with each word encoded once per task.

The tokenizer lower-cases and encodes what stands between white space without looking beyond it, so a text's ids are the
ids of its words in a row. Words repeat; a worker keeps the ids of the first it meets, the frequent ones among them, as bytes and joins them. New words of
Latin letters, digits and marks are merged by ``tiktoken`` over the same vocabulary (its ids are in the order of the
merges; the end-of-word suffix becomes a byte that no UTF-8 text has); everything else goes to ``tokenizers`` itself.
"""

from __future__ import annotations

import functools
import json
import sys
from array import array

import regex
import tiktoken
from tokenizers import Tokenizer

CACHE_WORDS = 800_000
_END = b"\xff"
assert array("I").itemsize == 4 and sys.byteorder == "little"
# Texts with white space that libraries disagree about, or with a special token's string, are encoded whole.
_WHOLE = regex.compile(r"[\x1c-\x1f\x85]|<\|")
# Letters of these blocks are in composed form already and have plain lower-case forms.
_PLAIN = regex.compile(r"[\x21-\x7e\xa1-įĲ-ſ‐-‧‰-※]+")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, by letter."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class WordTokenizer(dict):
    """Mapping from a word to its ids as little-endian 32-bit bytes; missing words are encoded and kept."""

    def __init__(self, path: str):
        super().__init__()
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        letters = _byte_letters()
        ranks = {}
        for token, number in vocabulary.items():
            end = token.endswith("</w>")
            if not token.startswith("<|"):
                ranks[bytes(letters[c] for c in (token[:-4] if end else token)) + _END * end] = number
        ranks.setdefault(_END, len(vocabulary))
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(_MARKS)
        if not (word.isascii() or _PLAIN.fullmatch(word)):
            ids = self.whole.encode(word, add_special_tokens=False).ids
        elif core.isalpha():
            ids = self.merge(core.lower().encode() + _END)
            if len(core) < len(word):
                ids += self.merge(word[len(core):].encode() + _END)
        else:
            ids = [i for part in _SPLIT.findall(word.lower()) for i in self.merge(part.encode() + _END)]
        value = array("I", ids).tobytes()
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value

    def ids(self, text: str | None) -> bytes:
        """Ids of a text as bytes, four to an id; none for a null or empty text."""
        if not text:
            return b""
        if _WHOLE.search(text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return array("I", ids).tobytes()
        return b"".join(map(self.__getitem__, text.split()))


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)
