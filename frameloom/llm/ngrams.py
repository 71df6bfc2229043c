"""Hashed words and word pairs of a text."""

from __future__ import annotations

import re

import numpy as np
import xxhash

BITS = 18
#: A pair of equal words hashes as one feature of its own, whatever the word.
REPEAT = 1
#: Longer words are not kept by the caches of words, which so are bounded in bytes.
LONGEST = 64
#: Letters in a word's beginnings.
PART_CHARS = (3, 4, 5, 6, 7, 8)
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Hashes(dict):
    """Hash of each word, kept for later texts unless the word is longer than LONGEST; emptied when it has grown to its bound."""

    bound = 200_000

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= LONGEST:
            if len(self) >= self.bound:
                self.clear()
            self[word] = h
        return h


_hashes = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    """32-bit hashes of the lower-cased words and runs of signs, in order."""
    found = words(text)
    return np.fromiter(map(_hashes.__getitem__, found), np.uint32, len(found))


def word_parts(word: str) -> list[str]:
    """A word and its beginnings, which inflected forms share; a beginning is marked by a blank."""
    return [word, *[word[:k] + " " for k in PART_CHARS if len(word) >= k]]


def words(text: str | None) -> list[str]:
    """The lower-cased words and runs of signs of a text, in order."""
    return _TOKEN.findall(text.lower()) if text else []


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Feature numbers under 2**bits of all words and word pairs, repeats included."""
    h = word_hashes(text)
    if not len(h):
        return np.zeros(0, np.int32)
    pairs = (h[:-1] * np.uint32(0x9E3779B1)) ^ (h[1:] * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F))
    pairs ^= pairs >> np.uint32(15)
    pairs[h[:-1] == h[1:]] = REPEAT
    return (np.concatenate((h, pairs)) & np.uint32((1 << bits) - 1)).astype(np.int32)
