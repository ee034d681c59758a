"""Words of UTF-8 texts, cut and hashed by the byte: ASCII lower case, split at ASCII white space."""

import numpy as np
import xxhash

#: Distinct words remembered by a reader; beyond it the memory starts anew.
REMEMBERED = 1 << 18


class WordHash(dict):
    """word (bytes) -> 64-bit hash, computed once for each word while it is remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def split_words(raw: bytes) -> list[bytes]:
    """Maximal runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return; A-Z in lower case."""
    return raw.lower().split()


def batches_of(column, limit: int):
    """(lo, hi) over consecutive values of a binary Arrow column whose bytes sum to about the limit."""
    size = column.nbytes if column.null_count == 0 else None
    if size is not None and size <= limit:
        if len(column):
            yield 0, len(column)
        return
    lo, total = 0, 0
    for i, v in enumerate(column):
        n = len(v.as_buffer()) if v.is_valid else 0
        if total and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(column):
        yield lo, len(column)
