"""Token ids by the tokenizers library, one library call for each distinct pre-token of a task.

A byte-pair encoder never merges across pre-tokens, so ids of a text are the ids of its pre-tokens in
order. Texts made of the characters in ``plain`` are cut by numpy; any other text (apostrophes, control
characters, other scripts) is given to the library whole. Both ways give the library's own ids.
"""

import sys
import types
import unicodedata
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

from designstats.llm.arrays import rank_in, slices, spans_of

#: Distinct pre-tokens remembered by a worker; beyond it only those met again since the last such cut stay.
REMEMBERED = 1 << 20
#: Characters cut at once.
SLICE = 1 << 19
SPACE, LETTER, DIGIT, OTHER, FOREIGN = range(5)


def _classes() -> np.ndarray:
    table = np.full(1 << 16, FOREIGN, dtype=np.uint8)
    for cp in [9, 10, 13, *range(0x20, 0x7F), *range(0xA0, 0x180)]:
        kind = unicodedata.category(chr(cp))[0]
        table[cp] = SPACE if cp in (9, 10, 13, 0x20, 0xA0) else {"L": LETTER, "N": DIGIT}.get(kind, OTHER)
    table[[ord("'"), 0xAD, 0x130, 0x149, 0x17F]] = FOREIGN
    return table


CLASSES = _classes()


def worker_encoder(path: str, kind: str) -> "Encoder":
    """The encoder of this Python worker, which serves one task after another and keeps what it remembers."""
    memo = sys.modules.setdefault("designstats_worker_memo", types.ModuleType("designstats_worker_memo")).__dict__
    if (path, kind) not in memo:
        memo[(path, kind)] = Encoder(path, kind)
    return memo[(path, kind)]


class Encoder:
    """kind "byte": byte-level pre-tokens with their leading space; "word": lower case, white space dropped."""

    def __init__(self, path: str, kind: str):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.kind = kind
        #: By ascending hash of a pre-token: where its ids are in ``flat``, how many, and whether it was met again.
        self.key, self.again = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
        self.at, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0

    def _forget(self):
        """Keep the pre-tokens that were met again, unless these are many themselves."""
        again = self.again if 2 * self.again.sum() <= REMEMBERED else np.zeros(len(self.again), dtype=bool)
        size = self.size[again]
        self.flat = self.flat[np.repeat(self.at[again], size) + rank_in(size)]
        self.key, self.at, self.size, self.used = self.key[again], np.cumsum(size) - size, size, len(self.flat)
        self.again = np.zeros(len(self.key), dtype=bool)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text, as unsigned 32-bit arrays."""
        out = []
        for lo, hi in slices(texts, SLICE):
            out += self._slice(texts[lo:hi])
        return out

    def _slice(self, texts):
        units = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), dtype="<u2") for t in texts]
        plain = [i for i, u in enumerate(units) if not (CLASSES[u] == FOREIGN).any()]
        out: list = [None] * len(texts)
        if odd := sorted(set(range(len(texts))) - set(plain)):
            for i, e in zip(odd, self.library.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False)):
                out[i] = np.array(e.ids, dtype=np.uint32)
        if plain:
            own = [texts[i] for i in plain]
            joined = "".join(own)
            if self.kind == "word":
                joined = joined.lower()
            starts = np.zeros(len(own) + 1, dtype=np.int64)
            np.cumsum([len(units[i]) for i in plain], out=starts[1:])
            for i, x in zip(plain, self._cut(joined, starts)):
                out[i] = x
        return out

    def _cut(self, joined, starts):
        codes = np.frombuffer(joined.encode("utf-16-le"), dtype="<u2")
        begin, end = (byte_spans if self.kind == "byte" else word_pieces)(codes, starts)
        if not len(begin):
            return [np.zeros(0, dtype=np.uint32) for _ in starts[1:]]
        key = spans_of(codes, begin, end)
        order = np.argsort(key)
        ranked = key[order]
        new = np.append(True, ranked[1:] != ranked[:-1])
        distinct, first = ranked[new], order[new]
        where = np.empty(len(key), dtype=np.int64)
        where[order] = np.cumsum(new) - 1
        if len(self.key) + len(distinct) > REMEMBERED:
            self._forget()
        spot = np.searchsorted(self.key, distinct)
        known = np.append(self.key, np.uint64(0))[spot] == distinct if len(self.key) else np.zeros(len(distinct), dtype=bool)
        known &= spot < len(self.key)
        self.again[spot[known]] = True
        new = np.flatnonzero(~known)
        if len(new):
            pieces = [joined[a:b] for a, b in zip(begin[first[new]].tolist(), end[first[new]].tolist())]
            got = [e.ids for lo in range(0, len(pieces), 4096)  # the library's own results are large
                   for e in self.library.encode_batch_fast(pieces[lo:lo + 4096], add_special_tokens=False)]
            self._keep(distinct[new], spot[new], got)
        entry = (spot + np.cumsum(~known) - ~known)[where]
        size = self.size[entry]
        ids = self.flat[np.repeat(self.at[entry], size) + rank_in(size)]
        total = np.zeros(len(size) + 1, dtype=np.int64)
        np.cumsum(size, out=total[1:])
        bounds = total[np.searchsorted(begin, starts)]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def _keep(self, keys: np.ndarray, spot: np.ndarray, got: list[list[int]]):
        """Remember the ids of new pre-tokens, whose hashes belong before the given spots."""
        size = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        more = int(size.sum())
        if self.used + more > len(self.flat):
            self.flat = np.concatenate([self.flat[:self.used], np.zeros(max(self.used, more), dtype=np.uint32)])
        self.flat[self.used:self.used + more] = np.fromiter(chain.from_iterable(got), dtype=np.uint32, count=more)
        self.key, self.again = np.insert(self.key, spot, keys), np.insert(self.again, spot, False)
        self.at, self.size = np.insert(self.at, spot, self.used + np.cumsum(size) - size), np.insert(self.size, spot, size)
        self.used += more


def _first(n, starts):
    first = np.zeros(n + 1, dtype=bool)
    first[starts] = True
    return first


def byte_spans(codes, starts):
    """Spans of the byte-level pre-tokens: runs of letters, digits or other signs with one space before
    them; white space else, of which the last character before a sign stands apart."""
    kind = CLASSES[codes]
    first = _first(len(codes), starts)[:-1]
    before = np.concatenate([[np.uint8(FOREIGN)], kind[:-1]])
    space = kind == SPACE
    run = first | (kind != before)
    spaced = np.concatenate([[False], codes[:-1] == 0x20]) & ~first
    follows = np.concatenate([~space[1:] & ~first[1:], [False]])
    begin = np.flatnonzero(np.where(space, run | follows, run & ~spaced))
    return begin, np.append(begin[1:], len(codes))


def word_pieces(codes, starts):
    """Spans of runs of letters, single digits and runs of other signs."""
    kind = CLASSES[codes]
    first = _first(len(codes), starts)
    before = np.concatenate([[np.uint8(FOREIGN)], kind[:-1]])
    begins = (kind != SPACE) & (first[:-1] | (kind != before) | (kind == DIGIT))
    after = np.append(kind[1:], np.uint8(FOREIGN))
    ends = (kind != SPACE) & (first[1:] | (kind != after) | (kind == DIGIT))
    if len(codes):
        ends[-1] = kind[-1] != SPACE
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1
