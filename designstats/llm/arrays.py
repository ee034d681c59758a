"""Small numpy helpers for texts in Arrow batches: slices of bounded size, word hashes, mixing."""

import ctypes

import numpy as np
import pyarrow as pa
import xxhash

#: Characters handled at once; one text alone may be longer.
SLICE = 1 << 18
#: Odd multiplier of the polynomial hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def slices(texts, limit: int = SLICE):
    """(lo, hi) over consecutive texts whose lengths sum to about the limit."""
    lo, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield lo, i
            lo, total = i, 0
        total += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, on a copy."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seed(i: int) -> np.uint64:
    return mix(np.array([(i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1], dtype=np.uint64))[0]


class Powers:
    """Powers of the hash base and of its inverse, grown when a longer text comes."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int):
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), SLICE)
            self.up, self.down = _powers(BASE, size), _powers(INVERSE, size)
        return self.up, self.down


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        out[done:done + more] = out[:more] * np.uint64(step)
        step = step * step & (1 << 64) - 1
        done += more
    return out


POWERS = Powers()


def prefix_sums(units: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash over the units; length len(units) + 1."""
    up, _ = POWERS.upto(len(units) + 1)
    out = np.zeros(len(units) + 1, dtype=np.uint64)
    np.cumsum(mix(units.astype(np.uint64) + np.uint64(1)) * up[:len(units)] if len(units) < 1 << 12
              else UNIT[units] * up[:len(units)], out=out[1:])
    return out


#: Mixed value of each 16-bit unit, so that one lookup replaces the mixing.
UNIT = mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1))


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every span [start, end) of the units."""
    _, down = POWERS.upto(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


#: Units from which on a span gets a hash of its own: the polynomial is taken modulo 2**64, where long regular words collide.
LONG = 128


def spans_of(units: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every span [start, end) of the units, whatever its length."""
    out = span_hash(prefix_sums(units), start, end)
    for i in np.flatnonzero(end - start >= LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(units[start[i]:end[i]].tobytes())
    return out


def give_back() -> None:
    """Hand freed memory of this worker back to the system, so that the next task does not find it filled."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own house
        pass


def trimmed(run):
    """A function over Arrow batches that leaves its worker without the memory it has used."""
    def tidy(batches):
        yield from run(batches)
        give_back()

    return tidy


#: Bytes that belong to words once a text is in lower case: a-z, 0-9, underscore and all of non-ASCII characters.
WORD = np.zeros(256, dtype=bool)
WORD[[*range(48, 58), 95, *range(97, 123), *range(128, 256)]] = True
#: The same rule as a regular expression on lower-case text.
WORD_PATTERN = "[0-9a-z_\\x{80}-\\x{10FFFF}]+"


def encoded(texts: list[str]):
    """The texts in UTF-8, each followed by a newline, and where each starts (one more entry: the end)."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    starts = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=starts[1:])
    return np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8), starts


def word_spans(data: np.ndarray, starts: np.ndarray, member: np.ndarray = WORD):
    """Spans of the maximal runs of member bytes, and where each text's words start (one more entry)."""
    flag = np.zeros(len(data) + 2, dtype=np.int8)
    flag[1:-1] = member[data]
    edge = np.diff(flag)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return start, end, np.searchsorted(start, starts)


def words(texts: list[str]):
    """Hash of every word of the texts in lower case, and where each text's words start (one more entry)."""
    data, starts = encoded([t.lower() for t in texts])
    start, end, of = word_spans(data, starts)
    return spans_of(data, start, end), of


def windows(values: np.ndarray, of: np.ndarray, n: int):
    """Order-sensitive hash of every n neighbouring values within a text, and where each text's windows start.

    A text of 1 to n - 1 values has one window, of all of them.
    """
    count = np.diff(of)
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    to = np.zeros(len(of), dtype=np.int64)
    np.cumsum(made, out=to[1:])
    text = np.repeat(np.arange(len(count)), made)
    first = of[:-1][text] + np.arange(to[-1]) - to[:-1][text]
    padded = np.concatenate([values, np.zeros(n, dtype=np.uint64)])
    last = of[1:][text]
    out = np.zeros(len(first), dtype=np.uint64)
    for k in range(n):
        at = first + k
        out = mix(out * np.uint64(3) + np.where(at < last, padded[np.minimum(at, len(padded) - 1)], np.uint64(k + 1)))
    return out, to


def rank_in(count: np.ndarray) -> np.ndarray:
    """0, 1, ... within consecutive groups of the given sizes."""
    end = np.cumsum(count)
    return np.arange(end[-1] if len(end) else 0) - np.repeat(end - count, count)
