"""Runs of equal keys in sorted Arrow batches, handed over whole or, where they are long, in parts."""

import numpy as np
import pyarrow as pa


def _pairs_only(batch, key):
    """Without the rows whose key no neighbour has; the first and last row stay, as other batches touch them."""
    values = batch.column(key).to_numpy()
    same = values[1:] == values[:-1]
    keep = np.ones(len(values), dtype=bool)
    keep[1:-1] = same[:-1] | same[1:]
    return batch if keep.all() else batch.take(pa.array(np.flatnonzero(keep)))


def runs(batches, key: str, limit: int):
    """(table, whole) per run of equal keys; the batches must be sorted by the key. Most runs of one row are left out.

    A run of more than ``limit`` rows comes in parts with whole=False, so that memory stays bounded.
    """
    held, rows, last, long = [], 0, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = _pairs_only(batch, key)
        values = batch.column(key).to_pylist()
        lo = 0
        while lo < len(values):
            hi = lo + 1
            while hi < len(values) and values[hi] == values[lo]:
                hi += 1
            if rows and values[lo] != last:
                yield pa.Table.from_batches(held), not long
                held, rows, long = [], 0, False
            elif rows > limit:
                yield pa.Table.from_batches(held), False
                held, rows, long = [], 0, True
            last = values[lo]
            held.append(batch.slice(lo, hi - lo))
            rows += hi - lo
            lo = hi
    if rows:
        yield pa.Table.from_batches(held), not long and rows <= limit


class Union:
    """Union-find over 0 .. n - 1; the smallest member is the root."""

    def __init__(self, n: int):
        self.of = list(range(n))

    def root(self, i: int) -> int:
        while self.of[i] != i:
            self.of[i] = self.of[self.of[i]]
            i = self.of[i]
        return i

    def join(self, i: int, j: int):
        i, j = self.root(i), self.root(j)
        if i != j:
            self.of[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.of))], dtype=np.int64)
