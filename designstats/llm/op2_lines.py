"""Line dedup, fuzzy: SimHash of normalised lines, pigeonhole blocks, verified edit similarity, one occurrence kept.

A line is normalised to its words in lower case, digits as 0. Equal normalised lines are one line. Two
SimHashes are taken over the words of a line. In the sparse one a word votes only in one block, chosen by its
hash; there are 8 blocks, from 64 words on 16, and so on. A changed word touches two blocks at most, so by the
pigeonhole principle lines with few changes keep blocks alike, and they meet in a join on hashes of the votes. A block
with few words is joined together with those after it (see ``block_keys``). In the dense SimHash of 64 bits every word votes on
every bit; lines that meet are candidates if these differ in at most ``DISTANCE`` bits. Candidates
are linked if their edit similarity is at least ``SIMILARITY``. Of each connected group of lines the first
occurrence in the order (doc_id, text hash, line) stays.
"""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from designstats.llm.arrays import encoded, mix, rank_in, seed, slices, spans_of, trimmed, word_spans
from designstats.llm.common import plain_names, stored
from designstats.llm.graph import components, int64s, may_hold, sized_filter
from designstats.llm.runs import Union, runs

DISTANCE, SIMILARITY = 10, 0.9
#: Words from which on the number of blocks doubles, and the most blocks of a line.
WORDS, BLOCKS, MOST_BLOCKS = 64, 8, 512
#: Words that a key covers at least; in shorter lines this share of the words.
COVER, SHARE = 3, 4
#: Keys of lines that a task sorts, and rows that it hands on at once; what it holds of each.
KEYS, SORTED, KEYED = 1 << 18, 1 << 16, np.dtype([("key", "<i8"), ("line", "<i8"), ("sim", "<i8"), ("size", "<i4")])
#: Rows of one run that are compared at once; a longer run is compared part by part.
RUN = 8192
#: Rows of a run up to which its pairs are compared together with those of other runs, and pairs of rows of such runs.
SMALL, TOGETHER = 512, 1 << 21
#: Pairs of longer runs that are compared together, and pairs of rows whose SimHashes are.
PAIRS, GRID = 4096, 1 << 17
#: Pairs whose edit distances are worked out together, for a table of 64 rows.
ROWS = 2048
#: Words of 64 bits across the table of an edit distance, up to which many pairs are worked out together.
BAND = 8
#: Pairs for each such word, of which less are worked out one by one.
FEWEST = 8
#: Classes of letters that are counted in a line; slots of the lines counted at once.
LETTERS, COUNTED = 64, 1 << 18
#: For each byte its 8 bits, the lowest first, as 8 bytes of 0 or 1.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
ONE, TOP = np.uint64(1), np.uint64(63)
#: A character of a word, before the line is in lower case.
IN_WORD = re.compile("[0-9A-Za-z_\x80-\U0010ffff]")


def lines_of(texts: list[str], parts: str = "sim"):
    """Per line with words: text number, line number, two hashes, SimHash (dense; and where the keys of each line start, the keys),
    and where its words are.

    Also the number of lines of every text. parts says how far to go: "place" or "sim".
    """
    data, starts = encoded([t.lower() for t in texts])
    stop = np.flatnonzero(data == 10)
    begin = np.concatenate([[0], stop[:-1] + 1])
    text = np.searchsorted(starts, begin, "right") - 1
    total = np.bincount(text, minlength=len(texts))
    place = np.arange(len(begin)) - (np.cumsum(total) - total)[text]
    plain = np.where((data >= 48) & (data < 58), np.uint8(48), data)
    a, b, _ = word_spans(plain, starts)
    first = np.searchsorted(a, begin)
    count = np.diff(np.append(first, len(a)))
    full = np.flatnonzero(count > 0)
    first, count, text, place = first[full], count[full], text[full], place[full]
    one = two = np.zeros(0, dtype=np.uint64)
    sim = one, np.zeros(1, dtype=np.int64), one
    if len(full) and parts == "sim":
        word = spans_of(plain, a, b)
        rank = (np.arange(len(a)) - np.repeat(first, count)).astype(np.uint64)
        spot = mix(word + mix(rank))
        one = mix(np.add.reduceat(spot, first) + count.astype(np.uint64))
        two = mix(np.add.reduceat(mix(spot ^ seed(7)), first) + count.astype(np.uint64))
        sim = simhash(word, first, count), *block_keys(word, count)
    return text, place, one, two, sim, (plain, a, b, first, count), total


def nodes(ids: pa.Array, copies: pa.Array, place: np.ndarray) -> np.ndarray:
    """A number for a line, from where it comes first."""
    ids, copies = (x.fill_null(0).to_numpy().view(np.uint64) for x in (ids, copies))
    return mix(mix(mix(ids + seed(14)) + copies) + place.astype(np.uint64))


def simhash(word: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Majority of each bit over the words of a line."""
    part = -(-count // 255)  # so many words are counted in a byte for each bit
    cut = np.repeat(first, part) + 255 * rank_in(part)
    ones = np.add.reduceat(LANES[word.view(np.uint8)].reshape(-1, 8), cut, axis=0).view(np.uint8)
    if len(cut) > len(first):
        ones = np.add.reduceat(ones, np.cumsum(part) - part, axis=0, dtype=np.int32)
    else:
        ones = ones.astype(np.int32)
    return np.packbits(2 * ones >= count[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def normalised(parts, i: int) -> bytes:
    plain, a, b, first, count = parts
    lo, n = first[i], count[i]
    return b" ".join(plain[x:y].tobytes() for x, y in zip(a[lo:lo + n].tolist(), b[lo:lo + n].tolist()))


def sizes(parts) -> np.ndarray:
    """Bytes of every normalised line."""
    _, a, b, first, count = parts
    end = np.concatenate([[0], np.cumsum(b - a)])
    return end[first + count] - end[first] + count - 1


def edit_distance(a: bytes, b: bytes, most: float = math.inf) -> int:
    """Levenshtein distance by bit vectors (Myers), one step per byte of b; some number above ``most`` once it must exceed it."""
    if not a or not b:
        return max(len(a), len(b))
    at: dict[int, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score, rest = full, 0, len(a), len(b)
    for c in b:
        eq = at.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & full, up & xh
        score += bool(ph & last) - bool(mh & last)
        rest -= 1
        if score - rest > most:
            return score - rest
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        up, down = mh | ~(xv | ph) & full, ph & xv
    return score


def shared_head(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def middles(a: bytes, b: bytes):
    """The lines without their common head and the common tail of the rest."""
    head = shared_head(a, b)
    a, b = a[head:], b[head:]
    tail = shared_head(a[::-1], b[::-1])
    return a[:len(a) - tail], b[:len(b) - tail]


def alike(a: bytes, b: bytes, least: float = SIMILARITY) -> bool:
    """Whether the edit distance is at most (1 - least) of the longer length."""
    allowed = (1 - least) * max(len(a), len(b)) + 1e-9
    return abs(len(a) - len(b)) <= allowed and edit_distance(*middles(a, b), allowed) <= allowed


def within(pairs: list[tuple[bytes, bytes, int]]) -> np.ndarray:
    """Whether the edit distance of each pair is at most its number; no line is empty. Pairs of about one length are taken together."""
    out, groups = np.zeros(len(pairs), dtype=bool), {}
    for i, (a, b, most) in enumerate(pairs):
        if len(a) < len(b):
            a, b = b, a
        if most >= len(a):
            out[i] = True
        elif len(a) - len(b) <= most:
            groups.setdefault(most // 64 + 1, []).append((i, a, b, most))
    for width, group in groups.items():
        if width > BAND or len(group) < FEWEST * width:
            for i, a, b, most in group:
                a, b = middles(a, b)
                out[i] = edit_distance(a, b, most) <= most
            continue
        group.sort(key=lambda p: -len(p[2]))
        lo = 0
        while lo < len(group):
            hi = lo + ROWS // width
            number, *own = zip(*group[lo:hi])
            out[list(number)] = _within(*own, width)
            lo = hi
    return out


def _within(one, two, most, width: int) -> np.ndarray:
    """The steps of ``edit_distance`` for pairs by falling length of the second line, which is not the longer one: of each column of the
    table only the 64 * width rows about the diagonal, as an alignment with at most that many edits stays among them (Hyyro).

    The rows move down by one with each step. Along the diagonal that ends at the last row and column the distance never falls.
    """
    n, m, k = np.array([len(x) for x in one]), np.array([len(x) for x in two]), np.array(most)
    spare, steps = n - m, -(-int(m[0]) // 64) * 64
    last = 64 * width - 1 - (k - spare) // 2  # the bit of that diagonal
    ahead, wide = last - spare, steps + 64 * width
    # in UTF-8 there is no byte of 255
    rows = np.frombuffer(b"".join([x.rjust(len(x) + y, b"\xff").ljust(wide, b"\xff")[:wide] for x, y in zip(one, ahead.tolist())]), np.uint8).reshape(-1, wide)
    columns = np.frombuffer(b"".join([x.ljust(steps) for x in two]), np.uint8).reshape(-1, steps)

    at, score = np.arange(len(one)), spare.copy()
    low = np.clip(ahead - 64 * np.arange(width)[:, None], 0, 64).astype(np.uint64)
    up, down, out = ~np.uint64(0) << low, np.zeros((width, len(one)), dtype=np.uint64), np.zeros(len(one), dtype=bool)
    for j in range(0, steps, 64):
        near = np.lib.stride_tricks.sliding_window_view(rows[at, j:j + 64 * width + 63], 64 * width, axis=1)
        equal = np.packbits((near == columns[at, j:j + 64, None]).reshape(-1), bitorder="little").view(np.uint64).reshape(len(at), 64, width)
        equal = np.ascontiguousarray(equal.transpose(1, 2, 0))
        kept = np.empty_like(equal)
        for eq, same in zip(equal, kept):
            part = eq & up
            np.add(part, up, out=same)
            if width > 1:
                over = same < part
                for w in range(1, width):
                    same[w] += over[w - 1]
                    over[w] |= over[w - 1] & (same[w] == 0)
            same ^= up
            same |= eq
            same |= down
            ph = same | up
            np.invert(ph, out=ph)
            ph |= down
            np.bitwise_and(same, up, out=up)
            after = same >> ONE
            if width > 1:
                after[:-1] |= same[1:] << TOP
            np.bitwise_and(after, ph, out=down)
            after |= ph
            np.invert(after, out=after)
            up |= after
        equals = kept[:, last[at] >> 6, np.arange(len(at))] >> (last[at] & 63).astype(np.uint64) & ONE
        score += ((equals == 0) & (np.arange(j, j + 64)[:, None] < m[at])).sum(0)
        ended, far = m[at] <= j + 64, score > k[at]
        out[at[ended & ~far]] = True
        if (ended | far).any():
            keep = ~(ended | far)
            at, score, up, down = at[keep], score[keep], up[:, keep], down[:, keep]
            if not len(at):
                break
    return out


def counted(text: list[bytes]) -> np.ndarray:
    """How often each class of letters is in the lines: one row per line."""
    out, step = np.zeros((len(text), LETTERS), dtype=np.int32), COUNTED // LETTERS
    for lo in range(0, len(text), step):
        own = text[lo:lo + step]
        data, n = np.frombuffer(b"".join(own), dtype=np.uint8), np.array([len(t) for t in own])
        cell = np.repeat(np.arange(len(own), dtype=np.int32) * LETTERS, n) + data % LETTERS
        out[lo:lo + step] = np.bincount(cell, minlength=len(own) * LETTERS).reshape(len(own), -1)
    return out


def far_apart(counts: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether so many letters must be put in or taken out that more edits are needed."""
    out, step = np.zeros(len(i), dtype=bool), COUNTED // LETTERS
    for lo in range(0, len(i), step):
        gap = counts[i[lo:lo + step]] - counts[j[lo:lo + step]]
        more = np.maximum(gap, 0).sum(1)
        out[lo:lo + step] = np.maximum(more, more - gap.sum(1)) > most[lo:lo + step]
    return out


def block_keys(word: np.ndarray, count: np.ndarray):
    """Where each line's keys start (one more entry), and the keys: one for each block of the sparse SimHash that has votes.

    A key stands for the votes of its block and, while these come from fewer than COVER words (in lines shorter than COVER * SHARE words, the SHARE-th part of them),
    for those of the next blocks, in a circle. Lines whose length is within a tenth of a change of the number of blocks have
    the keys of both numbers.
    """
    level = np.log2(np.maximum(np.stack([count * 0.9, count, count * 1.1]), WORDS / 2) / (WORDS / 2)).astype(np.int64)
    level = np.minimum(level, int(math.log2(MOST_BLOCKS // BLOCKS)))
    line = np.concatenate([np.arange(len(count)), np.flatnonzero(level[0] < level[1]), np.flatnonzero(level[2] > level[1])])
    level = np.concatenate([level[1], level[0][level[0] < level[1]], level[2][level[2] > level[1]]])
    order = np.argsort(line, kind="stable")
    line, level = line[order], level[order]

    n, blocks = count[line], BLOCKS << level
    start = np.cumsum(blocks) - blocks
    of = np.repeat(np.arange(len(line)), n)  # the entry of each vote
    vote = mix(word ^ seed(11))[np.repeat((np.cumsum(count) - count)[line] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    cell = start[of] + (vote >> np.uint64(32)).astype(np.int64) % blocks[of]
    cells = int(blocks.sum())
    voters, votes = np.bincount(cell, minlength=cells), np.zeros(cells, dtype=np.uint64)
    np.add.at(votes, cell, vote)

    at = np.flatnonzero(voters)
    entry = np.searchsorted(start, at, "right") - 1
    key, covered = mix(votes[at] + seed(12) + level[entry].astype(np.uint64)), voters[at].copy()
    least, step = np.clip(n[entry] // SHARE, 1, COVER), 1
    open_ = np.flatnonzero(covered < least)
    while len(open_):
        e = entry[open_]
        after = start[e] + (at[open_] - start[e] + step) % blocks[e]
        key[open_] = np.where(voters[after] > 0, mix(key[open_] * np.uint64(3) + votes[after]), key[open_])
        covered[open_] += voters[after]
        open_, step = open_[covered[open_] < least[open_]], step + 1
    return np.searchsorted(line[entry], np.arange(len(count) + 1)), key


def sizes_fit(a, b):
    """Whether lines of these sizes in bytes can have the edit similarity."""
    return np.abs(a - b) <= (1 - SIMILARITY) * np.maximum(a, b) + 1e-9


def packed(parts: int):
    """Lines -> for each part of all keys the rows (key, line, SimHash, size) of a batch, as bytes: they are moved and sorted as such."""
    def pack(batches):
        for batch in batches:
            keys = batch.column("keys")
            count, key = keys.value_lengths().to_numpy(), keys.flatten().to_numpy()
            part = (key.view(np.uint64) % np.uint64(parts)).astype(np.min_scalar_type(parts))
            order = np.argsort(part, kind="stable")
            of, rows = np.repeat(np.arange(len(count)), count)[order], np.empty(len(key), dtype=KEYED)
            rows["key"] = key[order]
            for name in ("line", "sim", "size"):
                rows[name] = batch.column(name).to_numpy()[of]
            number, first = np.unique(part[order], return_index=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number.astype(np.int32)), pa.array([x.tobytes() for x in np.split(rows, first[1:])][:len(first)], pa.binary())], names=["part", "rows"])

    return pack


def in_order(batches):
    """The rows of a part, sorted by key."""
    rows = np.frombuffer(b"".join(x for batch in batches for x in batch.column("rows").to_pylist()), dtype=KEYED)
    order = np.argsort(rows["key"])
    for lo in range(0, len(order), SORTED):
        own = rows[order[lo:lo + SORTED]]
        yield pa.RecordBatch.from_arrays([pa.array(own[name].astype(np.int64)) for name in KEYED.names], names=KEYED.names)


def with_partner(batches):
    """(key, line, SimHash) of those that meet another one near them, of about their size, under the key, from rows sorted by key.

    The key is replaced by a hash of the lines that have a partner under it, so that keys under which the same lines meet become
    one; it is the less, the more lines these are. Rows of 32 bytes are held for one key; two rows that both have a partner are not compared any more.
    """
    def columns(batch):
        return [batch.column(c).to_numpy() for c in ("key", "line", "sim", "size")]

    held = [np.zeros(0, dtype=np.int64)] * 4
    for batch in (*batches, None):
        if batch is not None:
            held = [np.concatenate(x) for x in zip(held, columns(batch))]
            if not len(held[0]):
                continue
            whole = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on in the next batch
        else:
            whole = len(held[0])
        key, line, sim, size = (x[:whole] for x in held)
        hit, at, step = np.zeros(whole, dtype=bool), np.arange(whole), 1
        while True:
            at = at[at + step < whole]
            at = at[key[at] == key[at + step]]
            if not len(at):
                break
            near = at[~(hit[at] & hit[at + step])]
            near = near[sizes_fit(size[near], size[near + step])]
            near = near[np.bitwise_count(sim[near].view(np.uint64) ^ sim[near + step].view(np.uint64)) <= DISTANCE]
            hit[near] = hit[near + step] = True
            step += 1
        if hit.any():
            key, line, sim = key[hit], line[hit], sim[hit]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            met, count = mix(np.add.reduceat(mix(line.view(np.uint64) ^ seed(13)), first)), np.diff(np.append(first, len(key)))
            met = met >> np.uint64(16) | (0x7fff - np.minimum(count, 0x7fff)).astype(np.uint64) << np.uint64(48)
            yield pa.RecordBatch.from_arrays([int64s(np.repeat(met, count)), pa.array(line), pa.array(sim)], names=["key", "line", "sim"])
        held = [x[whole:] for x in held]


def linked(batches):
    """A star for each group of alike lines in a run; lines already joined are not compared again.

    A pair with few rivals is left to the least key that both lines have. Runs of up to SMALL rows are compared together.
    """
    stars = []

    def longer():
        for batch in batches:
            key = batch.column("key").to_numpy()
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else []
            count = np.diff(np.append(first, len(key)))
            small = count <= SMALL
            small[:1] = small[-1:] = False  # they may go on in other batches
            own = np.flatnonzero(np.repeat(small & (count > 1), count))
            part = np.repeat(np.cumsum(np.where(small, count * count, 0)) // TOGETHER, count)[own]
            stars.extend(_star_edges(batch.take(pa.array(x))) for x in np.split(own, np.flatnonzero(np.diff(part)) + 1) if len(x))
            yield batch.filter(pa.array(~np.repeat(small, count)))

    for table, _ in _parts(longer()):
        yield from stars
        stars.clear()
        sims = table.column("sim").to_numpy().view(np.uint64)
        if len(sims) < 2:
            continue
        key, line = table.column("key")[0].as_py(), table.column("line").to_numpy()
        order = np.argsort(line, kind="stable")
        text = table.column("text").take(order).to_pylist()
        left = left_to_others(table.column("keys").take(order).combine_chunks(), np.full(len(line), key))
        sims, line, size = sims[order], line[order], np.array([len(t) for t in text])
        groups, counts, held, step = Union(len(sims)), counted(text), [], max(1, GRID // len(sims))
        for lo in range(0, len(sims) - 1, step):
            root = groups.roots()
            near = np.bitwise_count(sims[lo:lo + step, None] ^ sims[lo + 1:]) <= DISTANCE
            near &= sizes_fit(size[lo:lo + step, None], size[lo + 1:])
            i, j = np.nonzero(near & (np.arange(near.shape[0])[:, None] <= np.arange(near.shape[1])))
            i, j = i + lo, j + lo + 1
            apart = root[i] != root[j]
            held.append(np.stack([i[apart], j[apart]]))
            if sum(x.shape[1] for x in held) >= PAIRS:
                join_alike(groups, *np.concatenate(held, axis=1), text, counts, left)
                held = []
        if held:
            join_alike(groups, *np.concatenate(held, axis=1), text, counts, left)
        yield _stars(groups, line)
    yield from stars


def _star_edges(batch):
    """The stars of all runs of a batch, compared together."""
    key, line, sim = (batch.column(c).to_numpy() for c in ("key", "line", "sim"))
    text = batch.column("text").to_pylist()
    size = np.array([len(t) for t in text])
    found, at, step = [], np.arange(len(key)), 1
    while len(at := at[at + step < len(key)]) and len(at := at[key[at] == key[at + step]]):
        near = at[sizes_fit(size[at], size[at + step])]
        near = near[np.bitwise_count(sim[near].view(np.uint64) ^ sim[near + step].view(np.uint64)) <= DISTANCE]
        found.append(np.stack([near, near + step]))
        step += 1
    if not found:
        return _stars(Union(0), line)
    i, j = np.concatenate(found, axis=1)
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    groups = Union(len(key))
    join_alike(groups, i, j, text, counted(text), left_to_others(batch.column("keys"), key))
    return _stars(groups, line)


def left_to_others(keys: pa.ListArray, key: np.ndarray):
    """A test whether pairs of lines meet under a key less than their present one, from the keys of each line."""
    count, values, sets = keys.value_lengths().to_numpy(), keys.flatten().to_numpy(), {}
    end = np.cumsum(count)

    def lesser(x):
        if x not in sets:
            sets[x] = {k for k in values[end[x] - count[x]:end[x]].tolist() if k < key[x]}
        return sets[x]

    def left(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = (count[i] > 1) & (count[j] > 1)  # a line with one key has no lesser one
        own = np.flatnonzero(out)
        out[own] = [not lesser(x).isdisjoint(lesser(y)) for x, y in zip(i[own].tolist(), j[own].tolist())]
        return out

    return left


def join_alike(groups: Union, i: np.ndarray, j: np.ndarray, text: list[bytes], counts: np.ndarray, left):
    """Join the groups of alike pairs that are not left to another run.

    Every group is compared with one other, and in each step with more; pairs joined by then drop out.
    """
    size, each = np.array([len(t) for t in text]), 1
    most = ((1 - SIMILARITY) * np.maximum(size[i], size[j]) + 1e-9).astype(np.int64)
    while len(i):
        root = groups.roots()
        a, b = root[i], root[j]
        apart = a != b
        i, j, most, b = i[apart], j[apart], most[apart], b[apart]
        order = np.argsort(b, kind="stable")
        rank = np.empty(len(b), dtype=np.int64)
        rank[order] = rank_in(np.bincount(b))
        now = np.flatnonzero(rank < each)
        own = now[~left(i[now], j[now])]
        own = own[~far_apart(counts, i[own], j[own], most[own])]
        some = list(zip(i[own].tolist(), j[own].tolist(), most[own].tolist()))
        for (x, y, _), same in zip(some, within([(text[x], text[y], k) for x, y, k in some]).tolist()):
            if same:
                groups.join(x, y)
        i, j, most, each = np.delete(i, now), np.delete(j, now), np.delete(most, now), 2 * each


def _stars(groups: Union, line: np.ndarray):
    root = groups.roots()
    own = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays([pa.array(line[own]), pa.array(line[root[own]])], names=["a", "b"])


def _parts(batches):
    """Runs of a key; of a long run every pair of parts, so that each pair of rows meets."""
    earlier: list[pa.Table] = []
    last = None
    for table, whole in runs(batches, "key", RUN):
        key = table.column("key")[0].as_py()
        if key != last:
            earlier, last = [], key
        for other in earlier:
            yield pa.concat_tables([other, table]), False
        if not earlier:
            yield table, whole
        if not whole:
            earlier.append(table)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with ``text`` cut to the lines kept, and _n_lines, _n_kept (all other columns of docs stay, whatever
    their names; columns called _n_lines or _n_kept are replaced).

    Lines without words are always kept. A null text stays null with no line; an empty text has one line.
    Rows that repeat an id with an equal text keep the same lines; a null id comes first in the order.
    """
    docs, back = plain_names(docs.drop("_n_lines", "_n_kept"), ("doc_id", "text"))
    columns = docs.columns
    keyed = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_copy": F.xxhash64("text")})
    rows = keyed.select(F.col("_id").alias("id"), F.col("_copy").alias("copy"), F.coalesce("text", F.lit("")).alias("text"))

    def read(batches):
        for batch in batches:
            ids, copies, texts = batch.column("id"), batch.column("copy"), batch.column("text").to_pylist()
            for lo, hi in slices(texts):
                text, place, one, two, (sim, bounds, keys), parts, _ = lines_of(texts[lo:hi])
                at = pa.array(text + lo)
                own = ids.take(at), copies.take(at)
                keys = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), int64s(keys))
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(place, pa.int32()), int64s(nodes(*own, place)), int64s(one), int64s(two), int64s(sim), pa.array(sizes(parts)), keys],
                    names=["id", "copy", "place", "node", "line", "check", "sim", "size", "keys"])

    found = rows.mapInArrow(
        trimmed(read), "id long, copy long, place int, node long, line long, check long, sim long, size long, keys array<long>")
    lines = stored(found.groupBy("line", "check").agg(
        F.min(F.struct("id", "copy", "place", "node")).alias("first"), F.first("sim").alias("sim"), F.first("size").alias("size"),
        F.first("keys").alias("keys")).drop("line", "check"), "lines")

    # Lines under each key where another one is near; a line has all of its keys of this kind with it, at most MOST_BLOCKS or so.
    parts = (lines.agg(F.sum(F.size("keys"))).first()[0] or 0) // KEYS + 1
    packs = lines.select(F.col("first.node").alias("line"), "sim", "size", "keys").mapInArrow(trimmed(packed(parts)), "part int, rows binary")
    near = packs.repartitionById(parts, "part").mapInArrow(
        trimmed(lambda batches: with_partner(in_order(batches))), "key long, line long, sim long")
    live = stored(near.groupBy("line", "sim").agg(F.collect_set("key").alias("keys")), "live")
    bits = sized_filter(live, "line")

    def fetch(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in slices(texts):
                total = np.array([t.count("\n") + 1 for t in texts[lo:hi]])
                text, place = np.repeat(np.arange(lo, hi), total), rank_in(total)
                at = pa.array(text)
                node = nodes(batch.column("id").take(at), batch.column("copy").take(at), place)
                own, last, cut = np.flatnonzero(may_hold(bits, node)), None, []
                for t, k in zip(text[own].tolist(), place[own].tolist()):
                    split, last = split if t == last else texts[t].split("\n"), t
                    cut.append(split[k])
                if len(cut):
                    number, *_, parts, _ = lines_of(cut, "place")
                    own = own[number]
                    at = pa.array(text[own])
                    yield pa.RecordBatch.from_arrays(
                        [int64s(node[own]), batch.column("id").take(at), batch.column("copy").take(at), pa.array(place[own], pa.int32()),
                         pa.array([normalised(parts, i) for i in range(len(own))], pa.binary())], names=["line", "id", "copy", "place", "text"])

    texts = rows.mapInArrow(trimmed(fetch), "line long, id long, copy long, place int, text binary").dropDuplicates(["line"])
    texts = stored(texts.join(live, "line"), "texts")
    edges = texts.select("line", "sim", "text", "keys", F.explode("keys").alias("key"))
    edges = edges.repartition("key").sortWithinPartitions("key").mapInArrow(trimmed(linked), "a long, b long")
    groups = components(edges)

    # Places of first occurrences, taken back (as -1 - place) where the line is in a group, and put in again for the first of the group.
    joined = texts.select("line", F.struct("id", "copy", "place").alias("first")).join(groups.withColumnRenamed("node", "line"), "line")
    ahead = joined.groupBy("root").agg(F.min("first").alias("first"))
    marks = (lines.select("first.id", "first.copy", "first.place")
             .unionByName(joined.select("first.id", "first.copy", (-1 - F.col("first.place")).alias("place")))
             .unionByName(ahead.select("first.id", "first.copy", "first.place")))
    kept = marks.groupBy(F.col("id").alias("_k_id"), F.col("copy").alias("_k_copy")).agg(
        F.collect_list("place").alias("_kept"))  # up to three times as long as the document has lines
    both = keyed.join(kept, F.col("_id").eqNullSafe(F.col("_k_id")) & (F.col("_copy") == F.col("_k_copy")), "left")
    others = [c for c in columns if c != "text"]
    both = both.select(*others, "text", "_kept")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.select(*others, "text").schema)

    def cut(batches):
        for batch in batches:
            text, kept = batch.column("text").to_pylist(), batch.column("_kept")
            n = np.array([0 if t is None else t.count("\n") + 1 for t in text], dtype=np.int64)
            of, marks = np.repeat(np.arange(len(text)), kept.value_lengths().fill_null(0).to_numpy()), kept.flatten().to_numpy()
            back = marks < 0
            place = np.where(back, -1 - marks, marks)
            inside = place < n[of]
            back, place, total = back[inside], (np.cumsum(n) - n)[of[inside]] + place[inside], int(n.sum())
            gone = np.bincount(place[~back], minlength=total) <= np.bincount(place[back], minlength=total)
            doc, line = np.repeat(np.arange(len(text)), n)[gone], rank_in(n)[gone]
            out, n_kept, first = text, n.copy(), np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))[:len(doc)]
            for i, places in zip(doc[first].tolist(), np.split(line, first[1:])):
                own = out[i].split("\n")
                lost = {k for k in places.tolist() if IN_WORD.search(own[k])}
                if lost:
                    n_kept[i] -= len(lost)
                    out[i] = "\n".join(x for k, x in enumerate(own) if k not in lost)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(others))), pa.array(out, pa.string()), pa.array(n), pa.array(n_kept)],
                names=[*others, "text", "_n_lines", "_n_kept"])

    out = both.mapInArrow(trimmed(cut), schema + ", `_n_lines` long, `_n_kept` long")
    return out.select(*back, "_n_lines", "_n_kept")
