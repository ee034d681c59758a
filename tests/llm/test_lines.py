"""Line dedup: keys under which the same lines meet are one run, and edit distances of many pairs."""

import random

import numpy as np
import pyarrow as pa

from designstats.llm import op2_lines


def batch(rows, names):
    return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=names)


def test_keys_of_the_same_lines_become_one():
    rows = [(k, line, 0, 50) for k in (5, 6, 9) for line in (1, 2)] + [(8, line, 0, 50) for line in (1, 2, 3)]
    out = pa.Table.from_batches(op2_lines.with_partner([batch(sorted(rows), ["key", "line", "sim", "size"])]))
    runs = {}
    for k, line in zip(out["key"].to_pylist(), out["line"].to_pylist()):
        runs.setdefault(k, set()).add(line)
    assert [runs[k] for k in sorted(runs)] == [{1, 2, 3}, {1, 2}]  # the larger run comes first


def test_edit_distances_of_many_pairs_equal_those_of_one():
    rnd = random.Random(3)
    pairs = []
    for _ in range(400):
        a = bytes(rnd.choices(b"abcd ", k=rnd.randint(1, 200)))
        b = bytearray(a)
        for _ in range(rnd.randint(0, 40)):
            at = rnd.randrange(len(b))
            b[at:at + rnd.randint(0, 1)] = rnd.choice((b"", b"a", b"\xc3\xa9"))
            b = b or bytearray(b"a")
        pairs.append((a, bytes(b), rnd.randint(0, 40)))
    found = op2_lines.within(pairs).tolist()
    assert found == [op2_lines.edit_distance(a, b) <= k for a, b, k in pairs] and 0 < sum(found) < len(pairs)
    assert op2_lines.within([]).tolist() == []


def test_stars_do_not_depend_on_the_size_of_runs(monkeypatch):
    rnd, text = random.Random(5), {}
    for line in range(60):
        words = [b"word%d" % (i + 100 * (line // 12)) for i in range(40)]
        words[rnd.randrange(40)] = b"other"
        text[line] = b" ".join(words)
    rows = [(k, line, 0, text[line], [1, 2, 3]) for k in (1, 2, 3) for line in range(60)]

    def groups():
        root = np.arange(60)
        for out in op2_lines.linked([batch(rows[i:i + 90], ["key", "line", "sim", "text", "keys"]) for i in (0, 90)]):
            for a, b in zip(*(c.to_pylist() for c in out.columns)):
                root[root == root[a]] = root[b]
        return {frozenset(np.flatnonzero(root == r).tolist()) for r in root}

    one = groups()
    monkeypatch.setattr(op2_lines, "SMALL", 100)
    assert groups() == one and len(one) > 1


def test_banded_distances_of_every_width_equal_those_of_one():
    rnd, pairs = random.Random(11), []
    for most in (0, 3, 62, 63, 64, 100, 127, 128, 200, 520):
        for n in range(3 * op2_lines.FEWEST):
            a = bytes(rnd.choices(b"abcde ", k=most + rnd.randint(1, 300)))
            b = bytearray(a)
            for _ in range(rnd.randint(0, 2 * most)):
                at = rnd.randrange(len(b))
                b[at:at + rnd.randint(0, 1)] = rnd.choice((b"", b"a", b"\xc3\xa9"))
                b = b or bytearray(b"a")
            pairs.append((a, bytes(b), most) if n % 2 else (bytes(b), a, most))
    found = op2_lines.within(pairs).tolist()
    assert found == [op2_lines.edit_distance(a, b) <= k for a, b, k in pairs] and 20 < sum(found) < len(pairs) - 20


def test_letters_never_part_alike_lines():
    rnd, text = random.Random(2), []
    for _ in range(60):
        text.append(bytes(rnd.choices(b"abcdefgh \xc3", k=rnd.randint(20, 90))))
        text.append(bytes(c if rnd.random() < 0.9 else 97 for c in text[-1]))
    i, j = np.triu_indices(len(text), 1)
    most = np.array([max(len(text[x]), len(text[y])) // 10 for x, y in zip(i, j)])
    far = op2_lines.far_apart(op2_lines.counted(text), i, j, most)
    assert far.any() and not any(op2_lines.edit_distance(text[x], text[y]) <= k for x, y, k, f in zip(i, j, most, far) if f)


def test_keys_are_moved_as_bytes_and_sorted_in_their_part():
    rnd = random.Random(4)
    lines = [(x, 3 * x, 40 + x, [rnd.getrandbits(64) - (1 << 63) for _ in range(rnd.randint(1, 9))]) for x in range(50)]
    packs = [p for lo in (0, 25, 50) for p in op2_lines.packed(3)([pa.RecordBatch.from_arrays(
        [pa.array(x) for x in zip(*lines[lo:lo + 25])] or [pa.array([], t) for t in (pa.int64(),) * 3 + (pa.list_(pa.int64()),)],
        names=["line", "sim", "size", "keys"])])]
    assert sum(p.num_rows for p in packs) <= 2 * 3  # a row for each part, not for each key
    got = []
    for part in range(3):
        own = [p.filter(pa.array([x == part for x in p.column("part").to_pylist()], pa.bool_())) for p in packs]
        rows = [r for b in op2_lines.in_order(own) for r in b.to_pylist()]
        assert [r["key"] for r in rows] == sorted(r["key"] for r in rows)
        got += [(r["key"], r["line"], r["sim"], r["size"]) for r in rows]
    assert sorted(got) == sorted((k, x, sim, size) for x, sim, size, keys in lines for k in keys)


def test_runs_of_a_batch_are_compared_together(monkeypatch):
    rnd, rows, asked, within = random.Random(9), [], [], op2_lines.within
    for run in range(20):
        for line in range(40):
            words = [b"word%d" % (i + 100 * run) for i in range(40)]
            del words[rnd.randrange(40)]
            rows.append((run, 40 * run + line, 0, b" ".join(words), [run]))
    monkeypatch.setattr(op2_lines, "within", lambda pairs: asked.append(len(pairs)) or within(pairs))
    stars = list(op2_lines.linked([batch(rows, ["key", "line", "sim", "text", "keys"])]))
    root = {a: b for out in stars for a, b in zip(*(c.to_pylist() for c in out.columns))}
    assert len(root) == 20 * 39 and all(a // 40 == b // 40 for a, b in root.items())
    assert len(asked) <= 20
