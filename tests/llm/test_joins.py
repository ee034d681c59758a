"""Near copies, lines, fingerprints and decontamination against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
from helpers import empty, frame, hard_rows, prose, shingles

from designstats.llm import op1_jaccard, op2_lines, op5_spotsigs, op9_decontaminate


def near_rows():
    rows = hard_rows()
    for k in range(40):
        words = prose(50, 100).split()
        for j in range(k % 7):
            words[(13 * j + k) % 100] = f"new{k}{j}"
        rows.append((100 + k, " ".join(words)))
    return rows + [(200 + k, prose(900 + k, 60)) for k in range(30)]


def brute_classes(rows):
    sets = [shingles(t) for _, t in rows]
    of = list(range(len(rows)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    links = [set() for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            a, b, equal = sets[i], sets[j], (rows[i][1] or "") == (rows[j][1] or "")
            if equal or (a and b and len(a & b) >= 0.8 * len(a | b) - 1e-12):
                of[max(root(i), root(j))] = min(root(i), root(j))
                if not equal:
                    links[i].add(rows[j][1])
                    links[j].add(rows[i][1])
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    return sorted((str(d), str(min([x for x in least[root(i)] if x is not None], default=None)), len(links[i])) for i, (d, _) in enumerate(rows))


def test_jaccard_classes_equal_brute_force(spark):
    rows = near_rows()
    got = op1_jaccard.jaccard_classes(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == brute_classes(rows)
    assert op1_jaccard.jaccard_classes(empty(spark)).count() == 0


def test_large_nodes_split_and_meet_in_blocks(spark, monkeypatch):
    rows = near_rows()
    want = brute_classes(rows)
    monkeypatch.setattr(op1_jaccard, "SMALL", 8)  # nodes split, and near copies are compared block by block
    got = op1_jaccard.jaccard_classes(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == want


def test_dense_nodes_lose_no_pair_of_a_block(spark, monkeypatch):
    words = prose(50, 300).split()
    rows = [(k, " ".join([*words[:3 * k], "new", *words[3 * k + 1:]])) for k in range(60)]
    monkeypatch.setattr(op1_jaccard, "SMALL", 30)
    monkeypatch.setattr(op1_jaccard, "DEPTH", 1)  # every larger node is one of near copies
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 8)  # a run inside one batch counts as whole
    try:
        got = op1_jaccard.jaccard_classes(frame(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == brute_classes(rows)
    assert {r.n_links for r in got} == {59}


def test_trees_reach_the_recall():
    assert op1_jaccard.trees(0.8, 0.99) < op1_jaccard.trees(0.8, 0.999999)
    assert op1_jaccard.trees() == 4


def test_keep_one(spark):
    docs = frame(spark, near_rows())
    kept = op1_jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len({c for _, c, _ in brute_classes(near_rows())})
    assert 7 in ids and 8 not in ids and ids.count(9) == 1
    assert op1_jaccard.keep_one(empty(spark)).count() == 0


def brute_lines(rows):
    order = sorted({(d is not None, d or 0, t or "") for d, t in rows})
    lines = {}
    for known, d, t in order:
        _, _, one, _, _, parts, _ = op2_lines.lines_of([t])
        for k in range(len(one)):
            lines.setdefault(int(one[k]), op2_lines.normalised(parts, k))
    keys = list(lines)
    of = {k: k for k in keys}

    def root(k):
        while of[k] != k:
            k = of[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if op2_lines.alike(lines[a], lines[b]):
                of[root(a)] = root(b)
    return of, root


def test_lines_equal_brute_force(spark):
    base = [prose(k, 40) for k in range(6)]
    rows = hard_rows() + [
        (20, "\n".join(base)), (21, base[0].upper() + "\n" + base[3] + "\nown line"), (22, base[1] + "!\n\n" + base[1]),
        (23, base[2][:-2] + "xy"), (24, "own line 7\nOWN LINE 8"), (25, " ".join(base))]
    _, root = brute_lines(rows)
    docs = frame(spark, rows)
    out = op2_lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "_n_lines", "_n_kept"]
    seen, want = set(), {}
    texts = defaultdict(set)
    for d, t in rows:
        texts[d].add(t)
    hash_of = {(r.doc_id, r.text): r.h for r in docs.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()}
    ordered = sorted({(d, t) for d, t in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0, hash_of[x]))
    for d, t in ordered:
        kept = []
        for line in t.split("\n"):
            _, _, one, *_ = op2_lines.lines_of([line])
            key = root(int(one[0])) if len(one) else None
            if key is None or key not in seen:
                kept.append(line)
            if key is not None:
                seen.add(key)
        want[(d, t)] = "\n".join(kept)
    got = sorted((str(r.doc_id), str(r.text)) for r in out.collect())
    assert got == sorted((str(d), str(want.get((d, t)))) for d, t in rows)
    assert op2_lines.dedup_lines(empty(spark)).count() == 0


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    r = np.random.default_rng(0)
    for _ in range(300):
        a, b = (bytes(r.integers(97, 100, r.integers(0, 90)).astype(np.uint8)) for _ in "ab")
        assert op2_lines.edit_distance(a, b) == plain(a, b)
        assert op2_lines.alike(a, b, 0.6) == (plain(a, b) <= 0.4 * max(len(a), len(b)) + 1e-9)


def edited(line: str, r: random.Random) -> str:
    """The line after as many edits as an edit similarity of 0.9 allows, each of a letter or a word: the hardest pairs."""
    out, words = line, line.split()
    for _ in range(100):
        at = r.randrange(len(words))
        words[at:at + 1] = r.choice([
            [words[at][:-1] + "q"], [], [words[at], r.choice("ab")], ["".join(r.choice("abcdefghijklm") for _ in words[at])]])
        if not words or not op2_lines.alike(line.encode(), " ".join(words).encode()):
            break
        out = " ".join(words)
    return out


def meet(line: str, other: str) -> tuple[bool, int]:
    """Whether the lines share a key, and in how many bits their SimHashes differ."""
    _, _, _, _, (sim, bounds, keys), _, _ = op2_lines.lines_of([line, other])
    one, two = (set(keys[bounds[k]:bounds[k + 1]].tolist()) for k in (0, 1))
    return bool(one & two), int(sim[0] ^ sim[1]).bit_count()


def made_up(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))


def test_lines_of_edit_similarity_share_a_key():
    r = random.Random(5)
    for n in (4, 8, 15, 27, 45, 100):
        pairs = [(x, y) for x in (made_up(r, n) for _ in range(200)) for y in [edited(x, r)] if x != y]
        assert pairs and sum(meet(x, y)[0] for x, y in pairs) >= 0.8 * len(pairs), n


def test_lines_with_one_changed_word_are_candidates():
    r = random.Random(6)
    for n in (20, 27, 45, 100):
        met = 0
        for _ in range(200):
            words = made_up(r, n).split()
            other = words[:]
            other[r.randrange(n)] = "changed"
            key, bits = meet(" ".join(words), " ".join(other))
            met += key and bits <= op2_lines.DISTANCE
        assert met >= 180, (n, met)


def test_keys_of_lines_are_bounded():
    text = "word " * 100_000 + "\n" + " ".join(f"word{chr(97 + k % 26)}{k}" for k in range(60_000)) + "\na\n\nb c"
    _, _, _, _, (sim, bounds, keys), _, _ = op2_lines.lines_of([text])
    assert np.diff(bounds).tolist()[2] == 1 and np.diff(bounds).max() <= 2 * op2_lines.MOST_BLOCKS and len(sim) == 4
    assert len(keys) == bounds[-1]


def test_fingerprints_follow_the_contract(spark):
    rows = hard_rows()
    got = op5_spotsigs.fingerprints_with_edit(frame(spark, rows), rows_per_cell=3).collect()
    tie = {r.text: r.h for r in frame(spark, rows).selectExpr("coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS h").collect()}
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, tie[x[1]]))
    want = []
    for i, (d, t) in enumerate(ordered):
        after, cut = ordered[(i + 1) % len(ordered)][1], len(t) // 4
        want.append((str(d), len(t), hashlib.sha256((t[:len(t) - cut] + after[:cut]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert op5_spotsigs.fingerprints_with_edit(empty(spark)).count() == 0
    one = op5_spotsigs.fingerprints_with_edit(frame(spark, [(5, "only the text of one")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    sig = op5_spotsigs.signatures(["the cat sat on a mat by the river", ""])
    assert (op5_spotsigs.read(op5_spotsigs.written(sig[0])) == sig[0]).all() and not len(sig[1])


def test_similar_fingerprints_equal_brute_force(spark):
    base = [("the %s of " % w) + prose(k, 80).replace(" ", " the ", 20) for k, w in enumerate("abcdefgh")]
    rows = hard_rows() + [(50 + 10 * k + j, t.replace("the", "a", j)) for k, t in enumerate(base) for j in range(4)]
    least = {}
    for d, t in rows:
        sig = op5_spotsigs.signatures([t or ""])[0]
        if d is not None and len(sig):
            least[sig.tobytes()] = min(d, least.get(sig.tobytes(), d))
    ids = sorted((d, np.frombuffer(s, dtype=np.uint32)) for s, d in least.items())
    want = {(a, b) for i, (b, y) in enumerate(ids) for a, x in ids[:i] if op5_spotsigs.likeness(x, y) >= 0.8}
    got = {(r.a, r.b) for r in op5_spotsigs.similar_pairs(frame(spark, rows)).collect()}
    assert got == want and want


def test_similar_fingerprints_of_one_id_or_none_are_pairs(spark):
    text = "the a of " + prose(1, 80).replace(" ", " the ", 20)
    other = text.replace("the", "a", 1)
    for ids in ((7, 7), (None, 7), (None, None)):
        got = op5_spotsigs.similar_pairs(frame(spark, list(zip(ids, (text, other))), extra=False)).collect()
        assert [(r.a, r.b) for r in got] == [ids] and got[0].a_key != got[0].b_key


def test_decontamination_finds_leaks_and_new_parameters(spark):
    item = "A train leaves Boston at 9 and travels 120 km to meet another train that Alice drives for 3 hours before noon"
    rows = hard_rows() + [
        (30, "Intro words here. " + item + " trailing words"),
        (31, "Also: " + item.replace("120", "77").replace("Alice", "Bob").replace("9", "5").replace("3", "4")),
        (32, "Nothing in common with any of the items but a train that leaves at 9"),
        (33, item.lower()), (30, "Intro words here. " + item + " trailing words")]
    bench = spark.createDataFrame([(1, item), (2, "What is 2 plus 2"), (3, None), (None, ""), (1, item)], "item_id long, text string")
    got = op9_decontaminate.contaminated(frame(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(30, 1), (31, 1), (33, 1)}
    assert len(got) == 3
    assert op9_decontaminate.contaminated(empty(spark), bench).count() == 0
    assert op9_decontaminate.contaminated(frame(spark, rows), bench.limit(0)).count() == 0


def test_contradicting_slots_do_not_match(spark):
    item = "Carl has 3 apples and gives 3 apples to his good old friend so that 3 apples are left in the end"
    bad = item.replace("gives 3", "gives 8")
    good = item.replace("3", "8")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = op9_decontaminate.contaminated(frame(spark, [(1, "He said: " + good), (2, "He said: " + bad)], extra=False), bench)
    assert {r.doc_id for r in got.collect()} == {1}


def test_shuffled_benchmark_gives_the_same(spark, monkeypatch):
    item = prose(3, 40)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    monkeypatch.setattr(op9_decontaminate, "BROADCAST_WINDOWS", 0)
    assert op9_decontaminate.contaminated(frame(spark, [(1, "x " + item), (2, "y")]), bench).count() == 1


def test_short_and_numeric_items_are_found_in_longer_texts(spark):
    short, names, numbers = "Why is the sky blue today", "Alice saw the red fox", "12 + 7 = 19 and 3 x 4 = 12 and 15 - 6 = 9 and 8 / 2 = 4"
    bench = spark.createDataFrame([(1, short), (2, names), (3, numbers)], "item_id long, text string")
    around = "Some longer text with many words stands before, and %s and more words of the same text stand behind it"
    rows = [(1, around % short), (2, around % names), (3, around % numbers), (4, around % "nothing"), (5, short),
            (6, around % numbers.replace("19", "20").replace("12", "13").replace("9", "8").replace("3", "2"))]
    got = op9_decontaminate.contaminated(frame(spark, rows, extra=False), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 2), (3, 3), (5, 1)}
    assert all(r.coverage <= 1 for r in got)
