"""Near duplicates by signatures, hard negatives and ranked search, each against a plain version."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import empty, frame, hard_rows, prose

from designstats.llm import op11_hamming, op12_negatives, op13_masks

LOWER = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def pair_set(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(w)


def components(rows):
    """(doc_id, n_shingles, component_id, kept) by comparing all rows."""
    sets = [pair_set(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and both:
                group[root(i)] = root(j)
    least = defaultdict(set)
    for i, (d, _) in enumerate(rows):
        least[root(i)].add(d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = min((x for x in least[root(i)] if x is not None), default=None)
        out.append((d, len(sets[i]), c, d is not None and d == c))
    return Counter(out)


def found(df):
    return Counter(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()))


def edited(r, words, share):
    out = list(words)
    for k in r.sample(range(len(out)), int(len(out) * share)):
        out[k] = f"new{r.randint(0, 10**6)}"
    return " ".join(out)


def copies(seed=5):
    """Near copies in chains, a passage that many share, short texts and texts of one word."""
    r, rows = random.Random(seed), []
    for g in range(12):
        words = prose(100 + g, r.choice([4, 9, 30, 80, 300])).split()
        for share in (0, 0.02, 0.05, 0.08, 0.1, 0.15):
            rows.append((len(rows), edited(r, words, share)))
    passage = prose(7, 60)
    rows += [(1000 + k, passage + " " + prose(2000 + k, r.randint(1, 60))) for k in range(40)]
    rows += [(2000 + k, w) for k, w in enumerate(("same", "SAME", "other", "same same", "same same same", " ", "x\u0085y", ""))]
    return rows


def test_hamming_components_equal_all_pairs(spark):
    for rows in (hard_rows(), copies()):
        assert found(op11_hamming.near_duplicates(frame(spark, rows))) == components(rows)
    assert op11_hamming.near_duplicates(empty(spark)).count() == 0


def test_hamming_large_keys_go_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(op11_hamming, "BLOCK", 8)
    rows = copies(9)
    assert found(op11_hamming.near_duplicates(frame(spark, rows))) == components(rows)


def test_hamming_group_of_copies_is_a_star(spark):
    r, words = random.Random(3), prose(11, 200).split()
    rows = [(k, edited(r, words, 0.01)) for k in range(1500)]
    out = op11_hamming.near_duplicates(frame(spark, rows, extra=False))
    assert {(x["component_id"], x["kept"]) for x in out.filter("doc_id > 0").collect()} == {(0, False)}


def test_hamming_finds_all_pairs_within_the_guarantee():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 16, (2000, op11_hamming.POSITIONS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = r.choice(op11_hamming.POSITIONS, op11_hamming.GUARANTEED, replace=False)
        row[at] ^= r.integers(1, 1 << 16, len(at)).astype(np.uint16)
    assert (op11_hamming.chunk_keys(a) == op11_hamming.chunk_keys(b)).any(axis=1).all()


def test_hamming_tells_long_words_apart(spark):
    morse = [0]
    for _ in range(11):
        morse += [1 - x for x in morse]
    one = "".join("ab"[x] for x in morse)
    rows = [(1, one), (2, one.translate(str.maketrans("ab", "ba"))), (3, one)]
    assert found(op11_hamming.near_duplicates(frame(spark, rows))) == components(rows)


def mined(rows, every=100):
    """Hard negatives by sorting all scores."""
    keep = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, la, va in keep:
        if a % every:
            continue
        by = sorted(((sum(x * y for x, y in zip(va, v)), i, lab) for i, lab, v in keep), key=lambda x: (-x[0], x[1]))
        for p, pid, _ in [x for x in by if x[2] == la and x[1] != a][:5]:
            for rank, (s, n, _) in enumerate([x for x in by if x[2] != la and 80 * p <= 100 * x[0] <= 100 * p][:5], 1):
                out.append((a, pid, rank, n, p, s))
    return Counter(out)


VECTORS = "vec_id long, label int, embedding array<float>"


def vector_rows(n, seed=1, dims=12):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.3) for _ in range(dims)] for _ in range(5)]
    rows = [(i, r.randint(0, 3), [float(np.float32(c + r.gauss(0, 0.1))) for c in r.choice(centres)]) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    rows += [(None, 1, [0.1] * dims), (900_000, None, [0.1] * dims), (900_100, 1, None), (900_200, 1, [nan] + [0.1] * (dims - 1)),
             (900_300, 1, [inf] * dims), (900_400, 1, [None] * dims), (900_500, 2, [0.0] * dims), (900_600, 2, []), (900_700, 1, [0.5])]
    return rows + [(k, 2, rows[0][2]) for k in range(n, n + 30)]  # copies of one vector: ties


def test_negatives_equal_sorting_all_scores(spark, monkeypatch):
    for block in (op12_negatives.BLOCK, 24):
        monkeypatch.setattr(op12_negatives, "BLOCK", block)
        rows = vector_rows(400)
        df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "'x' AS score", "'x' AS rank", "'x' AS v").repartition(3)
        assert Counter(map(tuple, op12_negatives.hard_negatives(df).collect())) == mined(rows)


def test_negatives_of_few_or_no_rows(spark):
    assert op12_negatives.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0
    assert op12_negatives.hard_negatives(spark.createDataFrame([(1, 1, [0.5])], VECTORS)).count() == 0
    rows = [(100, 1, [1.0, 0.0]), (1, 1, [0.5, 0.5]), (2, 3, [0.45, 0.0]), (3, 1, [-1.0, 0.0]), (4, 2, [-0.9, 0.0])]
    assert Counter(map(tuple, op12_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS)).collect())) == mined(rows)


def test_posting_lists_leave_out_only_what_cannot_reach():
    r = np.random.default_rng(2)
    anchors, rows = np.floor(r.normal(0, 40, (30, 16))), np.floor(r.normal(0, 40, (200, 16)))
    scores = anchors @ rows.T
    for least in (2000.0, 12000.0, 30000.0):
        a, b, s = op12_negatives.reaching(anchors, np.full(30, least), rows)
        assert set(zip(a.tolist(), b.tolist(), s.tolist())) == {(i, j, int(scores[i, j])) for i, j in zip(*np.nonzero(scores >= least))}
    norms = np.sqrt((rows ** 2).sum(axis=1)).max()
    lists, _, _ = op12_negatives.posting_lists(anchors, np.full(30, 12000.0), norms)
    assert sum(map(len, lists)) < anchors.size  # a high threshold leaves dimensions out


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def ranked(docs, items, top=20):
    cut = lambda t: TERM.findall((t or "").translate(LOWER))
    docs = [(d, Counter(w), len(w)) for d, t in docs if (w := cut(t))]
    n, total = len(docs), sum(x[2] for x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for d, c, size in docs:
            m = 75 + 25 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in cut(text) if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out.update((item, k, x[3], -x[0]) for k, x in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_scoring_all(spark, monkeypatch, small):
    if small:  # several blocks of items, lots of documents and evaluations for each item
        for name, value in (("BLOCK", 300), ("LOT", (50, 4)), ("SCORED", 2)):
            monkeypatch.setattr(op13_masks, name, value)
    docs = hard_rows() + [(100 + k, prose(k, 5 + k)) for k in range(60)] + [(50, "Café café-CAFE_x"), (51, "one one TWO")]
    wide = " ".join(prose(k, 40) for k in range(8))  # more than 64 terms
    items = [(1, "alpha1 beta2 alpha1 gamma3"), (2, None), (3, ""), (4, "..."), (5, wide), (6, "café CAFE"), (6, "one two"), (None, "one"), (7, prose(1, 200))]
    out = op13_masks.ranked_search(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS score"))
    assert Counter(map(tuple, out.collect())) == ranked(docs, items)


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert op13_masks.ranked_search(empty(spark), items).count() == 0
    assert op13_masks.ranked_search(frame(spark), items.filter("false")).count() == 0
    assert op13_masks.ranked_search(frame(spark, [(1, None), (2, "...")]), items).count() == 0
