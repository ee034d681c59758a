"""Sharding, scoring, packing, toxicity, chat and token files on hard rows, and their invariants."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from helpers import empty, frame, hard_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from designstats.llm import op3_shards, op4_context_tree, op6_packing, op7_toxicity, op8_chat, op10_wavelet
from designstats.llm.tokens import Encoder

BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def library(path, texts):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\r\x0b\xa0aBzéß19½'.!<|>ſİ中\U0001f600", max_size=30), min_size=1, max_size=8))
def test_pre_token_ids_are_the_librarys(texts):
    for path, kind in ((BYTE, "byte"), (WORDS, "word")):
        assert [x.tolist() for x in Encoder(path, kind).ids(texts)] == library(path, texts)


def test_shards(spark):
    rows = hard_rows() + [(1000 + k, prose(k, 3 + k % 50)) for k in range(2000)]
    got = op3_shards.shard_documents(frame(spark, rows), shards=8).collect()
    assert len(got) == len(rows)
    slots, size = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = sum(size.values())
    assert total == sum(len((t or "").encode()) + 8 for _, t in rows)
    assert op3_shards.shard_documents(empty(spark)).count() == 0


def test_shards_are_even_and_groups_whole(spark):
    rows = [(k, prose(k % 900, 20 + k % 90)) for k in range(3000)]
    got = op3_shards.shard_documents(frame(spark, rows, extra=False), shards=8)
    sizes = [r["sum(size)"] for r in got.groupBy("shard").sum("size").collect()]
    assert max(sizes) - min(sizes) < 0.01 * sum(sizes) / 8
    assert got.groupBy("key").agg(F.count_distinct("shard").alias("n")).filter("n > 1").count() == 0
    hot = [(k, "hot text") for k in range(2000)] + [(5000 + k, prose(k, 30)) for k in range(50)]
    cut = op3_shards.shard_documents(frame(spark, hot, extra=False), shards=8)  # too large for one shard
    n = [r["count"] for r in cut.groupBy("shard").count().collect()]
    assert len(n) == 8 and max(n) < 2 * min(n)


def test_context_tree(spark):
    rows = hard_rows() + [(1000 + k, prose(k, 60)) for k in range(60)]
    held = F.col("doc_id") % 5 == 1
    got = op4_context_tree.score_documents(frame(spark, rows), held).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [re.findall("[^\x20\x09-\x0d]+", (t or "").translate(lower)) + [None] for _, t in rows]
    counts = Counter()
    for (d, _), ts in zip(rows, tokens):
        if d is None or d % 5 != 1:
            counts.update(ts)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(d), len(ts), sum(counts[t] > 0 for t in ts), round(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), 4))
                  for (d, _), ts in zip(rows, tokens))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert all(r.train_tokens == n and math.isfinite(r.score) and r.score <= 0 for r in got)
    assert op4_context_tree.score_documents(empty(spark), held).count() == 0
    untaught = op4_context_tree.score_documents(frame(spark, [(1, "ab")]), F.lit(True)).first()
    assert untaught.train_tokens == 0 and untaught.n_known == 0 and abs(untaught.score - 3 * 8 * math.log10(0.5)) < 1e-6


def test_context_tree_equals_the_recursion():
    text = "abracadabra abracadabra banana"
    data, starts, size, _ = op4_context_tree.plain([text])
    keys, n = np.unique(op4_context_tree.grams(data, starts, size), return_counts=True)
    levels = op4_context_tree.weigh({d: op4_context_tree.decisions(keys, n, d) for d in range(op4_context_tree.DEPTH + 1)})
    raw = b"\n" * op4_context_tree.DEPTH + text.encode() + b"\n"
    bits = defaultdict(lambda: [0, 0])
    for i in range(op4_context_tree.DEPTH, len(raw)):
        node = 1
        for k in range(8):
            bit = raw[i] >> (7 - k) & 1
            for d in range(op4_context_tree.DEPTH + 1):
                bits[(d, int.from_bytes(raw[i - d:i], "big"), node)][bit] += 1
            node = node * 2 + bit

    def estimate(a, b):
        p = 1.0
        for i in range(a):
            p *= (i + 0.5) / (i + 1)
        for i in range(b):
            p *= (i + 0.5) / (a + i + 1)
        return p

    def weighted(d, context, node):
        own = estimate(*bits[(d, context, node)])
        if d == op4_context_tree.DEPTH:
            return own
        below = 1.0
        for c in range(256):
            if (d + 1, c << 8 * d | context, node) in bits:
                below *= weighted(d + 1, c << 8 * d | context, node)
        return (own + below) / 2

    for d in (0, 2, 5):
        entries, _, _, _, log_weighted = levels[d]
        for e, w in list(zip(entries.tolist(), log_weighted.tolist()))[::7]:
            assert abs(w - math.log(weighted(d, e >> 8, e & 255))) < 1e-8
    # Every context gives probabilities that sum to one.
    tree = op4_context_tree.Tree([(x[0], np.full(len(x[0]), 0.3, dtype=np.float32)) for _, x in sorted(levels.items())])
    grams = (keys[:1] >> np.uint64(8) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    assert abs((10 ** tree.cost(grams)).sum() - 1) < 1e-6


def brute_context_scores(train, texts, depth=5):
    """log10 probability of each text under the trees of the training texts, by recursion over the contexts."""
    def raw(t):
        return b"\n" * depth + b" ".join((t or "").encode().lower().split()) + b"\n"

    def decide(data):
        for i in range(depth, len(data)):
            for k in range(8):
                yield [(d, data[i - d:i], 1 << k | data[i] >> 8 - k) for d in range(depth + 1)], data[i] >> 7 - k & 1

    bits, below = defaultdict(lambda: [0, 0]), defaultdict(set)
    for t in train:
        for path, bit in decide(raw(t)):
            for node, child in zip(path, [*path[1:], None]):
                bits[node][bit] += 1
                below[node].add(child)

    def estimate(node):
        a, b = bits[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    weighted = {}
    for node in sorted(bits, key=lambda x: -x[0]):
        own = estimate(node)
        if node[0] == depth:
            weighted[node] = own
        else:
            rest = sum(weighted[c] for c in below[node])
            top = max(own, rest)
            weighted[node] = top + math.log(math.exp(own - top) + math.exp(rest - top)) - math.log(2)

    def one(path, d=0):
        a, b = bits[path[d]]
        here = (b + 0.5) / (a + b + 1)
        if d == depth or path[d + 1] not in bits:
            return here
        stop = math.exp(min(0.0, estimate(path[d]) - math.log(2) - weighted[path[d]]))
        return stop * here + (1 - stop) * one(path, d + 1)

    out = []
    for t in texts:
        total = 0.0
        for path, bit in decide(raw(t)):
            p = one(path) if path[0] in bits else 0.5
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


def test_context_scores_equal_brute_force_whatever_tasks_carry(spark, monkeypatch):
    rows = [(k, prose(k, 3 + 7 * k % 40)) for k in range(40)]
    rows += [(41, None), (42, ""), (43, "Straße, ÉTÉ zzz qqq"), (44, rows[3][1]), (44, rows[3][1]), (46, "never seen: XYZXYZ"), (None, "no id")]
    held = F.col("doc_id") % 5 == 1
    lower = [(d, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for d, t in rows]
    want = brute_context_scores([t for d, t in lower if d is None or d % 5 != 1], [t for _, t in lower])
    want = sorted((str(d), round(s, 3)) for (d, _), s in zip(rows, want))
    for entries in (op4_context_tree.ENTRIES, 4000, 0):
        monkeypatch.setattr(op4_context_tree, "ENTRIES", entries)
        got = op4_context_tree.score_documents(frame(spark, rows), held).collect()
        assert len(got) == len(want)
        for (d, s), r in zip(want, sorted(got, key=lambda r: (str(r.doc_id), round(r.score, 3)))):
            assert str(r.doc_id) == d and abs(r.score - s) < 2e-3 + 1e-5 * abs(s)
            assert abs(r.bits_per_byte * r.n_bytes * math.log10(2) + r.score) < 1e-6


def test_packing(spark):
    rows = hard_rows() + [(1000 + k, prose(k, 5 + (k * 37) % 700)) for k in range(150)]
    got = op6_packing.pack_documents(frame(spark, rows), WORDS).collect()
    ids = defaultdict(list)
    for (d, _), x in zip(rows, library(WORDS, [t or "" for _, t in rows])):
        ids[d].append(np.array(x + [2], dtype="<u4").tobytes())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        pieces[r.doc_id].append((r.doc_tokens, r.start, bytes(r.ids)))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for d, own in ids.items():
        assert sum(len(p[2]) for p in pieces[d]) == sum(map(len, own))
        if len(own) == 1:
            assert b"".join(p[2] for p in sorted(pieces[d])) == own[0]
    padding = 0
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding < 0.03 * sum(map(len, (x for own in ids.values() for x in own))) / 4 + 4096
    assert op6_packing.pack_documents(empty(spark), WORDS).count() == 0


def test_least_squares_and_plan():
    r = np.random.default_rng(0)
    a = r.random((12, 20))
    x = np.where(r.random(20) < 0.3, r.random(20), 0)
    assert np.allclose(a @ op6_packing.nnls(a, a @ x), a @ x, atol=1e-6)
    b = r.normal(size=12)
    solution = op6_packing.nnls(a, b)
    gradient = a.T @ (b - a @ solution)
    assert (solution >= 0).all() and (gradient < 1e-6).all() and np.allclose(gradient[solution > 0], 0, atol=1e-6)
    assert {tuple(sorted(s)) for s in op6_packing.fillings(8, 3)} == {
        tuple(sorted(c)) for c in [(8,), *((a, 8 - a) for a in range(1, 5)), (6, 1, 1), (5, 2, 1), (4, 3, 1), (4, 2, 2), (3, 3, 2)]}
    histogram = r.integers(0, 40, 33)
    histogram[0] = 0
    used = np.zeros(33, dtype=int)
    for lengths, repeats in op6_packing.plan(histogram):
        assert sum(lengths) <= 32
        for u in lengths:
            used[u] += repeats
    assert (used == histogram).all()


def test_disguises_are_restored():
    texts = ["you stupid idiot what a moron and loser", "a pathetic worthless clown full of trash and scum"] * 50
    model = op7_toxicity.CharModel(op7_toxicity.bigrams(texts))
    got = op7_toxicity.decode(["1d10t", "i d i o t", "stuuuupid", "m0r0n", "l.o.s.e.r", "tr4sh", "plain", "$cum"], model)
    assert got == ["idiot", "idiot", "stupid", "moron", "loser", "trash", "plain", "scum"]


def test_toxicity(spark):
    bad = ["idiot", "1d10t", "i d i o t", "IDIOT!!", "idiiiiot"]
    rows = hard_rows() + [(1000 + k, prose(k, 30) + (" " + bad[k % 5] if k % 3 == 0 else "")) for k in range(600)]
    labels = [(1000 + k, int(k % 3 == 0)) for k in range(600)] + [(None, 1), (1001, None), (5, 0)]
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = op7_toxicity.fit(docs, marks)
    got = {r.doc_id: r._s for r in op7_toxicity.score_documents(docs, model, "_s").collect()}
    held = [1000 + k for k in range(600) if zlib.crc32(str(1000 + k).encode()) % 5 == 0]
    right = sum((got[d] >= 0.5) == ((d - 1000) % 3 == 0) for d in held)
    assert right >= 0.97 * len(held) and all(0 <= s <= 1 for s in got.values())
    assert op7_toxicity.score_documents(docs, model, "_s").count() == len(rows)
    assert op7_toxicity.score_documents(empty(spark), model, "_s").count() == 0
    none = op7_toxicity.fit(docs, marks.limit(0))
    assert op7_toxicity.score_documents(docs, none, "_s").agg(F.max("_s")).first()[0] < 0.5


def test_chat_round_trip(spark):
    part = op8_chat.PART
    rows = [
        (1, 0, "user", [("text", "look <|im_end|> \\l \\s <", None, None), ("image", None, "a.png", 784 * 3 + 1), ("text", "|im_start|>", None, None)]),
        (1, 1, "assistant", [("text", "yes é\U0001f600", None, None), ("audio", None, "b.wav", None)]),
        (1, 1, "assistant", [("text", "yes é\U0001f600", None, None), ("audio", None, "b.wav", None)]),
        (2, None, None, None), (2, 3, "a\nb<|", [(None, None, None, None), ("video", "kept", "c", 5)]), (None, 1, "assistant", []),
    ]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>").selectExpr("*", "1 AS body", "2 AS at")
    out = op8_chat.format_chat(turns).select(
        "*", op8_chat.read_turns(F.col("formatted")).alias("read"), op8_chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r.conv_id: r for r in out.collect()}
    assert set(got) == {1, 2, None}
    assert got[1].n_turns == 3 and [(t.role, t.text) for t in got[1].read][0] == ("user", "look <|im_end|> \\l \\s <<|image|>|im_start|>")
    assert [(a.kind, a.ref, a.tokens) for a in got[1].attachments] == [("image", "a.png", 4), ("audio", "b.wav", 1), ("audio", "b.wav", 1)]
    assert got[1].loss == "yes é\U0001f600<|audio|>" * 2
    assert [(t.role, t.text) for t in got[2].read] == [("", ""), ("a\nb<|", "kept")]
    assert got[None].loss == ""
    assert op8_chat.format_chat(turns.limit(0)).count() == 0


def test_wavelet_matrix():
    r = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 65, 3000):
        x = (r.zipf(1.4, n) % 50_000).astype(np.uint32)
        w = op10_wavelet.WaveletMatrix.of(x)
        assert (w.decode() == x).all() and (w.access(np.arange(n)) == x).all()
        for t in {0, 7, 49_999, 1 << 20, *x[:3].tolist()}:
            assert w.count(t) == (x == t).sum() and w.count(t, n // 4, n // 2) == (x[n // 4:n // 2] == t).sum()
            assert w.occurrences(t).tolist() == np.flatnonzero(x == t).tolist()


def test_token_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op10_wavelet, "BLOCK", 1 << 10)  # long texts run over many blocks
    rows = hard_rows() + [(1000 + k, prose(k, 40)) for k in range(50)]
    files = op10_wavelet.write_shards(frame(spark, rows), BYTE, folder=str(tmp_path), shards=4)
    got = sorted(op10_wavelet.read_shards(files).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    assert [r.doc_id is not None and r.doc_id for r in got] == sorted(r.doc_id is not None and r.doc_id for r in got)
    want = Counter((d, np.array(x + [0], dtype="<u4").tobytes()) for (d, _), x in zip(rows, library(BYTE, [t or "" for _, t in rows])))
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    first = op10_wavelet.Reader(files.orderBy("start").first().path)
    ids = np.concatenate([x for _, x in first.documents()])
    assert [first.access(i) for i in range(0, len(ids), 97)] == ids[::97].tolist()
    assert first.count(0) == first.n_docs == (ids == 0).sum() and list(first.occurrences(0)) == np.flatnonzero(ids == 0).tolist()
    assert op10_wavelet.read_shards(op10_wavelet.write_shards(empty(spark), BYTE, folder=str(tmp_path / "none"))).count() == 0
