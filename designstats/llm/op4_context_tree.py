"""Scoring by context-tree weighting over bytes.

A text is scored as its words in lower case (A-Z), joined by one blank and ended by a line end. Every byte is
eight binary decisions. Each decision has a tree of contexts: the 0 to ``DEPTH`` bytes before the byte. A node
keeps a Krichevsky-Trofimov estimate of its bits, and its weighted probability is the mean of its own
estimate and the product over its children. So the prediction mixes the estimates of all depths. After training
the counts stand still; a text's code length is read off, and contexts never seen in training end the path.

Training counts every (DEPTH + 1)-gram of the training texts. Subtrees below the last two bytes are weighted in
groups of their own; what is above them is bounded by the alphabet. The scorer carries the mixed prediction of
each decision in each context that was seen at least t times; t is the least count for which the table has
at most ``ENTRIES`` rows, which bounds what a task holds. It is a cache: a gram whose longest context is not in it
leaves the task with its number of times in the document, and the distinct ones of these grams are settled
against the whole stored tree. So a text's score depends on the training texts alone, not on ``ENTRIES``.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from designstats.llm.arrays import slices, spans_of, word_spans
from designstats.llm.common import fold, parts_of, stored
from designstats.llm.graph import int64s

DEPTH = 5
ENTRIES = 3_000_000
#: Distinct keys that a counting task holds before it gives them away.
HELD = 1 << 21
#: Grams in a group of subtrees, about.
GROUP = 1 << 16
#: Words whose counts every task holds; the counts of all others are joined.
FREQUENT = 1 << 17
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SIGN = np.ones(256, dtype=bool)
_SIGN[[9, 10, 11, 12, 13, 32]] = False


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift; for x >= 0.5."""
    x = np.asarray(x, dtype=float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] -= np.log(y[low])
        y[low] += 1
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)


def kt_log(a, b):
    """Log probability that the estimator gives to a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)


def plain(texts: list[str]):
    """Bytes of the texts as scored, each behind DEPTH line ends; where each begins; their word hashes; words of each.

    Also the number of scored bytes of each text.
    """
    raw = [t.encode("utf-8", "replace") for t in texts]
    words = [r.split() for r in raw]  # bytes know just the six white-space characters of ASCII
    pad = b"\n" * DEPTH
    own = [pad + b" ".join(w) + b"\n" for w in words]
    size = np.array([len(x) for x in own], dtype=np.int64)
    data = _LOWER[np.frombuffer(b"".join(own) or b"\n", dtype=np.uint8)]
    return data, np.cumsum(size) - size, size - DEPTH, np.array([len(w) for w in words], dtype=np.int64)


def word_hashes(data: np.ndarray) -> np.ndarray:
    begin, end, _ = word_spans(data, np.zeros(1, dtype=np.int64), _SIGN)
    return spans_of(data, begin, end)


def grams(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(DEPTH + 1)-gram that ends at every scored byte, as one number, oldest byte first."""
    wide = data.astype(np.uint64)
    key = np.zeros(max(0, len(data) - DEPTH), dtype=np.uint64)
    for k in range(DEPTH + 1):
        key = key << np.uint64(8) | wide[k:k + len(key)]
    at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return key[at]


class Counter:
    """Counts of 64-bit keys, merged by sorting."""

    def __init__(self):
        self.keys, self.counts, self.new = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), []

    def add(self, keys):
        self.new.append(np.unique(keys, return_counts=True))
        if sum(len(k) for k, _ in self.new) > 1 << 20:
            self.merge()

    def merge(self):
        if self.new:
            keys = np.concatenate([self.keys, *(k for k, _ in self.new)])
            counts = np.concatenate([self.counts, *(c for _, c in self.new)])
            self.keys, at = np.unique(keys, return_inverse=True)
            self.counts, self.new = np.bincount(at, weights=counts, minlength=len(self.keys)).astype(np.int64), []
        return len(self.keys)

    def take(self, kind: int):
        self.merge()
        for lo in range(0, len(self.keys), 1 << 16):
            k = self.keys[lo:lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(k), kind, dtype=np.int32)), int64s(k), pa.array(self.counts[lo:lo + (1 << 16)])], names=["kind", "key", "n"])
        self.__init__()


GRAM, WORD = 0, 1


def corpus_counts(texts: DataFrame) -> DataFrame:
    """(kind, key, n): counts of all grams and of all words of the texts."""
    def run(batches):
        gram, word = Counter(), Counter()
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in slices(texts):
                data, starts, size, _ = plain(texts[lo:hi])
                gram.add(grams(data, starts, size))
                word.add(word_hashes(data))
                for kind, counter in ((GRAM, gram), (WORD, word)):
                    if len(counter.keys) > HELD:
                        yield from counter.take(kind)
        yield from gram.take(GRAM)
        yield from word.take(WORD)

    return texts.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def decisions(key: np.ndarray, n: np.ndarray, depth: int):
    """Entries (context of ``depth`` bytes, decision) as one number, with their zeros and ones."""
    context = key >> np.uint64(8) & np.uint64((1 << 8 * depth) - 1)
    symbol = key & np.uint64(255)
    entry, weight = [], []
    for k in range(8):
        node = np.uint64(1 << k) | symbol >> np.uint64(8 - k)
        entry.append((context << np.uint64(8) | node) << np.uint64(1) | symbol >> np.uint64(7 - k) & np.uint64(1))
        weight.append(n)
    both, at = np.unique(np.concatenate(entry), return_inverse=True)
    count = np.bincount(at, weights=np.concatenate(weight), minlength=len(both))
    entries, at = np.unique(both >> np.uint64(1), return_inverse=True)
    ones = np.bincount(at, weights=count * (both & np.uint64(1)), minlength=len(entries))
    return entries, np.bincount(at, weights=count, minlength=len(entries)) - ones, ones


def parents(entries: np.ndarray, above: np.ndarray, depth: int) -> np.ndarray:
    """Where the entries' parents (one byte of context less) stand in ``above``."""
    return np.searchsorted(above, entries & np.uint64((1 << 8 * depth) - 1))


def weigh(levels: dict[int, tuple], below: np.ndarray | None = None):
    """Adds the log weighted probability to each level, deepest first: {depth: (entries, zeros, ones, own, weighted)}.

    below: the log weighted probabilities of the deepest level, where that one has children of its own.
    """
    deepest, out = max(levels), {}
    for d in sorted(levels, reverse=True):
        entries, zeros, ones = levels[d]
        own = kt_log(zeros, ones)
        if d == deepest:
            weighted = own if below is None else below
        else:
            under = out[d + 1]
            children = np.bincount(parents(under[0], entries, d + 1), weights=under[4], minlength=len(entries))
            weighted = np.logaddexp(own, children) - np.log(2)
        out[d] = (entries, zeros, ones, own, weighted)
    return out


def mixed(level, ahead: np.ndarray, rest: np.ndarray, last: bool):
    """Mixed prediction of a one if the path ends here; what the path carries on: sum so far and weight left."""
    _, zeros, ones, own, weighted = level
    one = (ones + 0.5) / (zeros + ones + 1.0)
    here = ahead + rest * one
    stop = np.ones(len(one)) if last else np.exp(np.minimum(own - np.log(2) - weighted, 0.0))
    return here, ahead + rest * stop * one, rest * (1 - stop)


class Tree:
    """Predictions by (depth, entry), sorted; ``whole`` unless rarer contexts were left out."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]], whole: bool = True):
        self.tables, self.whole = tables, whole

    def settled(self, keys: np.ndarray) -> np.ndarray:
        """Which grams have their longest context here; then all shorter ones, seen as often or more, are here too."""
        entries = self.tables[-1][0] if self.tables else []
        if self.whole or not len(entries):
            return np.full(len(keys), self.whole)
        want = keys >> np.uint64(8) << np.uint64(8) | np.uint64(1)
        return entries[np.minimum(np.searchsorted(entries, want), len(entries) - 1)] == want

    def cost(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of every gram, given those before it; not a number if not settled."""
        out, own = np.full(len(keys), np.nan), self.settled(keys)
        out[own] = self._cost(keys[own])
        return out

    def _cost(self, keys: np.ndarray) -> np.ndarray:
        total, symbol, context = np.zeros(len(keys)), keys & np.uint64(255), keys >> np.uint64(8)
        for k in range(8):
            node = np.uint64(1 << k) | symbol >> np.uint64(8 - k)
            bit = (symbol >> np.uint64(7 - k) & np.uint64(1)).astype(bool)
            one, open_ = np.full(len(keys), 0.5), np.arange(len(keys))
            for d in reversed(range(len(self.tables))):
                entries, value = self.tables[d]
                if not len(open_) or not len(entries):
                    continue
                want = (context[open_] & np.uint64((1 << 8 * d) - 1)) << np.uint64(8) | node[open_]
                at = np.minimum(np.searchsorted(entries, want), len(entries) - 1)
                hit = entries[at] == want
                one[open_[hit]] = value[at[hit]]
                open_ = open_[~hit]
            total += np.log10(np.where(bit, one, 1 - one))
        return total


def fit(counts: DataFrame) -> tuple[Tree, Callable[[DataFrame], DataFrame]]:
    """The tree from (key, n) of all grams of the training texts: what tasks carry, and how to settle other grams.

    The second is a function from a table of distinct grams (key) to their costs (key, cost).
    """
    parts = parts_of(counts.count(), GROUP)
    rows = counts.withColumn("group", fold(F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF)), parts))

    def subtree(table):
        key, n = table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy()
        return weigh({d: decisions(key, n, d) for d in range(2, DEPTH + 1)})

    def tops(table):
        entries, zeros, ones, _, weighted = subtree(table)[2]
        return pa.table({"entry": int64s(entries), "zeros": zeros, "ones": ones, "weighted": weighted})

    # At most 256 ** 2 contexts of two bytes with 255 decisions each.
    top = rows.groupBy("group").applyInArrow(tops, "entry long, zeros double, ones double, weighted double").orderBy("entry").toArrow()
    if not top.num_rows:
        return Tree([]), None
    entry = top.column("entry").to_numpy().view(np.uint64)
    two = (entry, top.column("zeros").to_numpy(), top.column("ones").to_numpy())
    levels = {2: two}
    for d in (1, 0):
        entries, at = np.unique(levels[d + 1][0] & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
        levels[d] = (entries, *(np.bincount(at, weights=x, minlength=len(entries)) for x in levels[d + 1][1:3]))
    levels = weigh(levels, top.column("weighted").to_numpy())
    path = {0: (np.zeros(len(levels[0][0])), np.ones(len(levels[0][0])))}
    upper = []
    for d in (0, 1):
        here, ahead, rest = mixed(levels[d], *path[d], last=False)
        upper.append((levels[d][0], here.astype(np.float32)))
        at = parents(levels[d + 1][0], levels[d][0], d + 1)
        path[d + 1] = (ahead[at], rest[at])
    second, carried = levels[2][0], np.column_stack(path[2])

    def predictions(table):
        own = subtree(table)
        at = np.searchsorted(second, own[2][0])
        ahead, rest = carried[at, 0], carried[at, 1]
        out = []
        for d in range(2, DEPTH + 1):
            here, ahead, rest = mixed(own[d], ahead, rest, last=d == DEPTH)
            entries = own[d][0]
            # Every decision of a context goes with the context: its count is that of the first decision.
            root = np.searchsorted(entries, (entries >> np.uint64(8) << np.uint64(8)) | np.uint64(1))
            out.append(pa.table({"depth": np.full(len(entries), d, dtype=np.int32), "entry": int64s(entries), "one": here.astype(np.float32),
                                 "seen": (own[d][1] + own[d][2])[root].astype(np.int64)}))
            if d < DEPTH:
                to = parents(own[d + 1][0], entries, d + 1)
                ahead, rest = ahead[to], rest[to]
        return pa.concat_tables(out)

    full = stored(rows.groupBy("group").applyInArrow(predictions, "depth int, entry long, one float, seen long"), "tree")
    # Histogram of the entries by the log2 of their context's count, in steps of a quarter; a few hundred rows.
    step = F.floor(4 * F.log2(F.col("seen").cast("double"))).cast("int")
    room, least = ENTRIES, 0
    for r in full.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        room -= r["count"]
        if room < 0:
            least = r["step"] + 1
            break
    kept = full.filter(step >= least).select("depth", "entry", "one").toArrow()  # at most ENTRIES rows

    def settle(keys: DataFrame) -> DataFrame:
        def costs(asked, known):
            key = asked.column("key").to_numpy().view(np.uint64)
            return pa.table({"key": int64s(key), "cost": Tree(upper + by_depth(known)).cost(key)})

        two_bytes = F.shiftright("entry", 8).bitwiseAND(F.lit(0xFFFF))
        # Longest contexts that tasks carry are those of settled grams: nobody asks for them.
        known = full.filter((F.col("depth") < DEPTH) | (step < least)).select("depth", "entry", "one", fold(two_bytes, parts).alias("group"))
        asked = keys.withColumn("group", fold(F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF)), parts))
        return asked.groupBy("group").cogroup(known.groupBy("group")).applyInArrow(costs, "key long, cost double")

    return Tree(upper + by_depth(kept), whole=room >= 0), settle


def by_depth(rows: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted entries and predictions of each depth from 2 on."""
    depth, entry, one = (rows.column(k).to_numpy() for k in ("depth", "entry", "one"))
    out = []
    for d in range(2, DEPTH + 1):
        own = np.flatnonzero(depth == d)
        own = own[np.argsort(entry[own].view(np.uint64))]
        out.append((entry[own].view(np.uint64), one[own]))
    return out


def score_documents(docs: DataFrame, held_out) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    n_bytes counts the scored bytes (with the line end); bits_per_byte is the code length of the text over them.

    held_out is a condition on docs: those rows teach nothing. Null texts are empty (one token, the end);
    a null id is kept; repeated rows count and score again; without training texts every decision is 1/2.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = stored(corpus_counts(rows.filter("not held_out").select("text")), "counts")
    tree, settle = fit(counts.filter(F.col("kind") == GRAM).select("key", "n"))
    words = counts.filter(F.col("kind") == WORD).select("key", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_docs = rows.filter("not held_out").count()  # one end each
    n_train, kinds = total[0] + n_docs, total[1] + (1 if n_docs else 0)
    common = words.orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    order = np.argsort(common.column("key").to_numpy().view(np.uint64))
    known = common.column("key").to_numpy().view(np.uint64)[order]
    known_n = common.column("n").to_numpy()[order]
    shared = spark.sparkContext.broadcast((tree.tables, tree.whole, known, known_n))  # arrays only: workers need not have this package
    base = np.log10(n_train + 0.5 * (kinds + 1))

    def run(batches):
        tables, whole, known, known_n = shared.value
        tree = Tree(tables, whole)
        task, number = TaskContext.get().partitionId(), 0
        seen, cost = np.zeros(0, dtype=np.uint64), np.zeros(0)
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in slices(texts, 1 << 21):
                data, starts, size, n_words = plain(texts[lo:hi])
                key, at = np.unique(grams(data, starts, size), return_inverse=True)
                own, fresh = np.full(len(key), np.nan), np.ones(len(key), dtype=bool)
                if len(seen):
                    spot = np.minimum(np.searchsorted(seen, key), len(seen) - 1)
                    old = seen[spot] == key
                    own[old], fresh = cost[spot[old]], ~old
                own[fresh] = tree.cost(key[fresh])
                if len(seen) + fresh.sum() > HELD:
                    seen, cost = key, own
                else:
                    seen, cost = np.concatenate([seen, key[fresh]]), np.concatenate([cost, own[fresh]])
                    order = np.argsort(seen, kind="stable")
                    seen, cost = seen[order], cost[order]
                score = np.add.reduceat(np.nan_to_num(own)[at], np.cumsum(size) - size)
                left = np.flatnonzero(np.isnan(own)[at])
                left, times = np.unique(np.repeat(np.arange(hi - lo), size)[left] * len(key) + at[left], return_counts=True)
                left_to = np.searchsorted(left, np.arange(hi - lo + 1) * len(key)).astype(np.int32)
                word = word_hashes(data)
                text = np.repeat(np.arange(hi - lo), n_words)
                spot = np.minimum(np.searchsorted(known, word), max(0, len(known) - 1))
                hit = known[spot] == word if len(known) else np.zeros(len(word), dtype=bool)
                part = np.bincount(text[hit], weights=np.log10(known_n[spot[hit]] + 0.5), minlength=hi - lo)
                n_hit = np.bincount(text[hit], minlength=hi - lo)
                rest, rest_of = word[~hit], text[~hit]
                offsets = np.searchsorted(rest_of, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array((task << 40) + number + np.arange(hi - lo)), b.column("doc_id").slice(lo, hi - lo), b.column("held_out").slice(lo, hi - lo),
                    pa.array(n_words + 1, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(part.astype(float)), pa.array(score), pa.array(size),
                    pa.ListArray.from_arrays(pa.array(offsets), int64s(rest)),
                    pa.ListArray.from_arrays(pa.array(left_to), int64s(key[left % len(key)])),
                    pa.ListArray.from_arrays(pa.array(left_to), pa.array(times.astype(np.int32)))],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_hit", "part", "score", "n_bytes", "rest", "gram", "times"])
                number += hi - lo

    scored = stored(rows.mapInArrow(
        run, "row long, doc_id long, held_out boolean, n_tokens long, n_hit long, part double, score double, n_bytes long, "
             "rest array<long>, gram array<long>, times array<int>"), "scored")
    rare = scored.select("row", F.explode("rest").alias("key")).join(words, "key", "left")
    rare = rare.groupBy("row").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.count("n").alias("n_more"))
    out = scored.drop("rest", "gram", "times").join(rare, "row", "left")
    score = F.col("score")
    if not tree.whole:
        asked = scored.select("row", F.explode(F.arrays_zip("gram", "times")).alias("a")).select("row", F.col("a.gram").alias("key"), "a.times")
        costs = stored(settle(asked.select("key").distinct()), "costs")
        left = asked.join(costs, "key").groupBy("row").agg(F.sum(F.col("cost") * F.col("times")).alias("left"))
        out, score = out.join(left, "row", "left"), F.col("score") + F.coalesce("left", F.lit(0.0))
    bits = -score / float(np.log10(2)) / F.col("n_bytes")
    end = float(np.log10(n_docs + 0.5))
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_hit") + F.coalesce("n_more", F.lit(0)) + (1 if n_docs else 0)).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("more", F.lit(0.0)) + end - F.col("n_tokens") * float(base)).alias("base_score"),
        score.alias("score"), "n_bytes", bits.alias("bits_per_byte"))
