"""Toxicity through a noisy channel: disguised words are restored, then the text is scored.

Chunks that look disguised (signs or digits among letters, letters spelled apart, letters repeated) become
lattices: every character may stand for the letters it imitates, for itself, or for nothing. Viterbi decoding
under a character bigram model picks the likeliest reading. A chunk of plain letters has one
path only and needs no decoding. Whole words and word beginnings of the text and of its restored chunks, hashed
into ``BUCKETS``, are the features of a logistic regression.

The language model and the regression are fitted on at most ``SAMPLE`` labelled rows, those with the smallest
hashes of their ids; everything else covers all rows.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from designstats.llm.arrays import encoded, give_back, prefix_sums, seed, slices, span_hash, trimmed, word_spans
from designstats.llm.common import free_name, stored

SAMPLE = 40_000
BUCKETS = 1 << 22
#: Lengths in bytes of the word beginnings; 0 stands for the whole word.
BEGINNINGS = (0, 4, 5, 6, 7, 8)
#: Log-likelihood ratio a feature needs to enter the regression, and how many may enter.
EVIDENCE, FEATURES = 12.0, 4096

#: Letters of the model: a-z, then the lower-case letters of Latin-1; the last symbol is the word boundary.
LETTERS = [*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]
BOUNDARY = len(LETTERS)
SYMBOLS = BOUNDARY + 1
OF = np.full(0x100, -1, dtype=np.int64)
OF[LETTERS] = np.arange(len(LETTERS))
#: The letters that a digit or sign imitates.
IMITATES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t"}
#: Log costs of the channel.
IMITATE, DROP_IMITATION, DROP_SIGN, BREAK, JOIN, DROP_REPEAT, DROP_PAIR = -0.5, -7.0, -1.0, -4.0, 0.0, 0.0, -6.0
SEPARATORS = " .-_*"


class CharModel:
    """Smoothed bigrams over the symbols, from counts."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(SYMBOLS, SYMBOLS).astype(float) + 0.5
        self.log = np.log(c / c.sum(axis=1, keepdims=True))


def bigrams(texts: list[str]) -> np.ndarray:
    """Counts of neighbouring symbols; anything that is no letter is a boundary."""
    out = np.zeros(SYMBOLS * SYMBOLS, dtype=np.int64)
    for lo, hi in slices(texts):
        codes = np.frombuffer("\n".join(["", *texts[lo:hi], ""]).lower().encode("utf-16-le", "replace"), dtype="<u2")
        s = np.where(codes < 0x100, OF[np.minimum(codes, 0xFF)], -1)
        s = np.where(s < 0, BOUNDARY, s)
        keep = (s[1:] != BOUNDARY) | (s[:-1] != BOUNDARY)
        out += np.bincount((s[:-1] * SYMBOLS + s[1:])[keep], minlength=len(out))
    return out


def lattice(chunk: str):
    """Per character: log cost of every symbol it may stand for, and of standing for nothing."""
    emit = np.full((len(chunk), SYMBOLS), -np.inf)
    drop = np.full(len(chunk), -np.inf)
    for i, ch in enumerate(chunk):
        if ch in IMITATES:
            for k, letter in enumerate(IMITATES[ch]):
                emit[i, OF[ord(letter)]] = IMITATE - 0.1 * k
            drop[i], emit[i, BOUNDARY] = DROP_IMITATION, BREAK
        elif ord(ch) < 0x100 and OF[ord(ch)] >= 0:
            emit[i, OF[ord(ch)]] = 0.0
        elif ch in SEPARATORS:
            drop[i], emit[i, BOUNDARY] = JOIN, BREAK
        else:
            drop[i], emit[i, BOUNDARY] = DROP_SIGN, BREAK
        if i and ch == chunk[i - 1]:
            long = (i > 1 and chunk[i - 2] == ch) or (i + 1 < len(chunk) and chunk[i + 1] == ch)
            drop[i] = max(drop[i], DROP_REPEAT if long else DROP_PAIR)
    return emit, drop


#: Characters of text cut at once.
CUT = 1 << 18
#: Characters of a chunk that are decoded as one.
PART = 32


def _parts(chunk: str) -> list[str]:
    pieces = re.findall(f"[^{re.escape(SEPARATORS)}]+[{re.escape(SEPARATORS)}]*|[{re.escape(SEPARATORS)}]+", chunk)
    return [p[lo:lo + PART] for p in pieces for lo in range(0, len(p), PART)]


def decode(chunks: list[str], model: CharModel) -> list[str]:
    """The likeliest reading of every chunk; boundaries become spaces. Chunks are decoded side by side.

    A long chunk is cut behind separators, and a part that is still long at PART characters; the parts are decoded each.
    """
    if any(len(c) > PART and " " not in c for c in chunks):
        parts = [_parts(c) if len(c) > PART and " " not in c else [c] for c in chunks]
        read = iter(decode([p for own in parts for p in own], model))
        return [" ".join(filter(None, [next(read) for _ in own])) for own in parts]
    out = [""] * len(chunks)
    order = sorted(range(len(chunks)), key=lambda i: len(chunks[i]))
    for lo in range(0, len(order), 2048):
        own = order[lo:lo + 2048]
        if len(chunks[own[-1]]) > 64:
            for i in own:
                out[i] = _viterbi([chunks[i]], model)[0]
        else:
            for i, text in zip(own, _viterbi([chunks[i] for i in own], model)):
                out[i] = text
    return out


def _viterbi(chunks, model):
    n, longest = len(chunks), max(map(len, chunks))
    emit = np.full((longest, n, SYMBOLS), -np.inf, dtype=np.float32)
    drop = np.zeros((longest, n), dtype=np.float32)  # beyond its end a chunk goes on at no cost
    for j, c in enumerate(chunks):
        e, d = lattice(c)
        emit[:len(c), j], drop[:len(c), j] = e, d
    log = model.log.astype(np.float32)
    best = np.full((n, SYMBOLS), -np.inf, dtype=np.float32)
    best[:, BOUNDARY] = 0
    back = np.full((longest, n, SYMBOLS), -1, dtype=np.int8)  # previous symbol, or -1: this character was dropped
    for i in range(longest):
        stay = best + drop[i][:, None]
        after = stay.copy()
        for s in np.flatnonzero(np.isfinite(emit[i]).any(axis=0)):
            rows = np.flatnonzero(np.isfinite(emit[i, :, s]))
            score = best[rows] + log[:, s]
            if s == BOUNDARY:
                score[:, BOUNDARY] = best[rows, BOUNDARY]  # boundaries in a row cost nothing more
            came = score.argmax(axis=1)
            value = score[np.arange(len(rows)), came] + emit[i, rows, s]
            better = value > stay[rows, s]
            back[i, rows[better], s] = came[better]
            after[rows[better], s] = value[better]
        best = after
    state = (best + log[:, BOUNDARY] * (np.arange(SYMBOLS) != BOUNDARY)).argmax(axis=1)
    letters: list[list[str]] = [[] for _ in chunks]
    for i in reversed(range(longest)):
        for j in np.flatnonzero(back[i, np.arange(n), state] >= 0).tolist():
            letters[j].append(" " if state[j] == BOUNDARY else chr(LETTERS[state[j]]))
            state[j] = back[i, j, state[j]]
    return ["".join(reversed(x)).strip() for x in letters]


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True
_LEET = np.zeros(256, dtype=bool)
_LEET[[ord(c) for c in IMITATES]] = True
_AFTER = _LEET.copy()  # these count behind a letter too; the others are punctuation there
_AFTER[[ord(c) for c in "!|+"]] = False
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def suspects(data: np.ndarray, starts: np.ndarray):
    """Spans of chunks that may be disguised, in order; data is UTF-8 in lower case."""
    begin, end, of = word_spans(data, starts, ~_BLANK)
    if not len(begin):
        return begin, end

    def total(flag):
        sums = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return sums[end] - sums[begin]

    head = np.ones(len(data), dtype=bool)
    head[(data & 0xC0) == 0x80] = False  # bytes that continue a character
    letter = np.concatenate([[False], _LETTER[data], [False, False]])
    next_two = np.concatenate([(data[1:-1] == data[:-2]) & (data[2:] == data[:-2]), [False, False]]) if len(data) > 2 else False
    leet = _LEET[data] & (letter[2:-1] | (_AFTER[data] & letter[:-3] & ~next_two))
    letters, leet, chars = total(_LETTER[data] & head), total(leet), total(head)
    mate = np.zeros(len(data), dtype=bool)
    if len(data) > 2:
        mate[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _LETTER[data[2:]] & (data[2:] < 128)
    inner = np.zeros(len(data), dtype=bool)  # a sign between two letters
    if len(data) > 2:
        inner[1:-1] = ~_LETTER[data[1:-1]] & _LETTER[data[:-2]] & _LETTER[data[2:]]
    apart = (letters >= 3) & (total(inner) >= letters - 1)
    odd = ((leet > 0) & (letters > 0)) | (total(mate) > 0) | apart
    single = (letters + leet == 1) & (chars <= 2)
    # Runs of three and more single letters are one chunk.
    text = np.repeat(np.arange(len(of) - 1), np.diff(of))
    first = single & ~np.concatenate([[False], single[:-1] & (text[1:] == text[:-1])])
    run = np.cumsum(first) * single
    size = np.bincount(run)
    long = single & (size[run] >= 3)
    lo = np.concatenate([begin[odd & ~long], begin[first & long]])
    last = single & ~np.concatenate([single[1:] & (text[1:] == text[:-1]), [False]])
    hi = np.concatenate([end[odd & ~long], end[last & long]])
    order = np.argsort(lo, kind="stable")
    return lo[order], hi[order]


def features(texts: list[str], model: CharModel, memory: dict[str, str]):
    """(text number, bucket) of every feature, repeats included."""
    data, starts = encoded([t.lower() for t in texts])
    lo, hi = suspects(data, starts)
    own = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(lo.tolist(), hi.tolist())]
    if len(memory) > 1 << 16:
        memory.clear()
    if new := [c for c in dict.fromkeys(own) if c not in memory]:
        memory.update(zip(new, decode(new, model)))
    parts = [_hashed(data, starts)]
    if own:
        d, s = encoded([memory[c] for c in own])
        at, bucket = _hashed(d, s)
        parts.append(((np.searchsorted(starts, lo, "right") - 1)[at], bucket))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _hashed(data, starts):
    start, end, of = word_spans(data, starts)
    text = np.repeat(np.arange(len(of) - 1), np.diff(of))
    sums = prefix_sums(data)
    at, bucket = [], []
    for k, n in enumerate(BEGINNINGS):
        use = end - start >= n
        to = start[use] + n if n else end
        h = span_hash(sums, start[use], to) + seed(k)
        at.append(text[use])
        bucket.append((h % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(at), np.concatenate(bucket)


class Model:
    """Character model, weights of the buckets (0: not chosen) and the intercept; its size is fixed."""

    def __init__(self, chars: CharModel, chosen: np.ndarray, weights: np.ndarray, intercept: float):
        self.chars, self.chosen, self.weights, self.intercept = chars, chosen, weights, intercept

    def scorer(self):
        table = np.full(BUCKETS, -1, dtype=np.int32)
        table[self.chosen] = np.arange(len(self.chosen))
        memory: dict[str, str] = {}

        def score(texts: list[str]) -> np.ndarray:
            out = np.full(len(texts), self.intercept)
            for lo, hi in slices(texts, CUT):
                at, k = _present(table, features(texts[lo:hi], self.chars, memory))
                out[lo:hi] += np.bincount(at, weights=self.weights[k], minlength=hi - lo) if len(k) else 0
            return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

        return score


def _present(table, found):
    """Distinct (text number, chosen feature)."""
    at, bucket = found
    k = table[bucket]
    at, k = at[k >= 0], k[k >= 0].astype(np.int64)
    pair = np.unique(at * (1 << 32) + k)
    return pair >> 32, pair & 0xFFFFFFFF


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    Rows without a label or an id are left out; an id with several labels is toxic if one of them says so.
    Rows that repeat an id are labelled alike; null texts are empty; long texts are read whole. The character model counts
    all of docs. Without a labelled row of both kinds every text scores the share of toxic rows (0 where there is none).
    """
    spark = docs.sparkSession
    marked = (
        labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = stored(rows.join(F.broadcast(marked), "doc_id").select("doc_id", "text", "toxic"), "labelled")  # at most `sample` ids

    def count_pairs(batches):
        total = np.zeros(SYMBOLS * SYMBOLS, dtype=np.int64)
        for b in batches:
            total += bigrams(b.column("text").to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": at, "n": total[at]})

    counts = np.zeros(SYMBOLS * SYMBOLS, dtype=np.int64)
    every = docs.select(F.coalesce("text", F.lit("")).alias("text"))  # a statistic of the corpus: no sample
    for r in every.mapInArrow(trimmed(count_pairs), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[r["pair"]] = r["n"]  # at most SYMBOLS ** 2 rows
    chars = CharModel(counts)

    def count_features(batches):
        give_back()
        memory: dict[str, str] = {}
        seen = np.zeros((2, BUCKETS), dtype=np.int32)
        for b in batches:
            texts, toxic = b.column("text").to_pylist(), np.array(b.column("toxic").to_pylist(), dtype=np.int64)
            for lo, hi in slices(texts, CUT):
                at, bucket = features(texts[lo:hi], chars, memory)
                pair = np.unique(at * BUCKETS + bucket)
                kind = (toxic[lo:hi][pair // BUCKETS] > 0).astype(np.int64)
                for k in (0, 1):
                    own, n = np.unique(pair[kind == k] % BUCKETS, return_counts=True)
                    seen[k, own] += n.astype(np.int32)
        at = np.flatnonzero(seen[0] | seen[1])
        for lo in range(0, len(at), 1 << 16):
            own = at[lo:lo + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"bucket": own, "clean": seen[0, own].astype(np.int64), "toxic": seen[1, own].astype(np.int64)})

    n_toxic, n = rows.agg(F.sum(F.expr("int(toxic > 0)")), F.count("*")).first()
    n_toxic = n_toxic or 0
    if not 0 < n_toxic < n:
        share = n_toxic / n if n else 0.0
        odds = np.log(max(share, 1e-12) / max(1 - share, 1e-12))
        return Model(chars, np.zeros(0, dtype=np.int64), np.zeros(0), float(odds))
    base = n_toxic / n
    seen = rows.mapInArrow(trimmed(count_features), "bucket long, clean long, toxic long").groupBy("bucket").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rate = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    gain = 2 * (F.when(rate > 0, F.col("toxic") * F.log(rate / base)).otherwise(0.0)
                + F.when(rate < 1, F.col("clean") * F.log((1 - rate) / (1 - base))).otherwise(0.0))
    best = seen.withColumn("gain", gain).filter((F.col("gain") >= EVIDENCE) & (rate > base))
    chosen = np.array(sorted(r["bucket"] for r in best.orderBy(F.desc("gain"), "bucket").limit(FEATURES).collect()), dtype=np.int64)

    def presence(batches):
        table = np.full(BUCKETS, -1, dtype=np.int32)
        table[chosen] = np.arange(len(chosen))
        memory: dict[str, str] = {}
        for b in batches:
            texts, toxic = b.column("text").to_pylist(), b.column("toxic").to_pylist()
            for lo, hi in slices(texts, CUT):
                at, k = _present(table, features(texts[lo:hi], chars, memory))
                bounds = np.searchsorted(at, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_pydict({
                    "toxic": pa.array([int(t > 0) for t in toxic[lo:hi]], pa.int32()),
                    "own": pa.array([k[a:z].tolist() for a, z in zip(bounds[:-1], bounds[1:])], pa.list_(pa.int32()))})

    kinds = rows.mapInArrow(trimmed(presence), "toxic int, own array<int>").groupBy("own", "toxic").count().collect()  # at most `sample` rows
    weights, intercept = regress([r["own"] for r in kinds], np.array([r["toxic"] for r in kinds], dtype=float),
                                 np.array([r["count"] for r in kinds], dtype=float), len(chosen))
    return Model(chars, chosen, weights, intercept)


def regress(own, y, n, size, ridge: float = 0.05, steps: int = 30):
    """Ridge logistic regression on sparse presence rows with counts: Newton steps, solved by conjugate gradients."""
    row = np.repeat(np.arange(len(own)), [len(k) for k in own])
    col = np.array([k for ks in own for k in ks], dtype=np.int64)
    penalty = np.append(np.full(size, ridge), 1e-6)

    def times(v):
        return v[-1] + np.bincount(row, weights=v[col], minlength=len(own))

    def back(r):
        return np.append(np.bincount(col, weights=r[row], minlength=size), r.sum())

    def loss(w):
        z = times(w)
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (penalty * w * w).sum())

    w = np.zeros(size + 1)
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        gradient = back(n * (p - y)) + penalty * w
        curve = n * np.maximum(p * (1 - p), 1e-9)
        step, r = np.zeros(size + 1), gradient.copy()
        d, rr = r.copy(), r @ r
        for _ in range(200):
            if rr <= 1e-18 * max(1.0, gradient @ gradient):
                break
            hd = back(curve * times(d)) + penalty * d
            alpha = rr / (d @ hd)
            step, r = step + alpha * d, r - alpha * hd
            rr, old = r @ r, rr
            d = r + rr / old * d
        size_of = 1.0
        while (after := loss(w - size_of * step)) > now and size_of > 1e-4:
            size_of /= 2
        if after > now:
            break
        w, gained, now = w - size_of * step, now - after, after
        if gained < 1e-9 * max(1.0, abs(now)):
            break
    return w[:-1], float(w[-1])


def score_documents(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of the documents and the score of the whole text, 0 to 1, under ``name`` (a column of docs so called is
    left out). A null text is empty; rows that repeat, null ids and long texts are scored as any other; an empty table gives none.
    """
    docs = docs.drop(name)
    scored = free_name(docs, "scored_text")
    rows = docs.select(*docs.columns, F.coalesce("text", F.lit("")).alias(scored))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{name}` double"

    def run(batches):
        give_back()
        score = model.scorer()
        for b in batches:
            values = score(b.column(scored).to_pylist())
            kept = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(values)], names=[*b.schema.names[:-1], name])
        del score
        give_back()

    return rows.mapInArrow(run, schema)
