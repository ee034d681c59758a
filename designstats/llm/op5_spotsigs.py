"""Document fingerprints: SpotSigs.

An anchor is a common word; its signature is the anchor and the ``CHAIN`` content words that follow it, each
``DISTANCE`` content words on from the one before. The set of a text's signatures is its fingerprint. Pairs
are found through partitions by set length: sets whose Jaccard similarity reaches the threshold have lengths
within that ratio, so a set meets its own and the next partitions only, and inside them the join
runs over the rarest signatures that such a pair must share.
"""

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from designstats.llm.arrays import encoded, mix, seed, slices, spans_of, word_spans, words
from designstats.llm.common import parts_of, stored

CHAIN, DISTANCE, EVERY = 2, 1, 8
#: Common words of four languages.
ANCHORS = ("the of and to in a is that it was for on are as with his they at be this have from or had by but not what all were when we there "
           "can an your which their if will each about how up out them then she many some so these would other into has more her two him see "
           "der die und das den von zu mit sich des auf nicht ein eine dem im ist auch es an als nach wie bei oder aber "
           "le la les et un une du dans que qui est pour par sur plus ne pas se ce son avec sont ou mais "
           "el los y del las por con no su para al lo como pero sus le ya este si porque").split()
#: Range cells at most; with more rows the cells grow.
CELLS = 100_000


def _anchors() -> np.ndarray:
    data, starts = encoded(sorted(set(ANCHORS)))
    begin, end, _ = word_spans(data, starts)
    return np.sort(spans_of(data, begin, end))


_ANCHORS = _anchors()


def signatures(texts: list[str]) -> list[np.ndarray]:
    """The distinct signatures of every text, ascending, as unsigned 32-bit numbers.

    Words of one or two bytes are anchors too, and so is one in ``EVERY`` of the others, by hash (it stays
    a content word): it serves texts with few common words. Where fewer content words follow, the chain is as long as
    they last. A text without an anchor has one signature, of its first content words; one without words none.
    """
    out = []
    for lo, hi in slices(texts):
        word, of = words(texts[lo:hi])
        anchor = _ANCHORS[np.minimum(np.searchsorted(_ANCHORS, word), len(_ANCHORS) - 1)] == word
        listed = anchor | _short(texts[lo:hi])
        anchor = listed | (word % np.uint64(EVERY) == 0)
        text = np.repeat(np.arange(hi - lo), np.diff(of))
        content = np.flatnonzero(~listed)
        before = np.concatenate([[0], np.cumsum(~listed)])  # content words before each word
        starts = np.flatnonzero(anchor)
        none = np.flatnonzero((np.diff(of) > 0) & (np.add.reduceat(np.append(anchor, False), np.minimum(of[:-1], len(word))) == 0)) if len(word) else starts
        owner = np.concatenate([text[starts], none])
        first = np.concatenate([before[starts + 1], before[of[none]]])
        h = np.concatenate([word[starts], np.full(len(none), seed(5))])
        ends = before[of[1:]]
        for k in range(CHAIN):
            at = first + DISTANCE - 1 + k * DISTANCE
            there = at < ends[owner]
            own = content[np.minimum(at, len(content) - 1)] if len(content) else np.zeros(len(at), dtype=np.int64)
            h = mix(h * np.uint64(3) + np.where(there, word[own] if len(word) else 0, np.uint64(k + 1)))
        pair = np.unique((owner.astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32)))
        bounds = np.searchsorted(pair, np.arange(hi - lo + 1, dtype=np.uint64) << np.uint64(32))
        sig = (pair & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        out += [sig[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    return out


def _short(texts):
    data, starts = encoded([t.lower() for t in texts])
    begin, end, _ = word_spans(data, starts)
    return end - begin <= 2


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two signature sets; 0 without comparing where their lengths rule the least out.

    Two empty sets are alike.
    """
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def written(sig: np.ndarray) -> str:
    """The fingerprint as text: the signatures in ascending order, in hexadecimal."""
    return sig.astype(">u4").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u4").astype(np.uint32)


def partition_of(length: int, threshold: float) -> int:
    """Partitions of set lengths: the bounds grow by 1 / threshold."""
    return 0 if length <= 0 else int(np.floor(np.log(length) / -np.log(threshold) + 1e-9))


def similar_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, likeness, a_key, b_key) of the different fingerprints at or above the threshold, by their smallest doc_ids.

    a_key and b_key are hashes of the fingerprints; a pair is ordered by (id, key), so a = b where two fingerprints share
    their id. Texts with equal fingerprints are one; texts without signatures match nothing; an id is null, and comes
    first, if all ids of the fingerprint are.
    """
    def sign(batches):
        for batch in batches:
            own = signatures(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([hashlib.md5(s.tobytes()).digest() for s in own], pa.binary()),
                 pa.array([s.astype(np.int64).tolist() for s in own], pa.list_(pa.int64()))], names=["doc_id", "key", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sets = stored(rows.mapInArrow(sign, "doc_id long, key binary, sig array<long>").filter(F.size("sig") > 0), "signed")
    ids = sets.groupBy("key").agg(F.min("doc_id").alias("id"))
    sets = stored(sets.dropDuplicates(["key"]).join(ids, "key").select(F.struct("id", "key").alias("id"), "sig"), "sets")
    counts = sets.select(F.explode("sig").alias("s")).groupBy("s").agg(F.count("*").alias("df"))
    size = F.size("sig")
    part = F.floor(F.log(size.cast("double")) / F.lit(-float(np.log(threshold))) + 1e-9).cast("int")
    ranked = sets.select("id", size.alias("size"), part.alias("part"), F.explode("sig").alias("s")).join(counts, "s")
    # A pair at the threshold shares at least one of the size - ceil(threshold * size) + 1 rarest signatures of each.
    rare = ranked.groupBy("id", "size", "part").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("o")).select(
        "id", "size", "part", F.explode(F.slice("o", F.lit(1), (F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1).cast("int"))).alias("o")
    ).select("id", "size", "part", F.col("o.s").alias("s")).filter("s is not null")
    right = rare.select(F.col("id").alias("b"), F.col("size").alias("size_b"), "s", "part")
    left = rare.select(F.col("id").alias("a"), F.col("size").alias("size_a"), "s", F.explode(F.sequence(F.col("part") - 1, F.col("part") + 1)).alias("part"))
    fits = (F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b") - 1e-9) & (F.col("a") < F.col("b"))
    pairs = left.join(right, ["s", "part"]).filter(fits).select("a", "b").distinct()
    full = pairs.select("a", "b", F.col("a.key").alias("a_key"), F.col("b.key").alias("b_key"))
    for side, sig in (("a_key", "x"), ("b_key", "y")):
        full = full.join(sets.select(F.col("id.key").alias(side), F.col("sig").alias(sig)), side)
    both = F.size(F.array_intersect("x", "y"))
    alike = full.select("a", "b", "a_key", "b_key", (both / (F.size("x") + F.size("y") - both)).alias("likeness")).filter(F.col("likeness") >= threshold - 1e-9)
    return alike.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "likeness", "a_key", "b_key")


def cell_starts(rows: DataFrame, rows_per_cell: int) -> list[tuple]:
    """(id is known, id or 0, tie) of the first row of each range cell, ascending; at most ``CELLS`` of them."""
    n = rows.count()
    cells = parts_of(n, max(rows_per_cell, n // CELLS))
    order = [F.col("doc_id").asc_nulls_first(), "tie"]
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), "tie"))
    ids = rows.select("doc_id", "tie").repartitionByRange(cells, *order)
    return sorted(tuple(r["first"]) for r in ids.groupBy(F.spark_partition_id()).agg(first.alias("first")).collect())


def fingerprints_with_edit(docs: DataFrame, rows_per_cell: int = 4096) -> DataFrame:
    """Fingerprint of every text and of its edited text (its last quarter replaced by as much of the next one's start).

    Ties of a doc_id are taken by a hash of the text; null ids come first; a single row is its own next. The texts
    move once: each range cell of ids is sorted in one task, and the first document of every cell also stands
    at the end of the cell before it (of the last, for the first cell), so each row meets the one after it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "tie", F.xxhash64("text"))
    starts = cell_starts(rows, rows_per_cell)
    n = max(1, len(starts))

    def deal(batches):
        for batch in batches:
            keys = [(d is not None, d or 0, t) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist())]
            at = [max(0, bisect_right(starts, k) - 1) for k in keys]
            heads = [i for i, (k, c) in enumerate(zip(keys, at)) if starts[c] == k]
            out = batch.take(pa.array([*range(len(keys)), *heads], pa.int64()))
            cell = at + [(at[i] - 1) % n for i in heads]
            halo = [False] * len(keys) + [True] * len(heads)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), pa.array(halo, pa.bool_()), *out.columns], names=["cell", "halo", *out.schema.names])

    dealt = rows.mapInArrow(deal, "cell int, halo boolean, doc_id long, text string, tie long")
    dealt = dealt.repartition(n, "cell").sortWithinPartitions("cell", "halo", F.col("doc_id").asc_nulls_first(), "tie")

    def run(batches):
        held = None  # the last row of the cell that has not met the one after it
        for batch in batches:
            rows, after = [], []
            for row in zip(*(batch.column(k).to_pylist() for k in ("cell", "doc_id", "text", "halo"))):
                if held is not None and held[0] == row[0]:
                    rows.append(held)
                    after.append(row[2])
                held = None if row[3] else row
            for lo, hi in slices([r[2] for r in rows]):
                yield _fingerprint_rows(rows[lo:hi], after[lo:hi])

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                 "near_edited double, near_next double")


def _fingerprint_rows(rows, nexts):
    texts = [r[2] for r in rows]
    edited = []
    for t, after in zip(texts, nexts):
        cut = len(t) // 4
        edited.append(t[:len(t) - cut] + after[:cut])
    own, new, follow = signatures(texts), signatures(edited), signatures(nexts)
    return pa.RecordBatch.from_arrays([
        pa.array([r[1] for r in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in edited]),
        pa.array([written(s) for s in own]), pa.array([written(s) for s in new]),
        pa.array([likeness(a, b) for a, b in zip(own, new)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(own, follow)], pa.float64()),
    ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
