"""Packing by non-negative least squares on the length histogram.

Documents become pieces of at most ``window`` tokens. Lengths are counted in units of ``UNIT`` tokens;
all combinations of at most ``DEPTH`` lengths that fill a window are the columns, the histogram is the
right side, and the solution, rounded, says how often each combination is laid out. What the rounding
leaves is packed greedily, also on the histogram. Pieces then take their places by their rank among those of
their length, so the plan on the driver has the size of the histogram, not of the data.

One document in ``SPARE`` (by hash) is held back: it is cut to close the gaps that are left in the
sequences (lengths are not whole units), then fills further windows, the last of them powers of two.
"""

import os
import zlib
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from designstats.llm.arrays import trimmed
from designstats.llm.common import parts_of, stored, totals_before
from designstats.llm.tokens import worker_encoder

UNIT = 16
DEPTH = 3
SPARE = 24
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, spare boolean, ids binary"


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Least squares with non-negative unknowns by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, dtype=bool)
    ata, atb = a.T @ a if n <= 512 else None, a.T @ b
    for _ in range(rounds or 3 * a.shape[0]):
        gradient = atb - (a.T @ (a @ x) if ata is None else ata @ x)
        gradient[active] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= 1e-9 * max(1.0, float(np.abs(atb).max())):
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > 0).all():
                break
            low = s <= 0
            step = float(np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300)))
            x[at] += step * (s - x[at])
            out = at[x[at] <= 1e-12]
            x[out] = 0
            active[out] = False
            if not len(out):
                active[at[low]] = False
        x[:] = 0
        x[at] = s
    return x


def fillings(units: int, depth: int) -> list[tuple[int, ...]]:
    """All multisets of at most depth lengths that add up to the window, longest length first."""
    out = [(units,)]
    for d in range(2, depth + 1):
        for short in combinations_with_replacement(range(1, units // 2 + 1), d - 1):
            rest = units - sum(short)
            if rest >= short[-1]:
                out.append((rest, *reversed(short)))
    return out


def plan(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in units, repeats) that use up the histogram; histogram[u] pieces have u units."""
    units = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if not left.any():
        return out
    strategies = [s for s in fillings(units, depth) if left[list(s)].all()]
    if strategies:
        a = np.zeros((units + 1, len(strategies)))
        for j, s in enumerate(strategies):
            np.add.at(a[:, j], list(s), 1)
        x = nnls(a, left.astype(float))
        for j in np.argsort(-x):
            use = np.bincount(strategies[j], minlength=units + 1)
            repeats = min(int(round(x[j])), int((left[use > 0] // use[use > 0]).min()))
            if repeats > 0:
                out.append((strategies[j], repeats))
                left -= repeats * use
    while left.any():  # each round uses up a length, but for a few rests
        room, chosen, use = units, [], np.zeros(units + 1, dtype=np.int64)
        while (fit := np.flatnonzero((left - use)[:room + 1] > 0)).size:
            u = int(fit[-1])
            times = min(int(left[u] - use[u]), room // u)
            chosen += [u] * times
            use[u] += times
            room -= times * u
        repeats = int((left[use > 0] // use[use > 0]).min())
        out.append((tuple(chosen), repeats))
        left -= repeats * use
    return out


def places(steps: list[tuple[tuple[int, ...], int]]) -> tuple[list[tuple], int]:
    """(units, first rank, end rank, first sequence, place) for every run of ranks; number of sequences."""
    rows, taken, sequence = [], {}, 0
    for lengths, repeats in steps:
        for k, u in enumerate(lengths):
            lo = taken.get(u, 0)
            taken[u] = lo + repeats
            rows.append((u, lo, lo + repeats, sequence, k))
        sequence += repeats
    return rows, sequence


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, window: int, keep_ids: bool) -> DataFrame:
    """Token ids of every document cut into windows and a rest; the rest of a spare document keeps its ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("spare", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SPARE)) == 0)

    def cut(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end = None, np.array([end_id], dtype=np.uint32)
        for b in batches:
            encoder = encoder or worker_encoder(tokenizer, "word")
            ids, texts, spare = (b.column(k).to_pylist() for k in ("doc_id", "text", "spare"))
            for lo in range(0, len(texts), 512):
                rows = []
                for i, x in enumerate(encoder.ids(texts[lo:lo + 512]), lo):
                    x = np.concatenate([x, end]).astype("<u4")
                    for at in range(0, len(x), window):
                        raw = x[at:at + window].tobytes()
                        last = spare[i] and len(raw) < 4 * window
                        rows.append((ids[i], at, len(raw) // 4, zlib.crc32(raw), len(x), last, raw if last or keep_ids else None))
                columns = list(zip(*rows))
                kinds = [pa.int64()] * 5 + [pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                                 names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "spare", "ids"])

    return rows.mapInArrow(trimmed(cut), PIECE)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids
    (little-endian unsigned 32-bit; null where keep_ids is false).

    A null text is empty: its one piece is the end id. A null doc_id is kept; a repeated row is packed
    again; an empty table gives no rows. The window must be a power of two and a multiple of ``UNIT``.
    """
    spark = docs.sparkSession
    pieces = stored(cut_documents(docs, tokenizer, end_id, window, keep_ids), "pieces")
    units = F.ceil(F.col("length") / UNIT).cast("int")
    counts = pieces.filter("not spare").groupBy(units.alias("u")).count().collect()  # one row per length in units
    spare = pieces.filter("spare").agg(F.sum("length"), F.count("*")).first()
    histogram = np.zeros(window // UNIT + 1, dtype=np.int64)
    for r in counts:
        histogram[r["u"]] = r["count"]
    rows, sequences = places(plan(histogram))
    table = spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], "units int, lo long, hi long, base long, place int")

    n_rows = int(histogram.sum())
    whole = pieces.filter("not spare").withColumn("units", units).withColumn(
        "cell", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts_of(n_rows, 1 << 18))))
    ranked = totals_before(whole, "cell", ["doc_id", "start"], F.lit(1), "rank", within=["units"])
    put = (
        ranked.join(F.broadcast(table), "units")  # the plan: a few rows for each length in units
        .filter("rank >= lo and rank < hi")
        .withColumn("sequence_id", F.col("base") + F.col("rank") - F.col("lo"))
    )
    order = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    put = put.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    put = stored(put.select(*columns), "packed")

    # Gaps in order of their sequences, then whole windows, then powers of two, as one line of positions.
    used = put.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    gaps = used.filter(F.col("used") < window).withColumn("room", F.lit(window) - F.col("used"))
    gaps = totals_before(gaps.withColumn("cell", F.floor(F.col("sequence_id") / 16384)), "cell", ["sequence_id"], F.col("room"), "from")
    gaps = stored(gaps.select("sequence_id", F.col("used").alias("offset"), "room", "from"), "gaps")
    total, have = gaps.agg(F.sum("room")).first()[0] or 0, spare[0] or 0
    full, rest = divmod(max(0, have - total), window)
    more = spark.range(full).select(
        (F.lit(sequences) + F.col("id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.lit(window).cast("long").alias("room"), (F.lit(total) + F.col("id") * window).alias("from"))
    ends, at, sequence = [], total + full * window, sequences + full
    for k in reversed(range(window.bit_length() - 1)):
        if rest >> k & 1:
            ends.append((sequence, 0, 1 << k, at))
            at, sequence = at + (1 << k), sequence + 1
    room = gaps.unionByName(more).unionByName(spark.createDataFrame(ends, gaps.schema))
    room = room.select("sequence_id", "offset", F.col("from").alias("a"), (F.col("from") + F.col("room")).alias("b"))
    line = totals_before(
        pieces.filter("spare").withColumn("cell", F.pmod(F.xxhash64("doc_id", "ids_crc32"), F.lit(parts_of(spare[1], 16384)))),
        "cell", ["doc_id", "ids_crc32"], F.col("length"), "c")
    line = line.withColumn("d", F.col("c") + F.col("length")).select("doc_id", "start", "doc_tokens", "ids", "c", "d")

    def blocks(df, lo, hi):
        return df.withColumn("block", F.explode(F.sequence(F.floor(F.col(lo) / window), F.floor((F.col(hi) - 1) / window))))

    low, high = F.greatest("a", "c", F.col("block") * window), F.least("b", "d", (F.col("block") + 1) * window)
    met = blocks(room, "a", "b").join(blocks(line, "c", "d"), "block").withColumn("low", low).withColumn("high", high).filter("low < high")
    # A piece that crosses a block is one piece still.
    cut = met.groupBy("doc_id", "start", "doc_tokens", "ids", "c", "sequence_id", "offset", "a").agg(
        F.min("low").alias("low"), F.max("high").alias("high"))
    size = (F.col("high") - F.col("low")).cast("long")
    own = F.substring("ids", (4 * (F.col("low") - F.col("c")) + 1).cast("int"), (4 * size).cast("int"))
    cut = cut.select(
        "doc_id", (F.col("start") + F.col("low") - F.col("c")).alias("start"), size.alias("length"), F.crc32(own).alias("ids_crc32"),
        "doc_tokens", "sequence_id", (F.col("offset") + F.col("low") - F.col("a")).alias("offset"),
        own.alias("ids") if keep_ids else F.lit(None).cast("binary").alias("ids"))
    return put.unionByName(cut)
