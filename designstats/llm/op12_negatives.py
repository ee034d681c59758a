"""Hard-negative mining by threshold joins in the manner of L2AP.

A block of anchors meets all rows. For a threshold t an anchor's components are taken from the largest to the
smallest; as soon as the norm of those not yet taken, times the largest norm of the rows at hand, is below t, the
rest is left out of the inverted index: no row reaches t by it alone. Rows add up partial scores along the posting
lists; a pair whose partial score and remaining norms cannot reach t is dropped, the others are completed.

Windows are filled from above. Every anchor starts with a high threshold; what reaches it is ranked, and only
windows with too few rows are joined again under a lower threshold, down to the least that the definition
allows. The rows above a threshold are all found, so a full window is final. A task keeps the first ``k``
rows of each window, in their final order, so that copies of one vector do not pile up.
"""

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from designstats.llm.common import stored, totals_before

SCALE, K = 256, 5
#: Bounds of a negative's score against the positive's, in percent.
LOW, HIGH = 80, 100
#: Thresholds of the positives, as shares of (norm of the anchor) x (largest norm of the rows); the last takes all.
STEPS = (0.5, 0.25, 0.0, -1.0)
#: Thresholds of the negatives, in percent of the positive's score.
BANDS = (95, 88, LOW)
#: Components of the anchors held by a task, and products of anchors and rows worked on at once.
BLOCK, CELLS = 1 << 18, 1 << 21


def scaled(raw: list) -> np.ndarray:
    """floor(256 * x) of every component; shorter vectors end in zeros."""
    out = np.zeros((len(raw), max(map(len, raw), default=0)))
    for i, v in enumerate(raw):
        out[i, :len(v)] = v
    return np.floor(out * SCALE)


def _vectors(rows: DataFrame) -> DataFrame:
    """vec_id, label, dims, norm and the scaled vector of the rows that take part, as doubles in bytes."""
    vec = F.col("embedding").cast("array<double>")
    valid = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    kept = rows.filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & vec.isNotNull() & valid)

    def run(batches):
        for batch in batches:
            v = scaled(batch.column("v").to_pylist()) if batch.num_rows else np.zeros((0, 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes() for r in v], pa.binary())], names=["vec_id", "label", "v"])

    named = kept.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), vec.alias("v"))
    return named.mapInArrow(run, "vec_id long, label long, v binary")


def _matrix(raw: list[bytes], dims: int = 0) -> np.ndarray:
    """Vectors as the rows of a matrix with at least so many columns."""
    out = np.zeros((len(raw), max([dims, *(len(r) // 8 for r in raw)])))
    for i, r in enumerate(raw):
        out[i, :len(r) // 8] = np.frombuffer(r)
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether sums of products are exact in doubles."""
    return not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53


def posting_lists(anchors: np.ndarray, least: np.ndarray, most_norm: float):
    """For every dimension the anchors indexed there, and the norm of what each anchor leaves out.

    Components are taken by falling size until the norm of the rest times most_norm is below the anchor's threshold.
    """
    order = np.argsort(-np.abs(anchors), axis=1, kind="stable")
    squares = np.take_along_axis(anchors, order, axis=1) ** 2
    rest = np.sqrt(np.concatenate([np.cumsum(squares[:, ::-1], axis=1)[:, ::-1], np.zeros((len(anchors), 1))], axis=1))
    covered = rest * most_norm * (1 + 1e-9) < least[:, None]
    taken = np.where(covered.any(axis=1), covered.argmax(axis=1), anchors.shape[1])
    indexed = np.zeros(anchors.shape, dtype=bool)
    np.put_along_axis(indexed, order, np.arange(anchors.shape[1]) < taken[:, None], axis=1)
    return [np.flatnonzero(indexed[:, d]) for d in range(anchors.shape[1])], np.take_along_axis(rest, taken[:, None], axis=1)[:, 0], indexed


def reaching(anchors: np.ndarray, least: np.ndarray, rows: np.ndarray):
    """(anchor, row, score) of all pairs whose score is at least the anchor's threshold; scores are exact integers."""
    if not len(anchors) or not len(rows):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    norms = np.sqrt((rows ** 2).sum(axis=1))
    lists, rest, indexed = posting_lists(anchors, least, norms.max())
    partial, seen = np.zeros((len(anchors), len(rows))), np.zeros((len(anchors), len(rows)))
    squares = rows ** 2
    for d, of in enumerate(lists):
        if len(of):
            partial[of] += anchors[of, d, None] * rows[None, :, d]
            seen[of] += squares[None, :, d]
    left = np.sqrt(np.maximum(norms[None, :] ** 2 - seen, 0))
    a, r = np.nonzero((partial + rest[:, None] * left) * (1 + 1e-9) + 1e-6 >= least[:, None])
    if _exact(anchors, rows):
        score = partial[a, r]
        missing = np.flatnonzero(rest[a] > 0)
        for lo in range(0, len(missing), CELLS // 16):
            at = missing[lo:lo + CELLS // 16]
            score[at] += np.einsum("ij,ij->i", np.where(indexed[a[at]], 0.0, anchors[a[at]]), rows[r[at]])
        score = np.rint(score).astype(np.int64)
    else:
        score = np.array([sum(int(x) * int(y) for x, y in zip(anchors[i], rows[j])) for i, j in zip(a.tolist(), r.tolist())], dtype=np.int64)
    keep = score >= least[a]
    return a[keep], r[keep], score[keep]


def _first(window: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Where the first k entries of each window are, by falling score and rising id."""
    order = np.lexsort((vec_id, -score, window))
    start = np.flatnonzero(np.append(True, window[order][1:] != window[order][:-1])) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[rank < k]


def _ranked(rows: DataFrame, windows: pd.DataFrame, matrix: np.ndarray, fits: Callable, k: int) -> pd.DataFrame:
    """The first k rows of every window (w): those that reach its threshold and fit, by falling score and rising id.

    A block has a bounded number of windows, and each gives k rows.
    """
    anchor, least = windows["anchor"].to_numpy(), windows["least"].to_numpy(dtype=float)
    per_anchor = np.full(len(matrix), np.inf)
    np.minimum.at(per_anchor, anchor, least)
    of_anchor = [np.flatnonzero(anchor == i) for i in range(len(matrix))]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, step := max(1, CELLS // max(1, len(matrix)))):
                part = batch.slice(lo, step)
                vec = _matrix(part.column("v").to_pylist(), matrix.shape[1])
                own = matrix if vec.shape[1] == matrix.shape[1] else np.pad(matrix, ((0, 0), (0, vec.shape[1] - matrix.shape[1])))
                live = np.flatnonzero(np.isfinite(per_anchor) | (per_anchor < 0))
                a, r, score = reaching(own[live], per_anchor[live], vec)
                a = live[a]
                counts = np.array([len(of_anchor[i]) for i in a.tolist()], dtype=np.int64)
                pair = np.repeat(np.arange(len(a)), counts)
                w = np.concatenate([of_anchor[i] for i in a.tolist()]) if len(a) else np.zeros(0, dtype=np.int64)
                ids, labels = part.column("vec_id").to_numpy(), part.column("label").to_numpy()
                ok = (score[pair] >= least[w]) & fits(w, ids[r[pair]], labels[r[pair]], score[pair])
                w, pair = w[ok], pair[ok]
                found = _first(w, score[pair], ids[r[pair]], k)
                w, pair = w[found], pair[found]
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(ids[r[pair]]), pa.array(score[pair])], names=["w", "vec_id", "score"])

    order = Window.partitionBy("w").orderBy(F.desc("score"), "vec_id")
    found = rows.mapInArrow(run, "w long, vec_id long, score long")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).toPandas().sort_values(["w", "rank"])


def _filled(rows, windows: pd.DataFrame, thresholds: list, matrix, fits, k: int) -> pd.DataFrame:
    """Ranks the windows under falling thresholds; only those that are not full go on to the next."""
    done, open_w = [], np.arange(len(windows))
    for n, least in enumerate(thresholds):
        if not len(open_w):
            break
        mine = windows.iloc[open_w].assign(least=least[open_w])
        got = _ranked(rows, mine.reset_index(drop=True), matrix, lambda w, *x, o=open_w: fits(o[w], *x), k)
        got["w"] = open_w[got["w"].to_numpy(dtype=np.int64)]
        full = got.groupby("w").size().reindex(open_w, fill_value=0).to_numpy() >= k
        final = full | (n == len(thresholds) - 1)
        done.append(got[got["w"].isin(open_w[final])])
        open_w = open_w[~final]
    return pd.concat(done, ignore_index=True) if done else pd.DataFrame({"w": [], "vec_id": [], "score": [], "rank": []}, dtype="int64")


_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(embeddings: DataFrame, every: int = 100, k: int = K) -> DataFrame:
    """For each anchor and positive the first k negatives: anchor_id, positive_id, rank, negative_id and both scores.

    Anchors are the rows whose vec_id is divisible by ``every``. Rows with a null vec_id, label or vector or a null or
    non-finite component take no part. Vectors of different lengths meet as if the shorter ended in zeros. Rows that
    repeat a vec_id are rows of their own: each may be a positive or negative, in an order of their ids and, where
    these are equal too, in any; repeated anchors are mined once each, and the other is no positive of it, as it has
    the anchor's id. A positive score below zero allows no negatives, of zero only those with score zero. An empty
    table, or one without anchors, gives no rows; other columns are not read.
    """
    spark = embeddings.sparkSession
    rows = stored(_vectors(embeddings.select("vec_id", "label", "embedding")), "vectors")
    anchors = rows.filter(F.col("vec_id") % every == 0).withColumn("cell", F.pmod(F.xxhash64("vec_id"), F.lit(256)))
    numbered = totals_before(anchors, "cell", ["vec_id", "label", "v"], F.octet_length("v") / 8 + 1, "at")
    blocks = stored(numbered.select("vec_id", "label", "v", F.expr(f"at div {BLOCK}").alias("block")), "anchors")
    most = _most_norm(rows)
    out = None
    for b in range(int(blocks.agg(F.coalesce(F.max("block"), F.lit(-1))).first()[0]) + 1):
        own = blocks.filter(F.col("block") == b).select("vec_id", "label", "v").toPandas()  # BLOCK components and one vector at most
        mined = _mine(spark, rows, own, most, k)
        out = mined if out is None else out.unionByName(mined)
    return spark.createDataFrame([], _OUT) if out is None else out


def _most_norm(rows: DataFrame) -> float:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((_matrix(batch.column("v").to_pylist()) ** 2).sum(axis=1)).max())])], names=["n"])

    return rows.select("v").mapInArrow(run, "n double").agg(F.coalesce(F.max("n"), F.lit(0.0))).first()[0]


def _mine(spark, rows: DataFrame, own: pd.DataFrame, most: float, k: int) -> DataFrame:
    matrix = _matrix(own["v"].tolist())
    ids, labels = own["vec_id"].to_numpy(dtype=np.int64), own["label"].to_numpy(dtype=np.int64)
    norm = np.sqrt((matrix ** 2).sum(axis=1))
    windows = pd.DataFrame({"anchor": np.arange(len(own))})
    steps = [s * norm * most if s >= 0 else np.full(len(own), -np.inf) for s in STEPS]
    positives = _filled(rows, windows, steps, matrix, lambda w, i, lab, s: (lab == labels[w]) & (i != ids[w]), k)
    at = positives["w"].to_numpy(dtype=np.int64)
    top = positives["score"].to_numpy(dtype=np.int64)
    # 80 p <= 100 n, so the least n is the quotient rounded up; a negative p allows none.
    bands = [-((-p * top) // 100) for p in BANDS]
    fits = lambda w, i, lab, s: (lab != labels[at[w]]) & (100 * s <= HIGH * top[w]) & (LOW * top[w] <= 100 * s)
    negatives = _filled(rows, pd.DataFrame({"anchor": at}), bands, matrix, fits, k)
    w = negatives["w"].to_numpy(dtype=np.int64)
    out = pd.DataFrame({
        "anchor_id": ids[at[w]], "positive_id": positives["vec_id"].to_numpy(dtype=np.int64)[w], "rank": negatives["rank"].to_numpy(dtype=np.int32),
        "negative_id": negatives["vec_id"].to_numpy(dtype=np.int64), "positive_score": top[w], "negative_score": negatives["score"].to_numpy(dtype=np.int64)})
    return spark.createDataFrame(pa.Table.from_pandas(out, preserve_index=False), _OUT)


__all__ = ["hard_negatives"]
