"""Sharding as vector bin packing: bytes, tokens and rows are balanced jointly.

Equal texts form a group and stay together. A group is a vector of its shares of all bytes, tokens and
rows; it goes to the shard whose residual capacity has the largest dot product with it. Groups with a
large share (their number is bounded by the share) are placed first, on the driver; the others in cells of
bounded size, each of which gets its part of the capacity that is left. A group larger than a shard
is cut into as few pieces as fit, by a hash of the document id, because it cannot fit whole.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from designstats.llm.common import fold, parts_of, stored, totals_before

#: A group with this share of a shard, in any dimension, is placed on the driver: at most 3 * shards * this many.
LARGE = 32
#: Groups in one cell.
CELL = 1 << 16
DIMS = ("bytes", "tokens", "n")


def place(items: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Shard of every item, largest first; the residual capacity is used up.

    The dot product decides among the shards that the item fits in; where it fits in none, among all.
    """
    out = np.zeros(len(items), dtype=np.int64)
    for i in np.argsort(-items.max(axis=1), kind="stable"):
        v = items[i]
        score = residual @ v
        fits = (residual >= v).all(axis=1)
        k = int(np.argmax(np.where(fits, score, -np.inf))) if fits.any() else int(np.argmax(score))
        residual[k] -= v
        out[i] = k
    return out


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the group's key, for every row.

    A null text is a group of its own with size 8 and crc32 0; a null doc_id is kept; repeated rows
    are placed as often as they come; an empty table gives no rows. Slots follow (hash cell, doc_id).
    """
    text = F.col("text")
    spaces = F.length(text) - F.length(F.translate(text, " \n\t\r", ""))
    rows = stored(docs.select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.coalesce(F.md5(text), F.lit("")).alias("key"),
        F.coalesce(spaces + 1, F.lit(0)).cast("long").alias("words"),
    ), "sizes")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.sum("words").alias("tokens"), F.count("*").alias("n"))
    total = rows.agg(F.sum("size"), F.sum("words"), F.count("*")).first()
    scale = [float(x or 1) for x in total]
    n_rows = total[2]
    large = F.lit(False)
    for d, s in zip(DIMS, scale):
        large = large | (F.col(d) > s / (shards * LARGE))
    groups = groups.withColumn("large", large)
    head = groups.filter("large").collect()  # at most 3 * shards * LARGE rows
    residual = np.full((shards, len(DIMS)), 1.0 / shards)
    pieces = [max(1, int(np.ceil(max(r[d] / s for d, s in zip(DIMS, scale)) * shards))) for r in head]
    vectors = np.array([[r[d] / s / p for d, s in zip(DIMS, scale)] for r, p in zip(head, pieces) for _ in range(p)])
    placed = place(vectors.reshape(-1, len(DIMS)), residual) if head else []
    first = np.cumsum([0, *pieces])
    left = np.array([[1.0 - sum(r[d] for r in head) / s for d, s in zip(DIMS, scale)]])
    cells = parts_of(n_rows, CELL)

    def pack(_, t):
        items = np.column_stack([np.asarray(t.column(d), dtype=float) / s for d, s in zip(DIMS, scale)])
        own = items.sum(axis=0) / np.maximum(left[0], 1e-300)
        return pa.table({"key": t.column("key"), "shard": place(items, np.maximum(residual, 0) * own).astype(np.int32)})

    small = groups.filter("not large").withColumn("cell", fold(F.col("key"), cells)).groupBy("cell").applyInArrow(
        pack, "key string, shard int")
    spark = docs.sparkSession
    spread = spark.createDataFrame(
        [(r["key"], p, [int(x) for x in placed[a:a + p]]) for r, p, a in zip(head, pieces, first)],
        "key string, pieces int, shards array<int>")
    at = F.get("shards", F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("int"))
    named = rows.join(F.broadcast(spread), "key", "left")  # as many rows as the driver held
    whole = named.filter("shards is null").drop("pieces", "shards").join(small, "key")
    cut = named.filter("shards is not null").withColumn("shard", at).drop("pieces", "shards")
    out = whole.select(*cut.columns).unionByName(cut).withColumn(
        "cell", F.pmod(F.xxhash64("doc_id", "key"), F.lit(parts_of(n_rows, 8 * CELL))))
    return totals_before(out, "cell", ["doc_id", "key"], F.lit(1), "slot", within=["shard"]).drop("cell", "words")
