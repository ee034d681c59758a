"""Connected components of an edge table, and filters of a fixed size for large joins."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from designstats.llm.common import stored

#: Bits of a filter; it weighs 1 MB whatever the input.
FILTER_BITS = 1 << 23


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with an edge: root is the smallest node of the component.

    Large-star and small-star steps in turn until the table stays as it is; each round is a stored table.
    """
    now = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.*").filter("u <> v").distinct()
        now = stored(small, "edges")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def key_filter(keys: DataFrame, key: str) -> np.ndarray:
    """A bit for every key (its value modulo FILTER_BITS): no key is missed, some others pass."""
    at = F.pmod(F.col(key), F.lit(FILTER_BITS))
    bits = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / 32768).alias("part")).agg(
        F.bitmap_construct_agg(F.pmod("at", F.lit(32768))).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in bits.collect():  # FILTER_BITS / 32768 rows at most
        own = np.frombuffer(r["bits"], dtype=np.uint8)
        out[r["part"] * 4096:(r["part"] + 1) * 4096] = own
    return out


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys may be in the filter; keys are taken as signed."""
    at = keys.astype(np.int64) % FILTER_BITS
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


#: Bits for each key of a sized filter, and the most it may have (32 MB); a fuller filter passes more keys and loses none.
BITS_EACH, MOST_BITS = 12, 1 << 28


def sized_filter(keys: DataFrame, key: str) -> np.ndarray:
    """Bits of a Bloom filter with two hashes, sized by the number of keys; keys must be well mixed 64-bit numbers."""
    n = keys.count()
    bits = 1 << max(16, min(MOST_BITS.bit_length() - 1, int(n * BITS_EACH).bit_length()))
    spots = F.array(F.col(key).bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(F.col(key), 24).bitwiseAND(F.lit(bits - 1)))
    at = keys.select(F.explode(spots).alias("at"))
    words = at.groupBy(F.shiftright("at", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("bits"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in words.toLocalIterator():  # 4 KB a row, MOST_BITS / 32768 rows at most
        out[r["part"] * 4096:(r["part"] + 1) * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys may be in the sized filter."""
    keys, top = keys.view(np.uint64), np.uint64(len(bits) * 8 - 1)
    found = np.ones(len(keys), dtype=bool)
    for at in (keys & top, keys >> np.uint64(24) & top):
        found &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def int64s(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))

