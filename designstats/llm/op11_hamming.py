"""MinHash near-dedup by a multi-index Hamming join.

A text is the set of its distinct 2-word shingles. Its signature has ``POSITIONS`` values of ``BITS`` bits, each
the low bits of a minimum over the set; the distance of two signatures is the number of positions that differ.
The positions are cut into ``CHUNKS`` chunks. Two signatures at a distance of at most ``GUARANTEED``, which is
CHUNKS * (ERRORS + 1) - 1, have by the pigeonhole principle a chunk with ERRORS errors at most, so both are found
under a key of that chunk without the wrong positions: every chunk is entered once for each choice of
positions left out. At the similarity of 0.8 a distance beyond the guarantee has a chance of 3 in 10,000, and
even then a chunk is shared in all but one of ten million pairs.

Keys are not paired off. The set of a key that shares most keys with others, as the original of a group of copies
does, is its pivot, and every other is compared with it, by signature and then on the full sets. Where all sets
of a key are then in one component nothing is left to learn from it; this settles groups of copies of any size with
one comparison for each member and pivot. In the other keys the sets of different components meet, by signature and
then in full: in blocks, where the largest component of the key is dealt out and the rest is shown to each part.
A pair belongs to the first key that it shares, and only a star of the links found is written.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from designstats.llm.arrays import mix, seed
from designstats.llm.bytewords import WordHash, batches_of, split_words
from designstats.llm.common import stored
from designstats.llm.graph import components, int64s, may_hold, sized_filter
from designstats.llm.runs import Union, runs

#: Shares in percent: links have 100 * intersection >= PERCENT * union.
PERCENT = 80
CHUNKS, WIDTH, ERRORS = 12, 5, 1
POSITIONS, BITS = CHUNKS * WIDTH, 16
GUARANTEED = CHUNKS * (ERRORS + 1) - 1
#: Pairs that share a key are compared in full up to this distance; at 0.8 all but 3 in 10 million are within it.
REACH = 28
#: Bytes of text cut at once, and rows of one block of a large key.
SLICE, BLOCK = 1 << 20, 1024


def shingle_sets(texts: list[bytes], memo: WordHash):
    """Distinct 2-word shingles of every text, sorted, and where each text's begin. One word is a shingle of its own."""
    words = [split_words(t) for t in texts]
    count = np.array([len(w) for w in words], dtype=np.int64)
    of = np.concatenate([[0], np.cumsum(count)])
    h = memo.of([w for own in words for w in own])
    text = np.repeat(np.arange(len(texts)), count)
    pair = mix(mix(h[:-1]) + h[1:] * np.uint64(3)) if len(h) else h
    single = of[:-1][count == 1]
    keep = text[:-1] == text[1:]
    grams = np.concatenate([pair[keep], mix(h[single] ^ seed(1))])
    text = np.concatenate([text[:-1][keep], text[single]])
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    return grams[new], np.searchsorted(text[new], np.arange(len(texts) + 1))


def set_ids(grams: np.ndarray, of: np.ndarray) -> np.ndarray:
    """One hash for each set; 0 for an empty one."""
    out, full = np.zeros(len(of) - 1, dtype=np.uint64), np.diff(of) > 0
    if len(grams):
        out[full] = mix(np.add.reduceat(mix(grams), of[:-1][full]) + np.diff(of)[full].astype(np.uint64)) | np.uint64(1)
    return out


def signatures(grams: np.ndarray, of: np.ndarray) -> np.ndarray:
    """POSITIONS values of BITS bits for every set; one row per set."""
    out, full = np.zeros((len(of) - 1, POSITIONS), dtype=np.uint16), np.flatnonzero(np.diff(of) > 0)
    if not len(full):
        return out
    low, high = (grams & np.uint64(0xFFFFFFFF)).astype(np.uint32), (grams >> np.uint64(32)).astype(np.uint32)
    x, shifted = np.empty_like(low), np.empty_like(low)
    for k in range(POSITIONS):
        a, b = (int(seed(500 + 2 * k + i)) for i in (0, 1))
        np.multiply(low, np.uint32(a & 0xFFFFFFFF | 1), out=x)
        x ^= high
        np.right_shift(x, np.uint32(15), out=shifted)
        x ^= shifted
        x *= np.uint32(b & 0xFFFFFFFF | 1)
        np.right_shift(x, np.uint32(13), out=shifted)
        x ^= shifted
        x *= np.uint32(b >> 32 | 1)
        np.right_shift(x, np.uint32(16), out=shifted)
        x ^= shifted
        out[full, k] = (np.minimum.reduceat(x, of[full]) & np.uint32((1 << BITS) - 1)).astype(np.uint16)
    return out


#: The positions of each key, and for each chunk and wrong position (WIDTH: none) the first key that two signatures share.
SLOTS = [left for c in range(CHUNKS) for left in combinations(range(c * WIDTH, (c + 1) * WIDTH), WIDTH - ERRORS)]
_FIRST = np.array([[next(k for k, left in enumerate(SLOTS) if left[0] // WIDTH == c and c * WIDTH + w not in left) for w in range(WIDTH + 1)]
                   for c in range(CHUNKS)])


def first_slot(same: np.ndarray) -> np.ndarray:
    """The first key that pairs share, from the positions in which their signatures agree (one row per pair); -1 for none."""
    wrong = ~same.reshape(len(same), CHUNKS, WIDTH)
    errors = wrong.sum(axis=2)
    chunk = (errors <= ERRORS).argmax(axis=1)
    at = np.arange(len(same))
    place = np.where(errors[at, chunk] == 0, WIDTH, wrong[at, chunk].argmax(axis=1))
    return np.where(errors[at, chunk] <= ERRORS, _FIRST[chunk, place], -1)


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """Keys of every signature: for each chunk and each choice of ERRORS positions left out, one column."""
    out = []
    for n, left in enumerate(SLOTS):
        key = np.full(len(signature), seed(9000 + n), dtype=np.uint64)
        for k in left:
            key = mix(key * np.uint64(3) + signature[:, k].astype(np.uint64))
        out.append(key)
    return np.column_stack(out)


def _matrix(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.uint16).reshape(len(rows), POSITIONS)


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, copy (hash of the text), id (of the set), n_shingles and signature of every row."""

    def read(batches):
        memo = WordHash()
        for batch in batches:
            raw = batch.column("raw")
            for lo, hi in batches_of(raw, SLICE):
                grams, of = shingle_sets([t or b"" for t in raw.slice(lo, hi - lo).to_pylist()], memo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), batch.column("copy").slice(lo, hi - lo), int64s(set_ids(grams, of)),
                     pa.array(np.diff(of)), pa.array([r.tobytes() for r in signatures(grams, of)], pa.binary())],
                    names=["doc_id", "copy", "id", "n_shingles", "signature"])

    return docs.mapInArrow(read, "doc_id long, copy long, id long, n_shingles long, signature binary")


def _keyed(sets: DataFrame) -> DataFrame:
    """(key, slot, id) of every set under all its keys."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                keys = chunk_keys(_matrix(part.column("signature")))
                ids = part.column("id").to_numpy()
                slot = np.tile(np.arange(keys.shape[1], dtype=np.int16), len(ids))
                yield pa.RecordBatch.from_arrays(
                    [int64s(keys.ravel()), pa.array(slot), pa.array(np.repeat(ids, keys.shape[1]))], names=["key", "slot", "id"])

    return sets.select("id", "signature").mapInArrow(run, "key long, slot short, id long")


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose sizes and signatures allow a link."""
    side = lambda s: sets.select(F.col("id").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("signature").alias(f"s_{s}"))

    def run(batches):
        for batch in batches:
            near = (_matrix(batch.column("s_a")) != _matrix(batch.column("s_b"))).sum(axis=1) <= REACH if batch.num_rows else []
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    fits = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    return both.filter(fits).select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def _grams(docs: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, grams) of the wanted sets, cut again from one text of each; other texts are passed over by a filter."""
    copies = stored(sets.join(wanted, "id").select("id", "copy"), "copies")
    held = sized_filter(copies, "copy")

    def read(batches):
        memo = WordHash()
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(held, batch.column("copy").to_numpy())))
            raw = batch.column("raw")
            for lo, hi in batches_of(raw, SLICE):
                grams, of = shingle_sets(raw.slice(lo, hi - lo).to_pylist(), memo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("copy").slice(lo, hi - lo), int64s(set_ids(grams, of)),
                     pa.array([grams[a:b].tobytes() for a, b in zip(of[:-1].tolist(), of[1:].tolist())], pa.binary())], names=["copy", "id", "grams"])

    found = docs.filter("raw is not null").select("raw", "copy").mapInArrow(read, "copy long, id long, grams binary")
    return found.join(copies, ["id", "copy"], "left_semi").dropDuplicates(["id"]).select("id", "grams")


def overlap(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are linked."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if 100 * len(small) < PERCENT * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _set(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=np.uint64)


def _linked(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) that are linked on their full sets."""
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    grams = stored(_grams(docs, sets, wanted), "grams")

    def run(batches):
        for batch in batches:
            keep = [overlap(_set(a), _set(b)) for a, b in zip(batch.column("g_a"), batch.column("g_b"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda s: grams.select(F.col("id").alias(s), F.col("grams").alias(f"g_{s}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "g_a", "g_b").mapInArrow(run, "a long, b long")


def _cells(rows: DataFrame) -> DataFrame:
    """cell and side of the rows of mixed keys (key, slot, id, root, signature), so that sets of different components meet.

    The largest component of a key (side 1) is dealt to parts, and the others (side 0) are shown to every part. The others
    also meet among themselves, part by part: under (p, p) all of a part (side -1), under (p, q) the sides 2 and 3.
    """
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / (BLOCK // 2))).cast("int")
    size = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    size = size.groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all"))
    size = stored(size.select("key", F.col("most.root").alias("main"), parts(F.col("most.n")).alias("dealt"), parts(F.col("all") - F.col("most.n")).alias("rest")), "sizes")
    cut = rows.join(size, "key")
    part = lambda n: F.pmod(F.xxhash64("id", "key"), F.col(n)).cast("int")
    main = F.col("root") == F.col("main")
    cell = lambda kind, *of: F.xxhash64("key", F.lit(kind), *of)
    named = ["slot", "id", "root", "signature"]
    dealt = cut.filter(main).select(cell(1, part("dealt")).alias("cell"), F.lit(1).alias("side"), *named)
    shown = cut.filter(~main).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("dealt") - 1))).select(
        cell(1, F.col("to")).alias("cell"), F.lit(0).alias("side"), *named)
    own = cut.filter(~main).withColumn("part", part("rest")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rest") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    side = F.when(low == high, F.lit(-1)).otherwise(F.expr("IF(part < other, 2, 3)"))
    return dealt.unionByName(shown).unionByName(own.select(cell(2, low, high).alias("cell"), side.alias("side"), *named))


def _partners(i: int, side: np.ndarray, root: np.ndarray, signature: np.ndarray, slot: int) -> np.ndarray:
    """Later rows of a cell that row i meets there first: of another component and side, and within reach."""
    found = np.flatnonzero((root[i + 1:] != root[i]) & ((side[i] < 0) | (side[i + 1:] != side[i]))) + i + 1
    if len(found):
        same = signature[found] == signature[i]
        near = same.sum(axis=1) >= POSITIONS - REACH
        found, same = found[near], same[near]
        found = found[first_slot(same) == slot] if len(found) else found
    return found


def _cell_table(table):
    side, root = table.column("side").to_numpy(), table.column("root").to_numpy()
    return side, root, _matrix(table.column("signature")), table.column("slot")[0].as_py()


def _meeting(batches):
    """The rows of a cell that have a partner in it."""
    for table, _ in runs(batches, "cell", 1 << 30):
        side, root, signature, slot = _cell_table(table)
        hit = np.zeros(len(root), dtype=bool)
        for i in range(len(root) - 1):
            if len(found := _partners(i, side, root, signature, slot)):
                hit[i] = hit[found] = True
        if hit.any():
            yield from table.filter(pa.array(hit)).combine_chunks().to_batches()


def _stars(batches):
    """A star for the linked sets of a cell; sets already joined there are not compared again."""
    for table, _ in runs(batches, "cell", 1 << 30):
        side, root, signature, slot = _cell_table(table)
        ids, grams = table.column("id").to_numpy(), [_set(g) for g in table.column("grams")]
        groups = Union(len(ids))
        first: dict[int, int] = {}
        for i, r in enumerate(root.tolist()):
            groups.join(i, first.setdefault(r, i))  # known to be of one component
        joined = []
        for i in range(len(ids) - 1):
            for j in _partners(i, side, root, signature, slot).tolist():
                if groups.root(i) != groups.root(j) and overlap(grams[i], grams[j]):
                    groups.join(i, j)
                    joined.append((ids[i], ids[j]))
        if joined:
            a, b = zip(*joined)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _across(rows: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components that share a key."""
    by_cell = lambda df: df.repartition("cell").sortWithinPartitions("cell")
    columns = "cell long, side int, slot short, id long, root long, signature binary"
    met = stored(by_cell(_cells(rows)).mapInArrow(_meeting, columns), "met")
    wanted = stored(met.select("id").distinct(), "wanted")
    grams = stored(_grams(docs, sets, wanted), "grams")
    return by_cell(met.join(grams, "id")).mapInArrow(_stars, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id of the rows that links lead to; a text without words has no links and keeps
    its own id. Equal sets are linked, so rows that repeat one another share a component, and all rows with its id are
    kept. A null text is empty. A row with a null id is never kept; its component_id is null where all ids of the
    component are. Long texts are taken whole; other columns of docs are not read; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw")).withColumn("copy", F.xxhash64("raw"))
    signed = stored(_signed(docs), "signed")
    sets = stored(signed.filter("id <> 0").groupBy("id").agg(
        F.min("doc_id").alias("doc_id"), F.min("copy").alias("copy"), F.first("n_shingles").alias("n_shingles"),
        F.first("signature").alias("signature")), "sets")

    sizes = stored(_keyed(sets).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "keys")
    shared = stored(_keyed(sets).join(sizes, "key"), "shared")
    degree = shared.groupBy("id").agg(F.sum("n").alias("degree"))
    pivots = stored(shared.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", "id")).alias("p")).select("key", F.col("p.id").alias("pivot")), "pivots")
    members = stored(shared.select("key", "slot", "id").join(pivots, "key").filter("id <> pivot"), "members")
    stars = members.select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")).distinct()
    links = stored(_linked(stored(_near(stars, sets), "near"), docs, sets), "links")
    groups = stored(components(links), "groups")

    # Keys whose sets are in more than one component: sets of two components may still be linked.
    rooted = members.select("key", "slot", "id").join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    rooted = stored(rooted, "rooted")
    mixed = stored(rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key"), "mixed")
    rows = stored(rooted.join(mixed, "key").join(sets.select("id", "signature"), "id"), "rows")
    more = stored(_across(rows, docs, sets), "links")
    if not more.isEmpty():
        groups = stored(components(links.unionByName(more)), "groups")

    own = sets.select("id", "doc_id").join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = own.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = own.join(least, "root").select("id", "component_id")
    out = signed.select("doc_id", "id", "n_shingles").join(named, "id", "left")
    component = F.when(F.col("id") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


__all__ = ["near_duplicates"]
