"""N-gram Jaccard join by chosen paths.

A text is the set of its ``GRAM``-word shingles. Sets walk down trees: at a node, ``BRANCHES`` coordinates of a
min-hash sketch are sampled and every set goes on to the child named by its value there, so similar sets stay
together. A node with at most ``SMALL`` sets is compared by brute force, a larger one splits again; one
that is still large at ``DEPTH`` holds near copies and is compared block by block, so nothing is dropped. Trees
are repeated until a pair at the threshold is met with probability ``recall``.

Pairs met in several nodes belong to the smallest of them (the blocks of one node count as that node, since a pair
meets in one of them only), and their Jaccard similarity is computed on the whole
sets. Links are counted there, not written out: n near copies have n * n / 2 of them.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from designstats.llm.arrays import mix, seed, slices, trimmed, windows, words
from designstats.llm.common import plain_names, stored
from designstats.llm.graph import components, int64s, key_filter, passes
from designstats.llm.runs import Union, runs

GRAM, THRESHOLD, RECALL = 5, 0.8, 0.9999
BRANCHES, SMALL, DEPTH = 2, 4096, 4
#: Coordinates of a sketch. A pair is compared in full if at least ``AGREE`` of them are equal; at the threshold
#: all but one pair in a million have so many.
SKETCH, AGREE = 32, 14


def trees(threshold: float = THRESHOLD, recall: float = RECALL, branches: int = BRANCHES) -> int:
    """Trees after which a pair at the threshold is met with the wanted probability.

    Below any node the pair parts for good with probability q = (1 - t + t * q) ** branches.
    """
    q = 0.0
    for _ in range(1000):
        q = (1 - threshold + threshold * q) ** branches
    return max(1, math.ceil(math.log(1 - recall) / math.log(q)))


def shingles(texts: list[str], gram: int = GRAM):
    """Distinct shingle hashes of every text, sorted, and where each text's begin. Fewer words than a shingle: one, of all."""
    word, of = words(texts)
    h, to = windows(word, of, gram)
    text = np.repeat(np.arange(len(texts)), np.diff(to))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(texts) + 1))


def set_ids(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """One hash for each set; 0 for an empty one."""
    out, full = np.zeros(len(of) - 1, dtype=np.uint64), np.diff(of) > 0
    if len(h):
        out[full] = mix(np.add.reduceat(mix(h), of[:-1][full]) + np.diff(of)[full].astype(np.uint64)) | np.uint64(1)
    return out


def sketches(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The least of SKETCH hashes over every set, one row per set."""
    out, full = np.zeros((len(of) - 1, SKETCH), dtype=np.uint64), np.flatnonzero(np.diff(of) > 0)
    for k in range(SKETCH if len(full) else 0):
        out[full, k] = np.minimum.reduceat(mix(h ^ seed(k)), of[full])
    return out


def _children(node: np.ndarray, sketch: np.ndarray, depth: int) -> np.ndarray:
    """Child nodes of sets at nodes: one column for each sampled coordinate."""
    start = mix(node + np.uint64(depth)) % np.uint64(SKETCH)
    step = mix(node ^ seed(depth + 99)) % np.uint64(SKETCH // 2) * np.uint64(2) + np.uint64(1)
    out = []
    for b in range(BRANCHES):
        k = (start + np.uint64(b) * step) % np.uint64(SKETCH)
        out.append(mix(mix(node + seed(b + 7)) ^ sketch[np.arange(len(node)), k.astype(np.int64)]))
    return np.column_stack(out)


def _matrix(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.uint64).reshape(len(rows), -1)


def _candidates(sketch: np.ndarray, i: int) -> np.ndarray:
    """Later rows whose sketches agree with row i in enough coordinates."""
    return np.flatnonzero((sketch[i + 1:] == sketch[i]).sum(axis=1) >= AGREE) + i + 1


_NODE = "node long, id long, sketch binary, place int"


def _node_rows(node, ids, sketch_rows, place):
    n = len(node)
    place = np.full(n, place, dtype=np.int32) if np.isscalar(place) else place.astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [int64s(node), ids, sketch_rows, pa.array(place, pa.int32())], names=["node", "id", "sketch", "place"])


#: What becomes of a row: it waits in a leaf, goes on in a tree, or belongs to a node of near copies.
LEAF, SPLIT, DENSE = -1, -2, -3


def _walk(depth: int):
    def run(batches):
        for table, whole in runs(batches, "node", SMALL):
            if whole and table.num_rows < 2:
                continue
            sketch, node = _matrix(table.column("sketch")), table.column("node").to_numpy().view(np.uint64)
            ids, rows = table.column("id").combine_chunks(), table.column("sketch").combine_chunks()
            if whole:
                near = np.zeros(len(sketch), dtype=bool)
                for i in range(len(sketch) - 1):
                    if len(found := _candidates(sketch, i)):
                        near[i] = near[found] = True
                if near.any():
                    at = pa.array(np.flatnonzero(near))
                    yield _node_rows(node[near], ids.take(at), rows.take(at), LEAF)
            elif depth >= DEPTH:
                yield _node_rows(node, ids, rows, DENSE)
            else:
                for child in _children(node, sketch, depth).T:
                    yield _node_rows(child, ids, rows, SPLIT)

    return run


def _leaf_matrix(column) -> np.ndarray:
    """The leaves of every row, filled up with the largest number, which no leaf in question has."""
    rows = column.to_pylist()
    out = np.full((len(rows), max(map(len, rows))), np.iinfo(np.int64).max)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _owned(base: int, leaves: np.ndarray, i: int, found: np.ndarray) -> np.ndarray:
    """Those partners of row i that first meet it in this node; for a pair of blocks, base is the node they are of."""
    own = leaves[i][leaves[i] < base]
    return found[~(leaves[found][:, :, None] == own).any(axis=(1, 2))] if len(own) else found


def _members(batches):
    """The rows of a node that have a pair of their own in it."""
    for table, _ in runs(batches, "node", 1 << 30):
        sketch, near = _matrix(table.column("sketch")), np.zeros(table.num_rows, dtype=bool)
        node, base, half = table.column("node")[0].as_py(), table.column("base")[0].as_py(), table.column("place").to_numpy()
        leaves = _leaf_matrix(table.column("leaves"))
        for i in range(len(sketch) - 1):
            found = _candidates(sketch, i)
            found = _owned(base, leaves, i, found[_may_meet(half, i, found)]) if len(found) else found
            if len(found):
                near[i] = near[found] = True
        if near.any():
            at = np.flatnonzero(near)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), node)), pa.array(np.full(len(at), base)), table.column("id").combine_chunks().take(pa.array(at)),
                 pa.array(half[at], pa.int32())], names=["node", "base", "id", "place"])


def _may_meet(half, i, found):
    """In a pair of blocks (places 0 and 1) only rows of different blocks meet; elsewhere all do."""
    return (half[found] != half[i]) | (half[i] < 0)


def _linked(threshold: float):
    def run(batches):
        for table, _ in runs(batches, "node", 1 << 30):
            base, ids = table.column("base")[0].as_py(), table.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, half, weight = ids[order], table.column("place").to_numpy()[order], table.column("n_texts").to_numpy()[order]
            sketch = _matrix(table.column("sketch"))[order]
            leaves, raw = _leaf_matrix(table.column("leaves"))[order], table.column("grams").to_pylist()
            sets = [np.frombuffer(raw[k], dtype=np.uint64) for k in order]
            size = np.array([len(s) for s in sets])
            all_grams, at = np.unique(np.concatenate(sets), return_inverse=True)
            of = np.concatenate([[0], np.cumsum(size)])
            mark, groups, links = np.zeros(len(all_grams), dtype=np.int32), Union(len(ids)), np.zeros(len(ids), dtype=np.int64)
            for i in range(len(ids) - 1):
                found = _candidates(sketch, i)
                found = found[_may_meet(half, i, found)]
                found = found[np.minimum(size[found], size[i]) >= threshold * np.maximum(size[found], size[i]) - 1e-9]
                found = _owned(base, leaves, i, found) if len(found) else found
                if not len(found):
                    continue
                mark[at[of[i]:of[i + 1]]] = 1
                if len(found) > 16:
                    both = np.add.reduceat(mark[at[of[i + 1]:]], of[i + 1:-1] - of[i + 1])[found - i - 1]
                else:
                    both = np.array([mark[at[of[j]:of[j + 1]]].sum() for j in found.tolist()])
                mark[at[of[i]:of[i + 1]]] = 0
                for j in found[both >= threshold * (size[found] + size[i] - both) - 1e-9].tolist():
                    links[i] += weight[j]
                    links[j] += weight[i]
                    groups.join(i, j)
            own = np.flatnonzero(links)
            if len(own):
                roots = np.array([groups.root(i) for i in own.tolist()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[own]), pa.array(ids[roots]), pa.array(links[own])], names=["id", "root", "links"])

    return run


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, class_id, n_links, n_texts.

    class_id is the smallest doc_id of the connected group; n_links counts the different texts at or above
    the threshold; n_texts the different texts with the same shingles. Equal texts are one class. Null texts
    are empty; texts without words are linked to equal texts only; a null id is kept and is no class_id unless
    all ids of the class are null; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "text_hash", F.xxhash64("text"))

    def read(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in slices(texts):
                h, of = shingles(texts[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), batch.column("text_hash").slice(lo, hi - lo), int64s(set_ids(h, of)),
                     pa.array([r.tobytes() for r in sketches(h, of)], pa.binary())], names=["doc_id", "text_hash", "id", "sketch"])

    signed = stored(rows.mapInArrow(trimmed(read), "doc_id long, text_hash long, id long, sketch binary"), "signed")
    # A text without words is a set of its own.
    named = signed.withColumn("own", F.when(F.col("id") == 0, F.col("text_hash")).otherwise(F.col("id")))
    texts = named.groupBy("own", "id", "text_hash").agg(F.min("doc_id").alias("doc_id"))
    sets = stored(texts.groupBy("own", "id").agg(F.count("*").alias("n_texts"), F.min("doc_id").alias("doc_id")), "sets")

    links = linked_sets(rows, signed, sets, threshold, recall)
    totals = links.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(links, "id", "root").withColumnRenamed("node", "own")
    per_set = sets.join(totals.withColumnRenamed("id", "own"), "own", "left").join(groups, "own", "left")
    per_set = stored(per_set.select(
        "own", F.coalesce("root", "own").alias("root"), "n_texts", "doc_id",
        F.when(F.col("id") == 0, F.lit(0)).otherwise(F.col("n_texts") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links")), "per_set")
    least = per_set.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    answer = per_set.join(least, "root").select("own", "class_id", F.col("root").alias("class_key"), "n_links", "n_texts")
    return named.select("doc_id", "text_hash", "own").join(answer, "own").drop("own")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of docs, one for each class: that with the smallest (doc_id, text hash); null ids come last.

    Texts without words are one class for each such text. Of rows that repeat one another, one stays. All columns stay,
    whatever their names.
    """
    docs, back = plain_names(docs, ("doc_id", "text"))
    classes = jaccard_classes(docs.select("doc_id", "text"), threshold, recall)
    ahead = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")
    first = stored(classes.groupBy("class_key").agg(F.min(ahead).alias("k")).select(
        F.col("k.doc_id").alias("_first_doc"), F.col("k.text_hash").alias("_first_text")), "firsts")
    same = F.col("_id").eqNullSafe(F.col("_first_doc")) & (F.col("_text") == F.col("_first_text"))
    keyed = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_text": F.xxhash64(F.coalesce("text", F.lit("")))})
    return keyed.join(first, same, "left_semi").dropDuplicates(["_id", "_text"]).select(*back)


def linked_sets(rows: DataFrame, signed: DataFrame, sets: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(id, root, links): sets of a node joined to its smallest alike set, and how many texts each is linked to there."""
    n_roots = trees(threshold, recall) * BRANCHES

    def plant(batches):
        for batch in batches:
            sketch, ids, binary = _matrix(batch.column("sketch")), batch.column("id"), batch.column("sketch")
            for k in range(n_roots):  # the trees begin at coordinates of their own
                yield _node_rows(mix(sketch[:, k % SKETCH] ^ seed(1000 + k)), ids, binary, SPLIT)

    first = signed.filter("id <> 0").dropDuplicates(["id"]).select("id", "sketch")
    level, leaves = first.mapInArrow(trimmed(plant), _NODE), None
    for depth in range(1, DEPTH + 1):
        done = stored(level.repartition("node").sortWithinPartitions("node").mapInArrow(trimmed(_walk(depth)), _NODE), "walk")
        own = done.filter(F.col("place") == LEAF).withColumn("base", F.col("node"))
        leaves = own if leaves is None else leaves.unionByName(own)
        level = done.filter(F.col("place") == SPLIT)
        if depth == DEPTH or level.isEmpty():
            leaves = leaves.unionByName(_blocks(done.filter(F.col("place") == DENSE)))
            break
    leaves = stored(leaves, "leaves")
    mine = leaves.groupBy("id").agg(F.sort_array(F.collect_set("base")).alias("leaves"))  # a few for each tree
    placed = leaves.join(mine, "id")
    members = stored(placed.repartition("node").sortWithinPartitions("node").mapInArrow(trimmed(_members), "node long, base long, id long, place int"), "members")
    wanted = members.select("id").distinct()
    bits = key_filter(wanted, "id")

    def fetch(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in slices(texts):
                h, of = shingles(texts[lo:hi])
                ids = set_ids(h, of)
                own = np.flatnonzero(passes(bits, ids) & (ids != 0))
                if len(own):
                    yield pa.RecordBatch.from_arrays(
                        [int64s(ids[own]), pa.array([h[of[i]:of[i + 1]].tobytes() for i in own], pa.binary())], names=["id", "grams"])

    grams = rows.mapInArrow(trimmed(fetch), "id long, grams binary").dropDuplicates(["id"]).join(wanted, "id", "left_semi")
    grams = stored(grams.join(sets.select("id", "n_texts"), "id"), "grams")
    full = members.join(grams, "id").join(mine, "id").join(first, "id")
    return stored(full.repartition("node").sortWithinPartitions("node").mapInArrow(trimmed(_linked(threshold)), "id long, root long, links long"), "links")


def _blocks(dense: DataFrame) -> DataFrame:
    """Rows of large nodes for every pair of blocks of their node, the base; place says which of the two a row is in."""
    size = dense.groupBy("node").count().withColumn("parts", F.ceil(F.col("count") / (SMALL // 2)).cast("int"))
    cut = dense.join(size.select("node", "parts"), "node").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    pairs = cut.select("node", "id", "sketch", "part", other)
    low, high = F.least("part", "other"), F.greatest("part", "other")
    place = F.when(low == high, F.lit(LEAF)).otherwise(F.expr("int(part > other)"))
    return pairs.select(F.xxhash64("node", low, high).alias("node"), "id", "sketch", place.cast("int").alias("place"), F.col("node").alias("base"))


__all__ = ["jaccard_classes", "keep_one", "linked_sets", "trees"]
