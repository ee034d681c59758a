"""Ranked lexical search by presence masks.

All texts are cut once; of every document only the terms of the items are kept. An item's documents are then
grouped by the mask of the terms they hold: each term's bitmap sets one bit, and documents with equal masks share one
bound, the sum of what their terms can give at most. Masks are evaluated by falling bound, and an item is
finished when the next bound is below the score of its last place. A task carries the places from one lot of
documents to the next, so later lots are mostly settled by their bounds; the tasks' places are merged at the end.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from designstats.llm.bytewords import batches_of
from designstats.llm.common import stored, totals_before

TOP = 20
#: Bytes of text cut at once; bytes of item texts that one pass serves; postings and documents worked on at once.
SLICE, BLOCK, LOT = 1 << 20, 1 << 22, (1 << 20, 8192)
#: Documents scored at once for one item.
SCORED = 64

#: Bytes that are no part of a term become blanks; A-Z become a-z.
FOLD = bytearray(range(256))
for _c in range(128):
    if not (48 <= _c <= 57 or 65 <= _c <= 90 or 97 <= _c <= 122):
        FOLD[_c] = 32
    elif 65 <= _c <= 90:
        FOLD[_c] = _c + 32
FOLD = bytes(FOLD)


def terms(raw: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all bytes beyond ASCII, A-Z in lower case."""
    return raw.translate(FOLD).split()


def weight(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)


class Items:
    """The items of a block: their distinct terms, and which of them (how often) each item holds."""

    def __init__(self, texts: list[bytes]):
        self.number: dict[bytes, int] = {}
        self.terms, self.times = [], []
        for t in texts:
            own: dict[int, int] = {}
            for w in terms(t):
                k = self.number.setdefault(w, len(self.number))
                own[k] = own.get(k, 0) + 1
            self.terms.append(np.fromiter(own.keys(), dtype=np.int64, count=len(own)))
            self.times.append(np.fromiter(own.values(), dtype=np.int64, count=len(own)))


def _counted(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), and the known terms and how often each occurs, as unsigned 32-bit numbers in bytes."""
    unknown = len(number)

    def run(batches):
        for batch in batches:
            raw = batch.column("raw")
            for lo, hi in batches_of(raw, SLICE):
                words = [terms(t or b"") for t in raw.slice(lo, hi - lo).to_pylist()]
                n = np.array([len(w) for w in words], dtype=np.int64)
                code = np.fromiter((number.get(w, unknown) for own in words for w in own), dtype=np.int64, count=int(n.sum()))
                doc = np.repeat(np.arange(len(words)), n)[code < unknown]
                key, tf = np.unique(doc * unknown + code[code < unknown], return_counts=True)
                of = np.searchsorted(key, np.arange(len(words) + 1) * unknown)
                code, tf = (key % max(unknown, 1)).astype(np.uint32), tf.astype(np.uint32)
                spans = list(zip(of[:-1].tolist(), of[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(n)] + [
                        pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (code, tf)], names=["doc_id", "n", "terms", "tf"])

    return docs.mapInArrow(run, "doc_id long, n long, terms binary, tf binary")


def _document_counts(counted: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each term of the block occurs; a sum for each task and term."""

    def run(batches):
        df = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            if codes := b"".join(batch.column("terms").to_pylist()):
                df += np.bincount(np.frombuffer(codes, dtype=np.uint32), minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])

    out = np.zeros(n_terms, dtype=np.int64)
    for r in counted.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]  # one row for each term of the block
    return out


class Places:
    """The best documents of one item so far, by falling score and rising id; null ids come last."""

    def __init__(self, top: int):
        self.top, self.score, self.id = top, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def least(self) -> int:
        """What a document must reach to be placed."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score, ids):
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score))
        order = order[score[order] > 0][:self.top]
        self.score, self.id = score[order], ids[order]


def _masks(term_rows: list[np.ndarray], n_docs: int):
    """The documents in an order that brings equal masks together, and where each group begins."""
    words = np.zeros((max(1, -(-len(term_rows) // 64)), n_docs), dtype=np.uint64)
    for j, rows in enumerate(term_rows):
        words[j // 64, rows] |= np.uint64(1 << j % 64)
    order = np.argsort(words[0], kind="stable") if len(words) == 1 else np.lexsort(words)
    ranked = words[:, order]
    new = np.append(True, (ranked[:, 1:] != ranked[:, :-1]).any(axis=0))
    return order, np.flatnonzero(new)


def search_lot(items: Items, weights: np.ndarray, places: list[Places], ids: np.ndarray, of: np.ndarray, code: np.ndarray, impact: np.ndarray):
    """Places the documents of one lot. of: where each document's postings begin; impact: of each posting."""
    n_docs, n_terms = len(ids), len(weights)
    doc = np.repeat(np.arange(n_docs), np.diff(of))
    by_term = np.argsort(code, kind="stable")
    begin = np.searchsorted(code[by_term], np.arange(n_terms + 1))
    most = np.zeros(n_terms, dtype=np.int64)
    np.maximum.at(most, code, impact)
    gain = np.zeros(n_terms, dtype=np.int64)
    for own, times, best in zip(items.terms, items.times, places):
        own_gain = times * weights[own]
        held = [doc[by_term[begin[t]:begin[t + 1]]] for t in own.tolist()]
        bound = np.zeros(n_docs, dtype=np.int64)
        for rows, most_of_term in zip(held, (own_gain * most[own]).tolist()):
            bound[rows] += most_of_term
        live = np.flatnonzero(bound >= best.least())
        if not len(live):
            continue
        at = np.full(n_docs, -1, dtype=np.int64)
        at[live] = np.arange(len(live))
        order, group = _masks([(x := at[rows])[x >= 0] for rows in held], len(live))
        size, group_bound = np.diff(np.append(group, len(order))), bound[live[order[group]]]
        gain[own] = own_gain
        ahead = np.argsort(-group_bound, kind="stable")
        size, group, group_bound = size[ahead], group[ahead], group_bound[ahead]
        lo = 0
        while lo < len(group) and group_bound[lo] >= best.least():
            hi = lo + 1 + int(np.searchsorted(np.cumsum(size[lo + 1:]), SCORED))
            hi = lo + int(np.searchsorted(-group_bound[lo:hi], -best.least(), side="right"))
            docs = live[order[np.concatenate([np.arange(g, g + s) for g, s in zip(group[lo:hi].tolist(), size[lo:hi].tolist())])]]
            count = of[docs + 1] - of[docs]
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(of[docs], count)
            score = np.add.reduceat(gain[code[inner]] * impact[inner], np.cumsum(count) - count)  # every document here has postings
            best.add(score, ids[docs])
            lo = hi
        gain[own] = 0


def _lots(batches):
    """Batches joined to lots of a bounded number of documents and postings."""
    held, rows, size = [], 0, 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            held.append(part)
            rows, size = rows + part.num_rows, size + part.column("terms").nbytes // 4
            if rows >= LOT[1] or size >= LOT[0]:
                yield pa.Table.from_batches(held)
                held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


#: What stands for a null id: it comes after all others.
NO_ID = np.iinfo(np.int64).max


def _search(counted: DataFrame, items: Items, weights: np.ndarray, n_docs: int, n_all: int, top: int) -> DataFrame:
    """(item, doc_id, score): each task's places of every item of the block."""

    def run(batches):
        places = [Places(top) for _ in items.terms]
        for lot in _lots(batches):
            raw = lot.column("terms").to_pylist()
            of = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int64)
            code = np.frombuffer(b"".join(raw), dtype=np.uint32).astype(np.int64)
            tf = np.frombuffer(b"".join(lot.column("tf").to_pylist()), dtype=np.uint32).astype(np.int64)
            m = 75 + np.array([25 * n * n_docs // n_all for n in lot.column("n").to_pylist()], dtype=np.int64)
            impact = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, np.diff(of)))
            ids = lot.column("doc_id").combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)
            search_lot(items, weights, places, ids, of, code, impact)
        item = np.repeat(np.arange(len(places)), [len(p.id) for p in places])
        if len(item):
            yield pa.RecordBatch.from_arrays(
                [pa.array(item), pa.array(np.concatenate([p.id for p in places])), pa.array(np.concatenate([p.score for p in places]))],
                names=["item", "doc_id", "score"])

    return counted.mapInArrow(run, "item long, doc_id long, score long")


_OUT = "item_id long, rank int, doc_id long, score long"


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` documents of every item: item_id, rank (from 1), doc_id and score, as far as scores are above 0.

    Equal scores come in the order of doc_id, null ids last; rows that repeat a doc_id are documents of their own, all
    counted and placed. A null or empty text has no terms: as a document it is not counted, as an item it finds nothing.
    Rows that repeat an item_id, null or not, are items of their own, and each gives its ranks. Long texts are taken
    whole; other columns are not read; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"))
    cells = items.withColumn("cell", F.pmod(F.xxhash64("item_id", "raw"), F.lit(1024)))
    placed = totals_before(cells, "cell", ["item_id", "raw"], F.octet_length("raw") + 64, "at")
    blocks = stored(placed.select("item_id", "raw", F.expr(f"at div {BLOCK}").alias("block")), "items")
    out = None
    for b in range(int(blocks.agg(F.coalesce(F.max("block"), F.lit(-1))).first()[0]) + 1):
        rows = blocks.filter(F.col("block") == b).collect()  # BLOCK bytes of texts and one text at most
        found = _search_block(docs, [r["item_id"] for r in rows], Items([bytes(r["raw"]) for r in rows]), top)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], _OUT) if out is None else out


def _search_block(docs: DataFrame, item_ids: list, items: Items, top: int):
    if not items.number:
        return None
    counted = stored(_counted(docs, items.number), "counted")
    total = counted.agg(F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
    if not total["all"]:
        return None
    weights = weight(total["docs"], _document_counts(counted, len(items.number)))
    found = _search(counted.filter(F.octet_length("terms") > 0), items, weights, total["docs"], total["all"], top)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    names = docs.sparkSession.createDataFrame([(i, x) for i, x in enumerate(item_ids)], "item long, item_id long")
    doc_id = F.when(F.col("doc_id") < F.lit(int(NO_ID)), F.col("doc_id"))
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", doc_id.alias("doc_id"), "score")


__all__ = ["ranked_search"]
