"""Benchmark decontamination on templates.

Numbers, names and units are replaced by typed placeholders, windows of ``WINDOW`` tokens are hashed, and
windows of documents meet those of benchmark items in a hash join. What stood in the placeholders travels with
the window: along one alignment of a document with an item, each value of the item must always meet the same
value of the document, and the other way round. So a question with other numbers is found, and chance
templates whose values contradict each other are not.

An item shorter than a window is looked for as a window of its own length, in documents of any length. Items that are so
short or have no window literal enough also have exact windows, with the values in the hash, so that verbatim copies match.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from designstats.llm.arrays import encoded, mix, rank_in, slices, spans_of, trimmed, word_spans
from designstats.llm.common import stored
from designstats.llm.graph import int64s, key_filter, passes

WINDOW = 8
#: A window needs so many tokens that are no placeholders, and an alignment so many windows (or all of a short item).
LITERALS, MATCHES = 5, 3
#: Benchmark windows that may be broadcast; more are joined by a shuffle.
BROADCAST_WINDOWS = 200_000
LITERAL, NUMBER, NAME, UNIT = range(4)
#: Units and number words.
UNITS = ("mm cm m km g kg mg lb lbs oz l ml inch inches foot feet yard yards mile miles meter meters metre metres gram grams kilogram kilograms "
         "liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar "
         "dollars euro euros pound pounds percent degree degrees kmh mph").split()
NUMBERS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
           "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million").split()

_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?:;\"()\n"]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 32]] = True


def _hashes(words):
    data, starts = encoded(list(words))
    begin, end, _ = word_spans(data, starts)
    return np.sort(spans_of(data, begin, end))


_UNITS, _NUMBERS = _hashes(UNITS), _hashes(NUMBERS)


def template(texts: list[str]):
    """Kind and hash (of the lower-case token) of every token, and where each text's tokens start.

    A name is a capitalised token (not all capitals) that does not begin a sentence or line.
    """
    data, starts = encoded(texts)
    member = _TOKEN[data]
    if len(data) > 2:  # a point or comma between digits belongs to the number
        dot = (data[1:-1] == 46) | (data[1:-1] == 44)
        member[1:-1] |= dot & _DIGIT[data[:-2]] & _DIGIT[data[2:]]
    flag = np.diff(np.concatenate([[0], member.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(flag == 1), np.flatnonzero(flag == -1)
    of = np.searchsorted(begin, starts)
    lower = np.where(_UPPER[data], data + 32, data)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data], dtype=np.int64)])
    upper = np.concatenate([[0], np.cumsum(_UPPER[data], dtype=np.int64)])
    value = spans_of(lower, begin, end)
    kind = np.zeros(len(begin), dtype=np.int8)
    # The last sign before a token that is no blank tells whether a sentence begins.
    solid = np.maximum.accumulate(np.where(_BLANK[data], -1, np.arange(len(data))))
    before = np.where(begin > 0, solid[np.maximum(begin - 1, 0)], -1)
    opens = (before < 0) | _END[data[np.maximum(before, 0)]]
    opens[of[:-1][np.diff(of) > 0]] = True
    kind[(upper[end] - upper[begin] == 1) & _UPPER[data[begin]] & (end - begin > 1) & ~opens] = NAME
    kind[np.isin(value, _UNITS)] = UNIT
    kind[_DIGIT[data[begin]] & (digits[end] - digits[begin] > 0) | np.isin(value, _NUMBERS)] = NUMBER
    return kind, value, of


def _window_hash(tokens: np.ndarray, first: np.ndarray, size: np.ndarray, start: np.ndarray) -> np.ndarray:
    h = start
    for k in range(WINDOW):
        h = mix(h * np.uint64(5) + np.where(k < size, tokens[np.minimum(first + k, len(tokens) - 1)], np.uint64(0)))
    return h


def template_windows(texts: list[str], short: tuple[int, ...] = (), exact: bool = False):
    """(text number, position, hash, first token, tokens, exact) of every window with enough literal tokens; kinds, values.

    A text with fewer tokens than a window has one window, of all of them, if more than half are literal. short: lengths
    below WINDOW whose windows longer texts have as well. exact: short windows and those with too few literal tokens
    also have a hash of the tokens as they are.
    """
    kind, value, of = template(texts)
    count = np.diff(of)
    made = [(np.where(count >= WINDOW, count - WINDOW + 1, np.minimum(count, 1)), np.minimum(count, WINDOW))]
    made += [(np.where(count > n, count - n + 1, 0), np.full(len(count), n)) for n in short]
    text = np.concatenate([np.repeat(np.arange(len(count)), m) for m, _ in made])
    place = np.concatenate([rank_in(m) for m, _ in made])
    size = np.concatenate([np.repeat(n, m) for m, n in made])
    first = of[:-1][text] + place
    masked = np.append(np.where(kind == LITERAL, value, kind.astype(np.uint64)), np.uint64(0))
    literal = np.concatenate([[0], np.cumsum(kind == LITERAL)])
    enough = literal[first + size] - literal[first] >= np.minimum(LITERALS, size // 2 + 1)
    at, told = np.flatnonzero(enough), np.flatnonzero(~enough | (size < WINDOW)) if exact else np.zeros(0, dtype=np.int64)
    h = np.concatenate([_window_hash(masked, first[at], size[at], size[at].astype(np.uint64)),
                        _window_hash(np.append(value, np.uint64(0)), first[told], size[told], mix(size[told].astype(np.uint64)))])
    own = np.concatenate([at, told])
    return text[own], place[own], h, first[own], size[own], np.arange(len(own)) >= len(at), kind, value


_WINDOW_ROW = "key struct<id:bigint,copy:bigint>, place int, n_windows int, window bigint, slots array<bigint>, size int, exact boolean"


def window_rows(rows: DataFrame, bits: np.ndarray | None = None, short: tuple[int, ...] = (), exact: bool = True) -> DataFrame:
    """Windows of (id, copy, text) rows; with bits only those that may be in the filter.

    n_windows counts the places of all windows of the text. slots holds the hashes of the values in the placeholders.
    Without bits the rows are items: one that is long and has windows literal enough has no exact ones.
    """
    def run(batches):
        for b in batches:
            ids, copies, texts = (b.column(k).to_pylist() for k in ("id", "copy", "text"))
            for lo, hi in slices(texts):
                text, place, h, first, size, told, kind, value = template_windows(texts[lo:hi], short, exact)
                masked, plain = np.bincount(text[~told], minlength=hi - lo), np.bincount(text[told], minlength=hi - lo)
                total = np.where(masked > 0, masked, plain)
                if bits is not None:
                    keep = np.flatnonzero(passes(bits, h))
                else:
                    keep = np.flatnonzero(~told | (size < WINDOW) | (masked[text] == 0))
                if not len(keep):
                    continue
                slots = []
                for f, s, as_is in zip(first[keep].tolist(), size[keep].tolist(), told[keep].tolist()):
                    own = (kind[f:f + s] != LITERAL) & (not as_is)
                    slots.append(value[f:f + s][own].view(np.int64).tolist() if own.any() else [])
                at = text[keep] + lo
                key = pa.StructArray.from_arrays(
                    [pa.array([ids[i] for i in at], pa.int64()), pa.array([copies[i] for i in at], pa.int64())], names=["id", "copy"])
                yield pa.RecordBatch.from_arrays(
                    [key, pa.array(place[keep], pa.int32()), pa.array(total[text[keep]], pa.int32()), int64s(h[keep]),
                     pa.array(slots, pa.list_(pa.int64())), pa.array(size[keep], pa.int32()), pa.array(told[keep])],
                    names=["key", "place", "n_windows", "window", "slots", "size", "exact"])

    return rows.mapInArrow(trimmed(run), _WINDOW_ROW)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, copy, item_id, n_windows, coverage) of every document with a consistent alignment to an item.

    copy is a hash of the text, which tells rows with one id apart. coverage is the share of the item's
    windows on its best alignment. Null texts and texts without tokens match nothing; a null id of a
    document or item is kept as null; repeated rows count once; empty tables give no rows.
    """
    def rows(df, id_name):
        text = F.coalesce("text", F.lit(""))
        return df.select(F.col(id_name).cast("long").alias("id"), F.xxhash64(text).alias("copy"), text.alias("text"))

    items = stored(window_rows(rows(benchmark, "item_id")).distinct(), "items")
    sizes = items.groupBy("size", "exact").count().collect()  # at most two rows for each size
    short, exact = tuple(sorted({r["size"] for r in sizes} - {WINDOW})), any(r["exact"] for r in sizes)
    items = items.select(
        F.col("key").alias("item"), F.col("place").alias("item_place"), F.col("n_windows").alias("item_windows"), "window",
        F.col("slots").alias("item_slots"))
    n_items = sum(r["count"] for r in sizes)
    found = window_rows(rows(docs, "doc_id"), key_filter(items, "window"), short, exact)
    met = found.join(F.broadcast(items) if n_items <= BROADCAST_WINDOWS else items, "window")
    met = met.select("key", "item", (F.col("place") - F.col("item_place")).alias("shift"), "item_place", "item_windows",
                     F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")).alias("slots"))
    by = ["key", "item", "shift"]
    lines = met.groupBy(*by).agg(
        F.count_distinct("item_place").alias("n_windows"), F.max("item_windows").alias("item_windows"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))  # as long as an item has placeholders
    same = (F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["i"])))) & (
        F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["d"]))))
    enough = F.col("n_windows") >= F.least(F.lit(MATCHES), F.col("item_windows"))
    best = lines.filter(same & enough).groupBy("key", "item").agg(
        F.max("n_windows").alias("n_windows"), F.max("item_windows").alias("item_windows"))
    return best.groupBy(F.col("key.id").alias("doc_id"), F.col("key.copy").alias("copy"), F.col("item.id").alias("item_id")).agg(
        F.max("n_windows").alias("n_windows"), F.max(F.col("n_windows") / F.col("item_windows")).alias("coverage"))
