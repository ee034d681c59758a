"""Hard rows that every operator must stand, and brute-force versions to compare with."""

import random
import re

WORD = re.compile("[0-9a-z_\x80-\U0010ffff]+")


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split())
                    + str(r.randint(0, 99)) for _ in range(n))


def hard_rows() -> list[tuple]:
    """doc_id, text: nulls in either, empty and long texts, ties, repeated rows."""
    long = prose(1, 30_000)
    near = prose(2, 120)
    return [
        (None, None), (None, "no id"), (None, "no id"), (1, None), (2, ""), (3, ""), (4, " \n\t "), (5, long), (6, long),
        (7, near), (8, near.replace("alpha", "omega", 1)), (9, near), (9, near), (9, "same id, other text"),
        (10, "It's 12.5 km, isn't it?\r\n\r\nMr. Smith’s café \U0001f600 \x00 end"), (11, "one"), (12, "\n\n\n"), (13, "...!!!"),
    ]


def frame(spark, rows=None, extra: bool = True):
    rows = hard_rows() if rows is None else rows
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:  # columns whose names the operators might use themselves
        for c in ("id", "key", "line", "root", "score", "cell", "node", "size", "copy", "item_id", "shard", "part", "rank", "kind"):
            df = df.selectExpr("*", f"'x' AS `{c}`")
    return df.repartition(3)


def empty(spark):
    return frame(spark, [])


def shingles(text, n=5):
    w = WORD.findall((text or "").lower())
    return frozenset(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
