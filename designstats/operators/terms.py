"""Model terms: a list of items becomes named design columns.

An item is a column name (numbers stay as they are, text columns become 0/1 columns for
every level but the first), or the result of ``power``, ``inter``, ``cross`` or ``expr``.
"""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from designstats.operators.frame import factor_levels


@dataclass(frozen=True)
class Item:
    kind: str
    parts: tuple


def power(name: str, k: int) -> Item:
    return Item("power", (name, k))


def inter(*parts) -> Item:
    """Product of all columns of the parts."""
    return Item("inter", parts)


def cross(a, b) -> list:
    """Both parts (each an item or list of items) and all their products."""
    left = list(a) if isinstance(a, (list, tuple)) else [a]
    right = list(b) if isinstance(b, (list, tuple)) else [b]
    return [*left, *right, *[inter(x, y) for x in left for y in right]]


def expr(label: str, column: Column) -> Item:
    return Item("expr", (label, column))


def expand(df: DataFrame, items: Sequence, intercept: bool = True,
           levels: Mapping[str, Sequence] | None = None) -> list[tuple[str, Column]]:
    """Named columns of the model matrix."""
    levels = dict(levels or {})
    types = {f.name: f.dataType for f in df.schema.fields}

    def one(item) -> list[tuple[str, Column]]:
        if isinstance(item, str):
            if isinstance(types[item], T.StringType):
                if item not in levels:
                    levels[item] = factor_levels(df, item)
                return [
                    (f"{item}{v}", F.when(F.col(item) == v, 1.0).when(F.col(item).isNotNull(), 0.0))
                    for v in levels[item][1:]
                ]
            return [(item, F.col(item).cast("double"))]
        if item.kind == "power":
            name, k = item.parts
            column = F.col(name).cast("double")
            for _ in range(k - 1):
                column = column * F.col(name)
            return [(f"{name}^{k}", column)]
        if item.kind == "expr":
            return [(item.parts[0], item.parts[1].cast("double"))]
        out = one(item.parts[0])
        for part in item.parts[1:]:
            out = [(f"{a}:{b}", x * y) for a, x in out for b, y in one(part)]
        return out

    flat: list = []
    for item in items:
        flat += item if isinstance(item, list) else [item]
    columns = [("(Intercept)", F.lit(1.0))] if intercept else []
    for item in flat:
        columns += [c for c in one(item) if c[0] not in {n for n, _ in columns}]
    return columns
