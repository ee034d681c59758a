"""Column expressions with the null and formatting rules of survey scripts."""

import fnmatch
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def if_else(cond: Column, yes, no) -> Column:
    """Three-way choice: an unknown condition gives NULL, it does not fall to ``no``."""
    return F.when(cond, lit(yes)).when(~cond, lit(no))


def fill_null(c: str | Column, value) -> Column:
    return F.coalesce(col(c), lit(value))


def null_unless(cond: Column, value: str | Column) -> Column:
    return F.when(cond, col(value))


def row_mean(cols: Sequence[str | Column]) -> Column:
    """Mean over columns; NULL as soon as one of them is NULL."""
    total = col(cols[0])
    for c in cols[1:]:
        total = total + col(c)
    return total / F.lit(float(len(cols)))


def strict_mean(c: str | Column) -> Column:
    """Average that is NULL when any value is missing."""
    return F.when(F.count(col(c)) == F.count(F.lit(1)), F.avg(col(c)))


def cols(
    df: DataFrame,
    prefix: str | None = None,
    contains: str | None = None,
    dtype: str | None = None,
    between: tuple[str, str] | None = None,
    exclude: Iterable[str] = (),
) -> list[str]:
    """Pick column names by prefix, part of the name, type, or a range of positions."""
    names = list(df.columns)
    if between is not None:
        names = names[names.index(between[0]) : names.index(between[1]) + 1]
    types = {f.name: f.dataType for f in df.schema.fields}
    wanted = {"double": T.DoubleType, "string": T.StringType}.get(dtype)
    return [
        n
        for n in names
        if (prefix is None or n.startswith(prefix))
        and (contains is None or fnmatch.fnmatch(n, f"*{contains}*"))
        and (wanted is None or isinstance(types[n], wanted))
        and n not in set(exclude)
    ]


def recode(c: str | Column, mapping: Mapping) -> Column:
    """Replace codes by labels; codes outside the mapping become NULL."""
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    return F.create_map(*pairs)[col(c)]


def cut(c: str | Column, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed intervals (b0, b1], (b1, b2], ...; outside gives NULL."""
    x = col(c)
    out = None
    for upper, label in zip(breaks[1:], labels):
        test = x <= F.lit(float(upper))
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return F.when(x > F.lit(float(breaks[0])), out)


# Significance cut points and marks used in every report table.
STAR_BREAKS = (float("-inf"), 0.001, 0.01, 0.05, 1.0)
STAR_LABELS = ("***", "**", "*", "")
# The path-model report uses other cut points and repeats a mark.
PATH_STAR_BREAKS = (float("-inf"), 0.001, 0.01, 0.5, 1.0)
PATH_STAR_LABELS = ("***", "**", "**", "")


def stars(p: str | Column, breaks=STAR_BREAKS, labels=STAR_LABELS) -> Column:
    return cut(p, breaks, labels)


def fixed(c: str | Column, digits: int = 4) -> Column:
    """Number as text with a fixed count of decimals (no thousands mark)."""
    return F.format_string(f"%.{digits}f", F.round(col(c).cast("double"), digits))


def logistic(x: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def seeded_uniform(key: str | Column, seed) -> Column:
    """Uniform in (0, 1) from a hash of seed and key: the same on any partitioning."""
    text = F.concat(lit(seed).cast("string"), F.lit("|"), col(key).cast("string"))
    number = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double")
    return (number + 0.5) / F.lit(float(1 << 48))


def seeded_normal(key: str | Column, seed: int) -> Column:
    """Standard normal from two seeded uniforms (Box-Muller); uses the seeds seed and seed + 1."""
    radius = F.sqrt(-2.0 * F.log(seeded_uniform(key, seed)))
    return radius * F.cos(F.lit(2.0) * F.pi() * seeded_uniform(key, seed + 1))
