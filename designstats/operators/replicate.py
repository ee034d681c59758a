"""Replicate-weight variance: BRR, Fay, stratified jackknife, bootstrap.

A replicate weight is a property of a PSU, so replicates are formed from PSU totals and the
rows are read once, whatever the number of replicates. No (row x replicate) table exists:

* jackknife: leaving out a PSU is algebra on its stratum total, one row per PSU;
* BRR and Fay: all half-sample totals are one Walsh-Hadamard transform of the within-pair
  differences, done in two grouped stages of fast transforms of about sqrt(R) terms each;
* bootstrap: tasks deal the draws of stretches of PSU numbers and pack them by the block of
  numbers they fall in; a block's counts become one byte per replicate for each PSU, and a
  task sums its PSU rows to one vector of the replicates for each key.
"""

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from designstats.functions.columns import col
from designstats.functions.dist import INF
from designstats.operators.design import PSU, STR, WT, Design
from designstats.operators.estimate import interval, mean_cells, with_share
from designstats.operators.frame import null_safe_join, number_rows

#: Draws that a task deals at once, and counts (PSUs x replicates) or row weights that it holds at once.
DEALT, COUNTED = 1 << 20, 1 << 21
#: Tasks that deal draws, at most.
DEALERS = 2048


def even_strata(design: Design) -> Design:
    """Keep the strata with an even number of PSUs, as a new design (without fpc)."""
    even = design.strata().where(F.col("n_h") % 2 == 0).select(STR)
    rows = design.df.join(even, STR, "left_semi")
    return Design(rows.withColumn("__fpc", F.lit(None).cast("double")), design.groups,
                  design.lonely, False, rows.withColumn("__fpc", F.lit(None).cast("double")))


def fast_walsh(values: np.ndarray) -> np.ndarray:
    """Signed sums over the last axis for every row number of the Hadamard matrix: n log n additions."""
    size, half = values.shape[-1], 1
    while half < size:
        pair = values.reshape(*values.shape[:-1], size // (2 * half), 2, half)
        values = np.concatenate([pair.sum(-2, keepdims=True), pair[..., :1, :] - pair[..., 1:, :]], axis=-2).reshape(values.shape)
        half *= 2
    return values


def _walsh_column(size: int):
    """(places, values) of a group -> its transform of the given size."""
    @F.pandas_udf("array<double>")
    def transform(places: pd.Series, values: pd.Series) -> pd.Series:
        def one(at, own):
            line = np.zeros(size)
            np.add.at(line, np.asarray(at, dtype=np.int64), np.asarray(own, dtype=float))
            return fast_walsh(line)
        return pd.Series([one(at, own) for at, own in zip(places, values)])

    return transform


def _dealt(seed: int, reps: int, step: int, width: int):
    """Stretches of a stratum's PSU numbers -> for each block of ``width`` numbers the draws that fall in it."""
    def deal(batches):
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("text", "n_h", "part")])
            for row, (text, size, part) in enumerate(rows):
                own = [b"%d" % rn for rn in range(part * step + 1, min(size, (part + 1) * step) + 1)]
                heads = [f"{seed}|{rep}|{text}|".encode() for rep in range(1, reps + 1)]
                digests = b"".join([md5(head + rn, usedforsecurity=False).digest()[:4] for head in heads for rn in own])
                at = np.frombuffer(digests, ">u4").astype(np.int64) % size
                block, place = np.divmod(at, width)
                code = (np.repeat(np.arange(reps), len(own)) * width + place).astype(np.uint32)
                order = np.argsort(block.astype(np.min_scalar_type(block.max())), kind="stable")
                blocks, first = np.unique(block[order], return_index=True)
                cells = [c.tobytes() for c in np.split(code[order], first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(STR).take(pa.array([row] * len(blocks))), pa.array(blocks),
                     pa.array([size] * len(blocks), pa.int64()), pa.array(cells, pa.binary())],
                    [STR, "block", "n_h", "cells"])

    return deal


def _counted(reps: int, width: int):
    """The draws of a block of PSU numbers -> each number and how often it is drawn, one byte per replicate."""
    def count(table: pa.Table) -> pa.Table:
        codes = np.frombuffer(b"".join(table.column("cells").to_pylist()), np.uint32)
        times = np.bincount(codes, minlength=reps * width).reshape(reps, width)
        if times.max() > 255:
            raise OverflowError("a PSU is drawn more than 255 times in a replicate")
        first = table.column("block")[0].as_py() * width
        psus = min(width, table.column("n_h")[0].as_py() - first)
        raw = times.T[:psus].astype(np.uint8).tobytes()
        return pa.table({
            STR: table.column(STR).take(pa.array([0] * psus)), "rn": pa.array(np.arange(first + 1, first + psus + 1)),
            "times": pa.array([raw[i * reps:(i + 1) * reps] for i in range(psus)], pa.binary())})

    return count


def draw_counts(times, reps: int) -> np.ndarray:
    """Rows of bytes as a table of counts, one column per replicate."""
    return np.frombuffer(b"".join(times), np.uint8).reshape(-1, reps)


def _vector_sums(reps: int, keys: list[str], values: list[str]):
    """PSU rows with their draw counts -> for each key of a batch the vectors sum(value * count)."""
    step = max(1, COUNTED // reps)

    def sums(part: pa.RecordBatch) -> pa.RecordBatch:
        group = np.zeros(part.num_rows, dtype=np.int64)
        for k in keys:
            code = part.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
            group = np.unique(group * (code.max() + 1) + code, return_inverse=True)[1]
        order = np.argsort(group, kind="stable")
        first = np.unique(group[order], return_index=True)[1]
        times = draw_counts(part.column("times").to_pylist(), reps).astype(float)
        own = np.stack([part.column(v).to_numpy(zero_copy_only=False) for v in values])
        # an infinite value or NaN is felt where its PSU is drawn only
        known = np.where(np.isfinite(own), own, 0.0)
        out = np.empty((len(first), len(values), reps))
        for g, at in enumerate(np.split(order, first[1:])):
            out[g] = known[:, at] @ times[at]
            for v, i in np.argwhere(known[:, at] != own[:, at]):
                hit = times[at[i]] > 0
                out[g, v, hit] += own[v, at[i]]
        lists = [pa.array(list(out[:, v]), pa.list_(pa.float64())) for v in range(len(values))]
        return pa.RecordBatch.from_arrays([*[part.column(k).take(pa.array(order[first])) for k in keys], *lists], [*keys, *values])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                yield sums(batch.slice(lo, step))

    return run


@dataclass(frozen=True)
class RepDesign:
    """A design together with a replication scheme."""

    design: Design
    kind: str
    replicates: int = 0
    rho: float = 0.0
    seed: int = 1
    mse: bool = False

    def group_by(self, *names: str) -> "RepDesign":
        return RepDesign(self.design.group_by(*names), self.kind, self.replicates, self.rho,
                         self.seed, self.mse)

    def filter(self, cond: Column) -> "RepDesign":
        return RepDesign(self.design.filter(cond), self.kind, self.replicates, self.rho,
                         self.seed, self.mse)

    # -- scheme constants ----------------------------------------------------
    def scheme(self) -> dict:
        """Number of replicates, their scale, and degrees of freedom."""
        if "scheme" not in self.design._cache:
            self.design._cache["scheme"] = {}
        cache = self.design._cache["scheme"]
        key = (self.kind, self.replicates, self.rho)
        if key not in cache:
            n = F.col("n_h")
            row = self.design.strata().agg(
                F.sum("n_h").alias("psus"), F.count(F.lit(1)).alias("strata"),
                F.sum((n % 2).cast("int")).alias("odd"), F.sum(F.floor(n / 2)).alias("pairs"),
                F.sum((n - 1) * (1 - F.col("f_h"))).alias("jk_weight"), F.avg(1 / n).alias("inv"),
            ).first()
            psus, strata, pairs = int(row.psus), int(row.strata), int(row.pairs)
            if self.kind == "JKn":
                out = {"reps": psus, "weight": float(row.jk_weight), "df": psus - strata}
            elif self.kind in ("BRR", "Fay"):
                if row.odd:
                    raise ValueError("half-samples need an even number of PSUs in every stratum")
                reps = 1 << pairs.bit_length()
                scale = 1.0 / (reps * (1.0 - self.rho) ** 2)
                out = {"reps": reps, "weight": reps * scale, "scale": scale, "df": pairs}
            elif self.kind == "bootstrap":
                mean_n = 1.0 / float(row.inv)
                scale = mean_n / ((mean_n - 1.0) * (self.replicates - 1))
                out = {"reps": self.replicates, "weight": self.replicates * scale, "scale": scale,
                       "df": min(self.replicates - 1, psus - strata)}
            else:
                raise ValueError(f"unknown replication scheme {self.kind}")
            cache[key] = out
        return cache[key]

    # -- replicate totals ------------------------------------------------------
    def totals(self, psu: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
        """One row per (replicate, keys) with the replicate totals ``names``.

        Extra columns: ``rep`` (text), ``mult`` (how many equal replicates the row stands for),
        ``rscale``; and per name the full total ``full_<name>`` and the total ``base_<name>`` of
        a replicate without any row of the key.
        """
        psu = psu.select(STR, PSU, *keys, *names)
        if self.kind == "JKn":
            return self._jackknife(psu, keys, names)
        if self.kind in ("BRR", "Fay"):
            return self._half_samples(psu, keys, names)
        return self._bootstrap(psu, keys, names)

    def _full(self, psu, keys, names):
        return psu.groupBy(*keys).agg(*[F.sum(t).alias(f"full_{t}") for t in names])

    def _jackknife(self, psu, keys, names):
        by_stratum = psu.groupBy(STR, *keys).agg(
            *[F.sum(t).alias(f"h_{t}") for t in names], F.count(F.lit(1)).alias("filled")
        )
        full = by_stratum.groupBy(*keys).agg(*[F.sum(f"h_{t}").alias(f"full_{t}") for t in names])
        by_stratum = null_safe_join(by_stratum, full, keys).join(self.design.strata(), STR)
        n = F.col("n_h")
        blow = n / (n - 1)
        rscale = ((n - 1) / n * (1 - F.col("f_h"))).alias("rscale")
        full_cols = [f"full_{t}" for t in names]
        base_cols = [F.col(f"full_{t}").alias(f"base_{t}") for t in names]

        def left_out(t, own):
            return (F.col(f"full_{t}") - F.col(f"h_{t}") + blow * (F.col(f"h_{t}") - own)).alias(t)

        present = null_safe_join(psu, by_stratum, [STR, *keys]).select(
            F.concat_ws("|", F.col(STR).cast("string"), F.col(PSU).cast("string")).alias("rep"),
            *keys, *[left_out(t, F.col(t)) for t in names], F.lit(1).cast("long").alias("mult"),
            rscale, *full_cols, *base_cols,
        )
        # PSUs of the stratum without a row for the key all give the same replicate
        empty = by_stratum.where(n > F.col("filled")).select(
            F.concat_ws("|", F.col(STR).cast("string"), F.lit("rest")).alias("rep"),
            *keys, *[left_out(t, F.lit(0.0)) for t in names], (n - F.col("filled")).alias("mult"),
            rscale, *full_cols, *base_cols,
        )
        return present.unionByName(empty)

    def _numbered(self) -> DataFrame:
        psus = self.design.full.select(STR, PSU).distinct()
        return number_rows(psus, [STR], PSU, "rn")

    def pairs(self) -> DataFrame:
        """The pair of every PSU (__g, from 1) and its side (__sign)."""
        # strata are few; their running pair offsets come from one small sorted table
        before = Window.orderBy(STR).rowsBetween(Window.unboundedPreceding, -1)
        offsets = self.design.strata().select(
            STR, F.coalesce(F.sum(F.floor(F.col("n_h") / 2)).over(before), F.lit(0)).alias("off")
        )
        return self._numbered().join(offsets, STR).select(
            STR, PSU, (F.col("off") + F.ceil(F.col("rn") / 2)).cast("long").alias("__g"),
            F.when(F.col("rn") % 2 == 1, 1.0).otherwise(-1.0).alias("__sign"),
        )

    def _half_samples(self, psu, keys, names):
        scheme = self.scheme()
        bits = scheme["reps"].bit_length() - 1
        low = bits // 2
        size_lo, size_hi = 1 << low, 1 << (bits - low)
        pairs = self.pairs()
        keyed = psu.join(pairs, [STR, PSU])
        diffs = keyed.groupBy(*keys, "__g").agg(*[F.sum(F.col("__sign") * F.col(t)).alias(t) for t in names])

        def stage(df, group, index, size, out):
            """Signed sums over ``index`` for every row number 0..size-1 of the transform."""
            packed = df.groupBy(*group).agg(F.collect_list(F.struct(index, *names)).alias("items"))
            walsh = _walsh_column(size)
            signed = {t: walsh(F.col(f"items.{index}"), F.col(f"items.{t}")) for t in names}
            # a NULL among the terms makes every sum NULL
            known = lambda t: F.when(~F.exists(F.col(f"items.{t}"), F.isnull), F.col(t)).alias(t)
            lines = packed.withColumns(signed).select(*group, *[known(t) for t in names])
            places = F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")).alias(out)
            return lines.select(*group, F.inline(F.arrays_zip(places, *names)))

        split = diffs.withColumns({
            "__lo": F.col("__g").bitwiseAND(F.lit(size_lo - 1).cast("long")),
            "__hi": F.shiftright("__g", low),
        })
        first = stage(split, [*keys, "__hi"], "__lo", size_lo, "__r_lo")
        second = stage(first, [*keys, "__r_lo"], "__hi", size_hi, "__r_hi")
        full = self._full(psu, keys, names)
        joined = null_safe_join(second, full, keys)
        shrink = 1.0 - self.rho
        return joined.select(
            (F.col("__r_hi") * size_lo + F.col("__r_lo")).cast("string").alias("rep"), *keys,
            *[(F.col(f"full_{t}") + shrink * F.col(t)).alias(t) for t in names],
            F.lit(1).cast("long").alias("mult"), F.lit(scheme["scale"]).alias("rscale"),
            *[f"full_{t}" for t in names], *[F.col(f"full_{t}").alias(f"base_{t}") for t in names],
        )

    def draws(self) -> DataFrame:
        """How often the PSU ``rn`` of a stratum is drawn: ``times`` has one byte per replicate. Kept for reuse.

        In every replicate PSU number i of a stratum deals one draw, the number
        1 + (first four bytes of md5("seed|replicate|stratum|i")) mod n_h.
        The table comes from a few strata, so it looks small to the planner; the hint keeps it from being broadcast.
        """
        key = ("draws", self.seed, self.replicates)
        if key not in self.design._cache:
            self.design._cache[key] = self._deal().persist()
        return self.design._cache[key].hint("merge")

    def _deal(self) -> DataFrame:
        reps = self.replicates
        step, width = max(1, DEALT // reps), max(1, COUNTED // reps)
        psus, count = self.design.size()
        last = F.floor((F.col("n_h") - 1) / step).cast("long")
        parts = self.design.strata().where(F.col(STR).isNotNull()).select(
            STR, F.col(STR).cast("string").alias("text"), F.col("n_h").cast("long").alias("n_h"),
            F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"),
        ).repartition(max(1, min(DEALERS, psus // step + count)))
        kept = parts.schema[STR]
        cells = StructType([kept, *StructType.fromDDL("block long, n_h long, cells binary")])
        times = StructType([kept, *StructType.fromDDL("rn long, times binary")])
        dealt = parts.mapInArrow(_dealt(self.seed, reps, step, width), cells)
        return dealt.groupBy(STR, "block").applyInArrow(_counted(reps, width), times)

    def _bootstrap(self, psu, keys, names):
        scheme, keys = self.scheme(), list(keys)
        shrunk = psu.join(self.design.strata(), STR).withColumn("lam", F.sqrt(1 - F.col("f_h")))
        ends = shrunk.groupBy(*keys).agg(
            *[F.sum(t).alias(f"full_{t}") for t in names],
            *[F.sum((1 - F.col("lam")) * F.col(t)).alias(f"base_{t}") for t in names],
        )
        numbered = shrunk.join(self._numbered(), [STR, PSU])
        own = {f"__v{i}": F.col("lam") * F.col(t) for i, t in enumerate(names)}
        values = {"__hits": F.lit(1.0), **{v: F.coalesce(c, F.lit(0.0)) for v, c in own.items()},
                  **{f"{v}_known": c.isNotNull().cast("double") for v, c in own.items()}}
        rows = numbered.join(self.draws(), [STR, "rn"]).select("times", *keys, *[c.alias(v) for v, c in values.items()])
        vectors = StructType([*[rows.schema[k] for k in keys], *[StructField(v, ArrayType(DoubleType())) for v in values]])
        parts = rows.mapInArrow(_vector_sums(self.replicates, keys, list(values)), vectors)
        number = F.sequence(F.lit(1), F.lit(self.replicates)).alias("rep")
        each = parts.select(*keys, F.inline(F.arrays_zip(number, *values)))
        sums = each.groupBy("rep", *keys).agg(*[F.sum(v).alias(v) for v in values]).where("__hits > 0")
        sums = sums.select("rep", *keys, *[F.when(F.col(f"{v}_known") > 0, F.col(v)).alias(t) for v, t in zip(own, names)])
        return null_safe_join(sums, ends, keys).select(
            F.col("rep").cast("string").alias("rep"), *keys,
            *[(F.col(t) + F.col(f"base_{t}")).alias(t) for t in names],
            F.lit(1).cast("long").alias("mult"), F.lit(scheme["scale"]).alias("rscale"),
            *[f"full_{t}" for t in names], *[f"base_{t}" for t in names],
        )

    # -- statistics --------------------------------------------------------------
    def with_replicates(self, psu: DataFrame, keys: Sequence[str], names: Sequence[str],
                        statistic, return_replicates: bool = False) -> DataFrame:
        """Any smooth function of totals: ``statistic`` maps a name -> Column lookup to a Column.

        Returns keys, estimate, se (and with ``return_replicates`` the replicate values).
        """
        reps = self.totals(psu, keys, names)
        value = statistic(lambda t: F.col(t))
        full = statistic(lambda t: F.col(f"full_{t}"))
        base = statistic(lambda t: F.col(f"base_{t}"))
        reps = reps.withColumns({"value": value, "full": full, "base": base})
        if return_replicates:
            return reps.select("rep", *keys, "value", "mult", "rscale", "full")
        d, m, s = F.col("value") - F.col("full"), F.col("mult"), F.col("rscale")
        sums = reps.groupBy(*keys).agg(
            F.first("full").alias("estimate"), F.first("base").alias("base"),
            F.sum(m).alias("c0"), F.sum(m * d).alias("c1"), F.sum(m * s).alias("s0"),
            F.sum(m * s * d).alias("s1"), F.sum(m * s * d * d).alias("s2"),
        )
        scheme = self.scheme()
        # replicates in which the key never occurs
        d0 = F.coalesce(F.col("base") - F.col("estimate"), F.lit(0.0))
        rest, rest_scale = F.lit(scheme["reps"]) - F.col("c0"), F.lit(scheme["weight"]) - F.col("s0")
        c1, s1 = F.col("c1") + rest * d0, F.col("s1") + rest_scale * d0
        s2 = F.col("s2") + rest_scale * d0 * d0
        centre = F.lit(0.0) if self.mse else c1 / F.lit(scheme["reps"])
        variance = s2 - 2 * centre * s1 + centre * centre * F.lit(scheme["weight"])
        return sums.select(*keys, "estimate", F.sqrt(F.greatest(variance, F.lit(0.0))).alias("se"))

    def survey_count(self, *cells: str, prop: bool = False, df=None, level: float = 0.95) -> DataFrame:
        keys = [*self.design.groups, *cells]
        psu = self.design.domain_rows().groupBy(STR, PSU, *keys).agg(F.sum(WT).alias("t"))
        table = self.with_replicates(psu, keys, ["t"], lambda v: v("t"))
        table = table.select(*keys, F.col("estimate").alias("n"), F.col("se").alias("n_se"))
        table = interval(table, "n", "n_se", self.scheme()["df"] if df is None else df, level,
                         "n_low", "n_upp")
        return with_share(table, "n", self.design.groups, "prop") if prop else table

    def survey_total(self, x: str | Column, df=INF, level: float = 0.95) -> DataFrame:
        keys = [*self.design.groups, "variable"]
        cells = mean_cells(self.design, {"x": col(x).cast("double")}, False)
        table = self.with_replicates(cells, keys, ["swx"], lambda v: v("swx"))
        table = table.select(*self.design.groups, F.col("estimate").alias("total"), "se")
        return interval(table, "total", "se", df, level)

    def survey_means(self, variables: Sequence[str] | dict[str, Column], df=None,
                     level: float = 0.95) -> DataFrame:
        """Means of many variables, each a ratio of replicate totals; one pass over the rows."""
        if not isinstance(variables, dict):
            variables = {v: F.col(v).cast("double") for v in variables}
        keys = [*self.design.groups, "variable"]
        cells = mean_cells(self.design, variables, False)
        table = self.with_replicates(cells, keys, ["sw", "swx"], lambda v: F.try_divide(v("swx"), v("sw")))
        table = table.select(*keys, F.col("estimate").alias("mean"), "se")
        return interval(table, "mean", "se", self.scheme()["df"] if df is None else df, level)

    def replicate_means(self, variables: Sequence[str]) -> DataFrame:
        """The replicate values themselves, long: rep, variable, value, mult, rscale."""
        cells = mean_cells(self.design, {v: F.col(v).cast("double") for v in variables}, False)
        keys = [*self.design.groups, "variable"]
        return self.with_replicates(cells, keys, ["sw", "swx"], lambda v: F.try_divide(v("swx"), v("sw")), True)


def replicate_vcov(values: DataFrame, term: str, terms: Sequence[str]) -> DataFrame:
    """Covariance of replicate values around their means, long: a, b, cov, mean_a.

    The replicates are spread to one column per term (their number is the number of
    coefficients) and all products are summed in one aggregate.
    """
    wide = values.groupBy("rep", "mult", "rscale").pivot(term, list(terms)).agg(F.first("value"))
    m, s = F.col("mult"), F.col("rscale")
    means = wide.agg(F.struct(*[(F.sum(m * F.col(f"`{t}`")) / F.sum(m)).alias(t) for t in terms])
                     .alias("c")).scalar()
    wide = wide.withColumn("c", means)
    gap = {t: F.col(f"`{t}`") - F.col(f"c.`{t}`") for t in terms}
    sums = [F.sum(m * s * gap[a] * gap[b]).alias(f"{a}|{b}") for a in terms for b in terms]
    one = wide.agg(F.first("c").alias("c"), *sums)
    cells = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("cov"),
                 F.col(f"c.`{a}`").alias("mean_a"))
        for a in terms for b in terms
    ])
    return one.select(F.inline(cells))


def as_rep(design: Design, kind: str, replicates: int = 100, rho: float = 0.3, seed: int = 1,
           mse: bool = False) -> RepDesign:
    """Turn a design into a replicate design: JKn, BRR, Fay or bootstrap."""
    rep = RepDesign(design, kind, replicates if kind == "bootstrap" else 0,
                    rho if kind == "Fay" else 0.0, seed, mse)
    rep.scheme()
    return rep
