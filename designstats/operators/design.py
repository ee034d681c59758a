"""Survey designs: a DataFrame plus the roles of its columns.

Everything downstream follows one pattern. Rows are summed once per (stratum, PSU, key)
by an ordinary hash aggregate, so a PSU or stratum that holds a large part of the rows is
already collapsed on the map side. Variances are algebra on that much smaller table. The
number of PSUs per stratum always comes from the full design, never from the rows at hand;
a domain condition may therefore be a plain filter on the scan, as a PSU without domain
rows only adds zeros to the stratum sums.
"""

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from designstats.functions.columns import col, lit

PSU, STR, WT, FPC, IN = "__psu", "__str", "__w", "__fpc", "__in"
HIDDEN = (PSU, STR, WT, FPC, IN)


@dataclass(frozen=True)
class Design:
    """Immutable design; every operator returns a new one."""

    df: DataFrame
    groups: tuple[str, ...] = ()
    lonely: str = "fail"
    has_fpc: bool = False
    full: DataFrame | None = None
    _cache: dict = field(default_factory=dict, repr=False)

    @staticmethod
    def of(
        df: DataFrame,
        ids: str | Column,
        strata: str | Column | None = None,
        weights: str | Column | None = None,
        fpc: str | Column | None = None,
        nest: bool = False,
        lonely: str = "fail",
        validate: bool = True,
    ) -> "Design":
        """Declare the design. ``nest=True`` allows the same PSU id in several strata.

        A NULL stratum, PSU, weight or fpc is an error when the rows are read.
        """
        roles = {
            PSU: (col(ids), None), STR: (lit(1) if strata is None else col(strata), None),
            WT: (lit(1.0) if weights is None else col(weights), "double"),
            FPC: (lit(None) if fpc is None else col(fpc), "double"),
        }
        given = {PSU: "PSU", STR: "stratum", WT: "weight"} | ({} if fpc is None else {FPC: "fpc"})
        out = df.withColumns({name: c if kind is None else c.cast(kind) for name, (c, kind) in roles.items()} | {IN: F.lit(True)})
        # A row without a role would leave at the join with the strata: the query fails instead.
        types = dict(out.dtypes)
        out = out.withColumns({
            name: F.coalesce(F.col(name), F.raise_error(F.lit(f"NULL {what} in the design")).cast(types[name]))
            for name, what in given.items()
        })
        design = Design(out, lonely=lonely, has_fpc=fpc is not None, full=out)
        if validate:
            design.validate(nest)
        return design

    # -- verbs -------------------------------------------------------------
    def mutate(self, **exprs: Column) -> "Design":
        """Add or replace columns, each seeing the ones before it."""
        df = self.df
        for name, expr in exprs.items():
            df = df.withColumn(name, expr)
        return replace(self, df=df)

    def select(self, *names: str) -> "Design":
        return replace(self, df=self.df.select(*names, *HIDDEN))

    def filter(self, cond: Column) -> "Design":
        """Restrict to a domain; the strata and PSU counts stay those of the full design."""
        return replace(self, df=self.df.withColumn(IN, F.col(IN) & cond))

    subset = filter

    def group_by(self, *names: str) -> "Design":
        return replace(self, groups=tuple(names))

    @property
    def variables(self) -> DataFrame:
        """The table back, without the hidden columns."""
        return self.df.drop(*HIDDEN)

    def domain_rows(self) -> DataFrame:
        """Rows in the domain; a condition that is NULL is not met. The bare condition reaches the scan as its filter."""
        return self.df.where(F.col(IN))

    # -- strata ------------------------------------------------------------
    def psus(self) -> DataFrame:
        return self.full.groupBy(STR, PSU).agg(
            F.min(FPC).alias("fpc_lo"), F.max(FPC).alias("fpc_hi"), F.min(WT).alias("w_lo"),
            F.count(F.lit(1)).alias("rows"),
        )

    def strata(self) -> DataFrame:
        """One row per stratum: n_h PSUs and the sampling fraction f_h. Kept for reuse."""
        if "strata" not in self._cache:
            table = self.psus().groupBy(STR).agg(
                F.count(F.lit(1)).alias("n_h"), F.max("fpc_hi").alias("fpc")
            )
            fraction = F.when(F.col("fpc") > 1, F.col("n_h") / F.col("fpc")).otherwise(F.col("fpc"))
            self._cache["strata"] = table.select(
                STR, "n_h", F.coalesce(fraction, F.lit(0.0)).alias("f_h")
            ).persist()
        return self._cache["strata"]

    def size(self) -> tuple[int, int]:
        """(number of PSUs, number of strata)."""
        if "size" not in self._cache:
            row = self.strata().agg(F.sum("n_h").alias("p"), F.count(F.lit(1)).alias("h")).first()
            self._cache["size"] = (int(row.p), int(row.h))
        return self._cache["size"]

    def degf(self) -> int:
        psus, strata = self.size()
        return psus - strata

    def degf_col(self) -> Column:
        """Degrees of freedom as a scalar subquery, so that no job runs while planning."""
        one = self.strata().agg((F.sum("n_h") - F.count(F.lit(1))).cast("double").alias("df"))
        return one.scalar()

    def validate(self, nest: bool = False) -> None:
        """Check the roles: weights positive, fpc constant and large enough, PSU in one stratum."""
        by_psu = self.psus()
        by_stratum = by_psu.groupBy(STR).agg(
            F.count(F.lit(1)).alias("n_h"), F.min("fpc_lo").alias("lo"),
            F.max("fpc_hi").alias("hi"), F.min("w_lo").alias("w"),
        )
        bad = by_stratum.agg(
            F.coalesce(F.sum((F.col("lo") != F.col("hi")).cast("int")), F.lit(0)).alias("fpc_varies"),
            F.coalesce(
                F.sum(((F.col("hi") > 1) & (F.col("hi") < F.col("n_h"))).cast("int")), F.lit(0)
            ).alias("fpc_small"),
            F.coalesce(F.sum((F.col("w") <= 0).cast("int")), F.lit(0)).alias("weights"),
            F.sum((F.col("n_h") == 1).cast("int")).alias("lonely"),
        ).first()
        if bad.weights:
            raise ValueError("weights must be positive")
        if bad.fpc_varies:
            raise ValueError("fpc is not constant within strata")
        if bad.fpc_small:
            raise ValueError("fpc smaller than the number of sampled PSUs")
        if bad.lonely and self.lonely == "fail":
            raise ValueError(f"{bad.lonely} strata have a single PSU; choose a lonely policy")
        if not nest and not by_psu.groupBy(PSU).count().where("count > 1").isEmpty():
            raise ValueError("a PSU id occurs in several strata; set nest=True if intended")

    def summary(self) -> DataFrame:
        """Rows, PSUs, strata and the spread of PSUs per stratum."""
        by_stratum = self.psus().groupBy(STR).agg(
            F.count(F.lit(1)).alias("n_h"), F.sum("rows").alias("rows")
        )
        return by_stratum.agg(
            F.sum("rows").alias("n_rows"), F.sum("n_h").alias("n_psu"),
            F.count(F.lit(1)).alias("n_strata"), F.min("n_h").alias("min_psu"),
            F.max("n_h").alias("max_psu"),
        )

    # -- variance of totals --------------------------------------------------
    def total_variance(
        self, psu_totals: DataFrame, keys: Sequence[str], pairs: dict[str, tuple[str, str]],
        extra: dict[str, Column] | None = None,
    ) -> DataFrame:
        """Covariance of totals from a table with one row per (stratum, PSU, keys).

        ``pairs`` maps output names to two total columns (the same one twice for a variance).
        Rows of the PSU table that are absent count as zero.
        """
        needed = sorted({c for ab in pairs.values() for c in ab})
        sums = [F.expr(f"sum({c}) AS s_{c}") for c in needed]
        sums += [F.expr(f"sum({a} * {b}) AS q_{out}") for out, (a, b) in pairs.items()]
        sums += [e.alias(f"x_{out}") for out, e in (extra or {}).items()]
        by_stratum = psu_totals.groupBy(STR, *keys).agg(*sums).join(self.strata(), STR)
        result = []
        for out, (a, b) in pairs.items():
            spread = f"(1 - f_h) * n_h / (n_h - 1) * (q_{out} - s_{a} * s_{b} / n_h)"
            single = {
                "fail": "CAST(raise_error('stratum with a single PSU') AS DOUBLE)",
                "adjust": f"(1 - f_h) * q_{out}",
            }.get(self.lonely, "0D")  # remove, average
            result.append(F.expr(f"sum(CASE WHEN n_h = 1 THEN {single} ELSE {spread} END) AS {out}"))
        result += [F.sum(f"x_{out}").alias(out) for out in (extra or {})]
        table = by_stratum.groupBy(*keys).agg(*result)
        if self.lonely == "average":
            lonely_share = self.strata().agg(
                (F.count(F.lit(1)) / F.sum((F.col("n_h") > 1).cast("int"))).alias("r")
            ).scalar()
            for out in pairs:
                table = table.withColumn(out, F.col(out) * lonely_share)
        return table
