"""Replication (H) queries."""

from functools import lru_cache

from pyspark.sql import functions as F

from designstats.functions.dist import INF
from designstats.operators import estimate as E
from designstats.operators.design import PSU, STR, WT
from designstats.operators.frame import union_tagged
from designstats.operators.refits import replicate_glm, replicate_ordinal, replicate_table, replicate_totals
from designstats.operators.replicate import as_rep, even_strata, replicate_vcov
from designstats.plans.fixtures import order_design, with_orders
from designstats.plans.q_estimate import mean_sql
from designstats.plans.registry import query

BOOT = 100


@lru_cache(maxsize=8)
def even_design(spark, sf):
    return even_strata(order_design(spark, sf))


def rep_design(spark, sf, kind, fpc=True):
    if kind in ("BRR", "Fay"):
        return as_rep(even_design(spark, sf), kind)
    return as_rep(order_design(spark, sf, fpc), kind, replicates=BOOT, seed=7)


NUMBER_SQL = """pn AS (SELECT strata, cluster, row_number() OVER (PARTITION BY strata
   ORDER BY ('0x' || substr(md5(CAST(cluster AS VARCHAR)), 1, 2))::BIGINT, cluster) rn
   FROM (SELECT DISTINCT strata, cluster FROM d))"""

# replicate totals of psu-level cells pc(strata, cluster, k, a, b): relation rt(rep, k, a, b, rscale)
JK_SQL = """ks AS (SELECT DISTINCT k FROM pc),
pa AS (SELECT p.strata, p.cluster, ks.k, coalesce(pc.a, 0) a, coalesce(pc.b, 0) b
   FROM (SELECT DISTINCT strata, cluster FROM d) p CROSS JOIN ks
   LEFT JOIN pc ON pc.strata = p.strata AND pc.cluster = p.cluster AND pc.k = ks.k),
hs AS (SELECT strata, k, sum(a) a, sum(b) b FROM pa GROUP BY ALL),
ft AS (SELECT k, sum(a) a, sum(b) b FROM pa GROUP BY k),
rt AS (SELECT pa.strata || '|' || pa.cluster rep, pa.k,
   ft.a - hs.a + n_h / (n_h - 1) * (hs.a - pa.a) a, ft.b - hs.b + n_h / (n_h - 1) * (hs.b - pa.b) b,
   (n_h - 1) / n_h * (1 - {f}) rscale
   FROM pa JOIN hs USING (strata, k) JOIN ft USING (k) JOIN h USING (strata))"""


def half_sql(rho):
    return f"""{NUMBER_SQL}, ev AS (SELECT strata, n_h FROM h WHERE n_h % 2 = 0),
oo AS (SELECT strata, sum(n_h // 2) OVER (ORDER BY strata) - n_h // 2 o FROM ev),
pr AS (SELECT strata, cluster, CAST(o + (rn + 1) // 2 AS BIGINT) g, CASE WHEN rn % 2 = 1 THEN 1 ELSE -1 END s
   FROM pn JOIN oo USING (strata)),
dd AS (SELECT k, g, sum(s * a) a, sum(s * b) b FROM pc JOIN pr USING (strata, cluster) GROUP BY k, g),
rr AS (SELECT unnest(range(CAST(power(2, floor(log2((SELECT max(g) FROM pr))) + 1) AS BIGINT))) r),
ft AS (SELECT k, sum(a) a, sum(b) b FROM pc JOIN ev USING (strata) GROUP BY k),
rt AS (SELECT CAST(r AS VARCHAR) rep, k,
   min(ft.a) + (1 - {rho}) * sum(CASE WHEN bit_count(r & g) % 2 = 1 THEN -dd.a ELSE dd.a END) a,
   min(ft.b) + (1 - {rho}) * sum(CASE WHEN bit_count(r & g) % 2 = 1 THEN -dd.b ELSE dd.b END) b,
   1.0 / ((SELECT count(*) FROM rr) * (1 - {rho}) * (1 - {rho})) rscale
   FROM rr, dd JOIN ft USING (k) GROUP BY r, k)"""


def boot_sql(f):
    return f"""{NUMBER_SQL},
hm AS (SELECT count(*) / sum(1.0 / n_h) m FROM h),
dr AS (SELECT strata, r rep, 1 + ('0x' || substr(md5('7|' || r || '|' || strata || '|' || rn), 1, 8))::BIGINT % n_h rn
   FROM pn JOIN h USING (strata), (SELECT unnest(range(1, {BOOT + 1})) r)),
pl AS (SELECT pc.*, rn, sqrt(1 - {f}) lam FROM pc JOIN pn USING (strata, cluster) JOIN h USING (strata)),
ft AS (SELECT k, sum(a) a, sum(b) b, sum((1 - lam) * a) ba, sum((1 - lam) * b) bb FROM pl GROUP BY k),
su AS (SELECT rep, k, sum(lam * a) a, sum(lam * b) b FROM dr JOIN pl USING (strata, rn) GROUP BY rep, k),
rt AS (SELECT CAST(rep AS VARCHAR) rep, k, su.a + ba a, su.b + bb b,
   (SELECT m / ((m - 1) * {BOOT - 1}) FROM hm) rscale FROM su JOIN ft USING (k))"""


SCHEME = {"JKn": JK_SQL.format(f="f_h"), "JKn0": JK_SQL.format(f="0.0"), "BRR": half_sql(0.0),
          "Fay": half_sql(0.3), "bootstrap": boot_sql("f_h"), "bootstrap0": boot_sql("0.0")}


def cells_sql(k, x, where="TRUE"):
    return f"pc AS (SELECT strata, cluster, {k} k, sum(w * ({x})) a, sum(w) b FROM d WHERE ({where}) AND ({x}) IS NOT NULL GROUP BY ALL)"


def rep_sql(kind, k, x, theta, extra="", digits=8):
    """estimate and se of theta(a, b) for every key k."""
    return with_orders(cells_sql(k, x) + ", " + SCHEME[kind] + f""",
tv AS (SELECT k, {theta} v, rscale FROM rt), tc AS (SELECT k, avg(v) c FROM tv GROUP BY k),
fv AS (SELECT k, {theta} est FROM ft),
rv AS (SELECT k, sqrt(sum(rscale * (v - c) * (v - c))) se FROM tv JOIN tc USING (k) GROUP BY k)
SELECT {{out}} FROM fv JOIN rv USING (k)""")


def mean_rep_sql(kind, k="'x'", x="happy"):
    key = "" if k == "'x'" else f"k {k}, "
    return rep_sql(kind, k, x, "a / b").format(out=f"{key}round(est, 8) mean, round(se, 8) se")


def count_rep_sql(kind, k="grp3"):
    return rep_sql(kind, k, "1", "a").format(out=f"k {k}, round(est, 4) n, round(se, 5) n_se")


def _mean(kind, fpc=True, groups=()):
    def run(spark, sf):
        t = rep_design(spark, sf, kind, fpc).group_by(*groups).survey_means(["happy"], df=INF)
        return t.select(*groups, F.round("mean", 8).alias("mean"), F.round("se", 8).alias("se"))
    return run


def _count(kind, fpc=True):
    def run(spark, sf):
        t = rep_design(spark, sf, kind, fpc).survey_count("grp3", df=INF)
        return t.select("grp3", F.round("n", 4).alias("n"), F.round("n_se", 5).alias("n_se"))
    return run


query("h01_brr_mean", mean_rep_sql("BRR"))(_mean("BRR"))
query("h01_brr_count", count_rep_sql("BRR"))(_count("BRR"))
query("h03_fay_mean", mean_rep_sql("Fay"))(_mean("Fay"))
query("h03_fay_count", count_rep_sql("Fay"))(_count("Fay"))
query("h04_jkn_mean", mean_rep_sql("JKn"))(_mean("JKn"))
query("h04_jkn_mean_no_fpc", mean_rep_sql("JKn0"))(_mean("JKn", False))
query("h05_bootstrap_mean", mean_rep_sql("bootstrap"))(_mean("bootstrap"))
query("h05_bootstrap_mean_no_fpc", mean_rep_sql("bootstrap0"))(_mean("bootstrap", False))
query("h06_jkn_count", count_rep_sql("JKn"))(_count("JKn"))
query("h06_bootstrap_count", count_rep_sql("bootstrap"))(_count("bootstrap"))
query("h07_jkn_grouped_mean", mean_rep_sql("JKn", "female"))(_mean("JKn", groups=("female",)))
query("h07_brr_grouped_mean", mean_rep_sql("BRR", "female"))(_mean("BRR", groups=("female",)))
query("h07_bootstrap_grouped_mean", mean_rep_sql("bootstrap", "female"))(_mean("bootstrap", groups=("female",)))


@query("h02_brr_odd_strata", with_orders("SELECT max(n_h % 2) = 1 refused FROM h"))
def h02(spark, sf):
    """Half-samples are refused as long as a stratum has an odd number of PSUs."""
    design = order_design(spark, sf)
    try:
        as_rep(design, "BRR")
        refused = False
    except ValueError:
        refused = True
    return design.strata().agg(F.lit(refused).alias("refused"))


@query("h06_jkn_total", rep_sql("JKn0", "'x'", "y", "a").format(
    out="""round(est, 4) total, round(se, 5) se, round(est - 1.959963984540054 * se, 4) low,
 round(est + 1.959963984540054 * se, 4) upp"""))
def h06(spark, sf):
    t = rep_design(spark, sf, "JKn", False).survey_total("y")
    return t.select(F.round("total", 4).alias("total"), F.round("se", 5).alias("se"),
                    F.round("low", 4).alias("low"), F.round("upp", 4).alias("upp"))


@query("h07_jkn_many_means", "SELECT * FROM (" + ") UNION ALL SELECT * FROM (".join(
    rep_sql("JKn", "'x'", v, "a / b").format(out=f"'{v}' variable, round(est, 8) mean, round(se, 8) se")
    for v in ("happy", "spend", "y", "age_m")) + ")")
def h07(spark, sf):
    t = rep_design(spark, sf, "JKn").survey_means(["happy", "spend", "y", "age_m"], df=INF)
    return t.select("variable", F.round("mean", 8).alias("mean"), F.round("se", 8).alias("se"))


@query("h08_with_replicates_ratio", with_orders("""pc AS (SELECT strata, cluster, 'x' k, sum(w * y) a, sum(w * cnt) b FROM d GROUP BY ALL), """
       + SCHEME["JKn"] + """, tv AS (SELECT ln(a / b) v, rscale FROM rt), tc AS (SELECT avg(v) c FROM tv)
SELECT round((SELECT ln(a / b) FROM ft), 8) estimate, round(sqrt(sum(rscale * (v - c) * (v - c))), 8) se FROM tv, tc"""))
def h08(spark, sf):
    rep = rep_design(spark, sf, "JKn")
    psu = rep.design.domain_rows().groupBy(STR, PSU, F.lit("x").alias("k")).agg(
        F.sum(F.col(WT) * F.col("y")).alias("a"), F.sum(F.col(WT) * F.col("cnt")).alias("b"))
    t = rep.with_replicates(psu, ["k"], ["a", "b"], lambda v: F.log(v("a") / v("b")))
    return t.select(F.round("estimate", 8).alias("estimate"), F.round("se", 8).alias("se"))


_H09 = ("happy", "cnt", "y")


@query("h09_replicate_vcov", with_orders(", ".join(
    f"{cells_sql(chr(39) + v + chr(39), v)}".replace("pc AS", f"pc_{v} AS") for v in _H09)
    + ", pc AS (" + " UNION ALL ".join(f"SELECT * FROM pc_{v}" for v in _H09) + "), " + SCHEME["bootstrap"] + """,
tv AS (SELECT rep, k, a / b v, rscale FROM rt), tc AS (SELECT k, avg(v) c FROM tv GROUP BY k),
ce AS (SELECT rep, k, v - c z, rscale, c FROM tv JOIN tc USING (k))
SELECT x.k a, y.k b, round(sum(x.rscale * x.z * y.z), 10) cov, round(min(x.c), 8) mean_a
FROM ce x JOIN ce y USING (rep) GROUP BY x.k, y.k"""))
def h09(spark, sf):
    rep = rep_design(spark, sf, "bootstrap")
    t = replicate_vcov(rep.replicate_means(_H09), "variable", _H09)
    return t.select("a", "b", F.round("cov", 10).alias("cov"), F.round("mean_a", 8).alias("mean_a"))


@query("h10_method_comparison", "SELECT * FROM (" + ") UNION ALL SELECT * FROM (".join(
    [with_orders(mean_sql("happy", "female") + """ SELECT 'HT' AS "method", female, round(mean, 8) mean, round(sqrt(v), 8) se
     FROM mt JOIN mv USING (female)""")]
    + [rep_sql(kind, "female", "happy", "a / b").format(
        out=f"'{name}' AS \"method\", k female, round(est, 8) mean, round(se, 8) se")
       for kind, name in (("JKn", "JRR"), ("bootstrap", "Bootstrap"))]) + ")")
def h10(spark, sf):
    tables = {
        "HT": E.survey_means(order_design(spark, sf).group_by("female"), ["happy"], df=INF),
        "JRR": rep_design(spark, sf, "JKn").group_by("female").survey_means(["happy"], df=INF),
        "Bootstrap": rep_design(spark, sf, "bootstrap").group_by("female").survey_means(["happy"], df=INF),
    }
    t = union_tagged({k: v.select("female", "mean", "se") for k, v in tables.items()}, "method")
    return t.select("method", "female", F.round("mean", 8).alias("mean"), F.round("se", 8).alias("se"))


@query("h11_replicate_df", with_orders(f"""SELECT 'JKn' AS "method", CAST(sum(n_h) - count(*) AS BIGINT) df FROM h
UNION ALL SELECT 'BRR', CAST(sum(n_h // 2) AS BIGINT) FROM h WHERE n_h % 2 = 0
UNION ALL SELECT 'bootstrap', CAST(least({BOOT - 1}, sum(n_h) - count(*)) AS BIGINT) FROM h"""))
def h11(spark, sf):
    rows = [(k, int(rep_design(spark, sf, k).scheme()["df"])) for k in ("JKn", "BRR", "bootstrap")]
    return spark.createDataFrame(rows, "method string, df bigint")


def _share_sql(kind, name):
    return rep_sql(kind, "female || sad", "1", "a").format(
        out=f"'{name}' AS \"method\", substr(k, 1, 1) female, CAST(substr(k, 2, 1) AS INTEGER) sad, round(est, 4) n, round(se, 5) n_se")


@query("h10_share_comparison", "SELECT *, round(n / sum(n) OVER (PARTITION BY \"method\", female), 8) prop FROM ((" + ") UNION ALL (".join(
    _share_sql(kind, name) for kind, name in (("JKn", "JRR"), ("bootstrap", "Bootstrap"))) + "))")
def h10b(spark, sf):
    tables = {name: rep_design(spark, sf, kind).group_by("female").survey_count("sad", prop=True, df=INF)
              for kind, name in (("JKn", "JRR"), ("bootstrap", "Bootstrap"))}
    t = union_tagged(tables, "method")
    return t.select("method", "female", "sad", F.round("n", 4).alias("n"), F.round("n_se", 5).alias("n_se"),
                    F.round("prop", 8).alias("prop"))


# -- vectors of replicate weights: totals without a table of PSUs by replicates, and refits of any estimator ------------
def _split_mean(draws):
    def run(spark, sf):
        rep = as_rep(order_design(spark, sf), "bootstrap", replicates=draws, seed=7)
        cells = E.mean_cells(rep.design, {"happy": F.col("happy")}, False)
        reps = replicate_totals(rep, cells, ["variable"], ["sw", "swx"]).withColumn("v", F.col("swx") / F.col("sw"))
        full = F.first(F.col("full_swx") / F.col("full_sw"))
        return reps.groupBy("variable").agg(
            F.round(full, 8).alias("mean"), F.round(F.sqrt(F.first("rscale") * F.var_pop("v") * F.count("v")), 8).alias("se"), F.count("v").alias("draws"))
    return run


query("h05_split_bootstrap_mean")(_split_mean(100))
query("h05_split_bootstrap_mean_1000")(_split_mean(1000))


@query("h03_fay_mean_by_vectors", mean_rep_sql("Fay"))
def h03_vectors(spark, sf):
    rep = rep_design(spark, sf, "Fay")
    cells = E.mean_cells(rep.design, {"happy": F.col("happy")}, False)
    reps = replicate_totals(rep, cells, ["variable"], ["sw", "swx"]).withColumn("v", F.col("swx") / F.col("sw"))
    return reps.groupBy("variable").agg(
        F.round(F.first(F.col("full_swx") / F.col("full_sw")), 8).alias("mean"),
        F.round(F.sqrt(F.first("rscale") * F.var_pop("v") * F.count("v")), 8).alias("se")).drop("variable")


def _moments_sql(rho, moments):
    """rt and ft with one key for each moment; d has the rows."""
    parts = " UNION ALL ".join(f"SELECT strata, cluster, '{k}' k, sum(w * ({x})) a, 0.0 b FROM d GROUP BY ALL" for k, x in moments.items())
    return f"pc AS ({parts}), {half_sql(rho)}"


_SUMS = {"n": "1", "x": "cnt", "y": "y", "xx": "cnt * cnt", "xy": "cnt * y"}
_PICK = ", ".join(f"max(CASE WHEN k = '{k}' THEN a END) {k}" for k in _SUMS)
_LINE = "(n * xy - x * y) / (n * xx - x * x)"


@query("h08_refit_linear_fay", with_orders(_moments_sql(0.3, _SUMS) + f""",
rw AS (SELECT rep, min(rscale) rscale, {_PICK} FROM rt GROUP BY rep), fw AS (SELECT {_PICK} FROM ft),
rb AS (SELECT rscale, {_LINE} b, (y - {_LINE} * x) / n a FROM rw), fb AS (SELECT {_LINE} b, (y - {_LINE} * x) / n a FROM fw)
SELECT 'cnt' term, round((SELECT b FROM fb), 8) estimate, round(sqrt(min(rscale) * var_pop(b) * count(*)), 8) std_error FROM rb
UNION ALL SELECT '(Intercept)', round((SELECT a FROM fb), 8), round(sqrt(min(rscale) * var_pop(a) * count(*)), 8) FROM rb"""))
def h08_linear(spark, sf):
    """A linear model refitted in every Fay replicate."""
    fit, values = replicate_glm(rep_design(spark, sf, "Fay"), "y", ["cnt"])
    t = replicate_table(fit, values)
    return t.select("term", F.round("estimate", 8).alias("estimate"), F.round("std_error", 8).alias("std_error"))


_CELLS = {f"c{f}{s}": f"CASE WHEN female = '{f}' AND sad = {s} THEN 1 ELSE 0 END" for f in "01" for s in (0, 1)}
_CELL_PICK = ", ".join(f"max(CASE WHEN k = '{k}' THEN a END) {k}" for k in _CELLS)


@query("h08_refit_logit_brr", with_orders(_moments_sql(0.0, _CELLS) + f""",
rw AS (SELECT rep, min(rscale) rscale, {_CELL_PICK} FROM rt GROUP BY rep), fw AS (SELECT {_CELL_PICK} FROM ft),
rb AS (SELECT rscale, ln(c01 / c00) a, ln(c11 / c10) - ln(c01 / c00) b FROM rw)
SELECT '(Intercept)' term, (SELECT round(ln(c01 / c00), 6) FROM fw) estimate, round(sqrt(min(rscale) * var_pop(a) * count(*)), 6) std_error FROM rb
UNION ALL SELECT 'female1', (SELECT round(ln(c11 / c10) - ln(c01 / c00), 6) FROM fw), round(sqrt(min(rscale) * var_pop(b) * count(*)), 6) FROM rb"""))
def h08_logit(spark, sf):
    """A logit model refitted in every half-sample."""
    fit, values = replicate_glm(rep_design(spark, sf, "BRR"), "sad", ["female"], "binomial", {"female": ["0", "1"]})
    t = replicate_table(fit, values)
    return t.select("term", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"))


@query("h08_refit_ordinal_bootstrap")
def h08_ordinal(spark, sf):
    """A cumulative logit model refitted in 100 bootstrap replicates."""
    rep = as_rep(order_design(spark, sf), "bootstrap", replicates=100, seed=7)
    return replicate_table(*replicate_ordinal(rep, "happy", ["y", "cnt"], [1.0, 2.0, 3.0, 4.0, 5.0]))
