"""Design (F) and Taylor-estimate (G) queries."""

from pyspark.sql import functions as F

from designstats.functions.dist import INF
from designstats.operators import estimate as E
from designstats.operators.design import Design
from designstats.plans.fixtures import (
    DF_SQL, line_design, line_sql, order_design, order_rows, tq_sql, tv_sql, with_orders,
)
from designstats.plans.registry import query
from designstats.operators.frame import null_safe_join

def mean_cols():
    return [F.round("mean", 8).alias("mean"), F.round("se", 8).alias("se")]


def mean_sql(x: str, groups: str = "", where: str = "TRUE", fpc: bool = True) -> str:
    """CTEs mc, mt, mp, mv: cells, totals, PSU influence and variance of a mean."""
    k = f"{groups}, " if groups else ""
    gb = f"GROUP BY {groups}" if groups else ""
    on = f"USING ({groups})" if groups else "ON TRUE"
    return f"""mc AS (SELECT strata, cluster, {k}sum(w) sw, sum(w * {x}) swx, count(*) n FROM d
             WHERE ({where}) AND ({x}) IS NOT NULL GROUP BY {k}strata, cluster),
mt AS (SELECT {k}sum(sw) nhat, sum(swx) / sum(sw) mean, CAST(sum(n) AS BIGINT) n FROM mc {gb}),
mp AS (SELECT strata, cluster, {k}(swx - mean * sw) / nhat t FROM mc JOIN mt {on}),
mv AS ({tv_sql('mp', keys=groups, fpc=fpc)})"""


# -- designs -----------------------------------------------------------------
@query("f01_design_validate", with_orders(
    "SELECT strata, CAST(n_h AS BIGINT) n_h, CAST(f_h AS DOUBLE) f_h FROM h"))
def f01(spark, sf):
    design = Design.of(order_rows(spark, sf), "cluster", "strata", "w", "fpc")
    return design.strata().select(F.col("__str").alias("strata"), "n_h", "f_h")


@query("f02_fpc_fraction", with_orders(
    "SELECT strata, CAST(n_h AS BIGINT) n_h, CAST(0.25 AS DOUBLE) f_h FROM h"))
def f02(spark, sf):
    design = Design.of(order_rows(spark, sf), "cluster", "strata", "w", F.lit(0.25), validate=False)
    return design.strata().select(F.col("__str").alias("strata"), "n_h", "f_h")


@query("f03_design_summary", with_orders("""s AS (SELECT strata, cluster, count(*) r FROM d GROUP BY ALL),
t AS (SELECT strata, count(*) c, sum(r) r FROM s GROUP BY strata)
SELECT CAST(sum(r) AS BIGINT) n_rows, CAST(sum(c) AS BIGINT) n_psu, count(*) n_strata,
       min(c) min_psu, max(c) max_psu,
       (SELECT quantile_cont(1 / w, 0.25) FROM d) p25, (SELECT quantile_cont(1 / w, 0.5) FROM d) p50,
       (SELECT quantile_cont(1 / w, 0.75) FROM d) p75 FROM t"""))
def f03(spark, sf):
    from designstats.operators.frame import quantile_type7

    design = order_design(spark, sf)
    prob = quantile_type7(design.df.select((1 / F.col("__w")).alias("p")), "p", [0.25, 0.5, 0.75])
    wide = prob.groupBy().pivot("p", [0.25, 0.5, 0.75]).agg(F.first("quantile"))
    one = wide.toDF("p25", "p50", "p75").select(F.struct("p25", "p50", "p75").alias("s")).scalar()
    return design.summary().select("*", one.getField("p25").alias("p25"),
                                   one.getField("p50").alias("p50"), one.getField("p75").alias("p75"))


def _lonely(policy):
    def run(spark, sf):
        design = line_design(spark, sf, True, "s_nationkey", policy)
        return E.survey_mean(design, "qty", df=INF).select(*mean_cols())
    return run


_LONELY_BASE = line_sql("s_nationkey") + """, m AS (SELECT sum(w) nhat, sum(w * qty) / sum(w) mean FROM d),
p AS (SELECT strata, cluster, sum(w * (qty - mean)) / min(nhat) t FROM d, m GROUP BY strata, cluster),
x AS (SELECT strata, sum(t) s, sum(t * t) q FROM p GROUP BY strata)
"""
query("f04_lonely_remove", _LONELY_BASE + """SELECT round((SELECT mean FROM m), 8) mean,
 round(sqrt(sum(CASE WHEN n_h = 1 THEN 0 ELSE (1 - f_h) * n_h / (n_h - 1) * (q - s * s / n_h) END)), 8) se
 FROM x JOIN h USING (strata)""")(_lonely("remove"))
query("f04_lonely_adjust", _LONELY_BASE + """SELECT round((SELECT mean FROM m), 8) mean,
 round(sqrt(sum(CASE WHEN n_h = 1 THEN (1 - f_h) * q ELSE (1 - f_h) * n_h / (n_h - 1) * (q - s * s / n_h) END)), 8) se
 FROM x JOIN h USING (strata)""")(_lonely("adjust"))
query("f04_lonely_average", _LONELY_BASE + """SELECT round((SELECT mean FROM m), 8) mean,
 round(sqrt(sum(CASE WHEN n_h = 1 THEN 0 ELSE (1 - f_h) * n_h / (n_h - 1) * (q - s * s / n_h) END)
       * count(*) / sum(CASE WHEN n_h > 1 THEN 1 ELSE 0 END)), 8) se
 FROM x JOIN h USING (strata)""")(_lonely("average"))


@query("f05_design_mutate", with_orders(mean_sql("(happy * 2 + 1)") +
       " SELECT round(mean, 8) mean, round(sqrt(v), 8) se FROM mt, mv"))
def f05(spark, sf):
    design = order_design(spark, sf).mutate(twice=F.col("happy") * 2, plus=F.col("twice") + 1)
    return E.survey_mean(design, "plus", df=INF).select(*mean_cols())


@query("f06_design_select", with_orders(mean_sql("cnt") +
       " SELECT round(mean, 8) mean, round(sqrt(v), 8) se FROM mt, mv"))
def f06(spark, sf):
    return E.survey_mean(order_design(spark, sf).select("cnt"), "cnt", df=INF).select(*mean_cols())


@query("f07_domain_filter", with_orders(mean_sql("y", where="use_flag = '0'") +
       " SELECT round(mean, 8) mean, round(sqrt(v), 8) se, n FROM mt, mv"))
def f07(spark, sf):
    design = order_design(spark, sf).filter(F.col("use_flag") == "0")
    return E.survey_mean(design, "y", df=INF).select(*mean_cols(), "n")


@query("f08_design_group_by", with_orders(mean_sql("cnt", "grp3") +
       " SELECT grp3, round(mean, 8) mean, round(sqrt(v), 8) se FROM mt JOIN mv USING (grp3)"))
def f08(spark, sf):
    return E.survey_mean(order_design(spark, sf).group_by("grp3"), "cnt", df=INF).select("grp3", *mean_cols())


@query("f09_degf", with_orders(f"SELECT {DF_SQL} df"))
def f09(spark, sf):
    design = order_design(spark, sf)
    return spark.range(1).select(design.degf_col().alias("df"))


@query("f10_design_variables", with_orders("SELECT rid, round(y, 9) y, cnt + 1 up FROM d"))
def f10(spark, sf):
    design = order_design(spark, sf).mutate(up=F.col("cnt") + 1)
    return design.variables.select("rid", F.round("y", 9).alias("y"), "up")


@query("f11_redesign_weight", "WITH " + with_orders(mean_sql("y")).replace("CAST(1 + b.rid % 5 AS DOUBLE) w", "CAST((1 + b.rid % 5) * (1 + b.rid % 3) AS DOUBLE) w")[5:] +
       " SELECT round(mean, 8) mean, round(sqrt(v), 8) se FROM mt, mv")
def f11(spark, sf):
    rows = order_design(spark, sf).variables.withColumn("w2", F.col("w") * (1 + F.col("rid") % 3))
    return E.survey_mean(Design.of(rows, "cluster", "strata", "w2", "fpc", validate=False), "y",
                         df=INF).select(*mean_cols())


@query("f12_even_strata", with_orders(
    "SELECT strata, count(*) n FROM d WHERE strata IN (SELECT strata FROM h WHERE n_h % 2 = 0) GROUP BY strata"))
def f12(spark, sf):
    from designstats.operators.replicate import even_strata

    return even_strata(order_design(spark, sf)).variables.groupBy("strata").agg(F.count(F.lit(1)).alias("n"))


# -- counts and tables ---------------------------------------------------------
COUNT_SQL = f"""cp AS (SELECT strata, cluster, female, sum(w) t FROM d GROUP BY ALL),
cv AS ({tv_sql('cp', keys='female')}),
cn AS (SELECT female, sum(t) n FROM cp GROUP BY female)"""


@query("g01_survey_count", with_orders(COUNT_SQL +
       " SELECT female, n, round(sqrt(v), 6) n_se FROM cn JOIN cv USING (female)"))
def g01(spark, sf):
    table = E.survey_count(order_design(spark, sf), "female")
    return table.select("female", "n", F.round("n_se", 6).alias("n_se"))


@query("g02_count_interval", with_orders(COUNT_SQL + f""" SELECT female, n,
       round(n - {tq_sql(DF_SQL)} * sqrt(v), 5) n_low, round(n + {tq_sql(DF_SQL)} * sqrt(v), 5) n_upp
       FROM cn JOIN cv USING (female)"""))
def g02(spark, sf):
    table = E.survey_count(order_design(spark, sf), "female", ci=True)
    return table.select("female", "n", F.round("n_low", 5).alias("n_low"), F.round("n_upp", 5).alias("n_upp"))


@query("g03_grouped_count_share", with_orders(f"""cp AS (SELECT strata, cluster, female, grp3, sad, sum(w) t FROM d GROUP BY ALL),
cv AS ({tv_sql('cp', keys='female, grp3, sad')}),
cn AS (SELECT female, grp3, sad, sum(t) n FROM cp GROUP BY ALL)
SELECT female, grp3, sad, n, round(sqrt(v), 6) n_se, round(n / sum(n) OVER (PARTITION BY female, grp3), 8) prop
FROM cn JOIN cv USING (female, grp3, sad)"""))
def g03(spark, sf):
    design = order_design(spark, sf).group_by("female", "grp3")
    table = E.survey_count(design, "sad", prop=True)
    return table.select("female", "grp3", "sad", "n", F.round("n_se", 6).alias("n_se"),
                        F.round("prop", 8).alias("prop"))


_G04_VARS = ("female", "grp3", "use_flag")
_G04_SQL = " UNION ALL ".join(
    f"""SELECT '{v}' variable, {v} AS "group", sum(w) cs, CAST(count(*) AS DOUBLE) no,
        sum(w) / (SELECT sum(w) FROM d) pcs, count(*) / (SELECT count(*) FROM d) pno FROM d GROUP BY {v}"""
    for v in _G04_VARS)


@query("g04_factor_report", with_orders(f"""u AS ({_G04_SQL})
SELECT variable, "group", printf('%.0f', cs) || chr(10) || '(' || printf('%.4f', round(pcs, 4)) || ')' AS "YS",
 printf('%.0f', no) || chr(10) || '(' || printf('%.4f', round(pno, 4)) || ')' AS "NO" FROM u"""))
def g04(spark, sf):
    from designstats.operators.report import factor_report

    return factor_report(order_design(spark, sf), _G04_VARS)


# -- means ---------------------------------------------------------------------
@query("g05_survey_mean", with_orders(mean_sql("happy") + f""" SELECT round(mean, 8) mean, round(sqrt(v), 8) se,
 round(v, 10) "var", round(sqrt(v) / mean, 8) cv, round(mean - {tq_sql(DF_SQL)} * sqrt(v), 7) low,
 round(mean + {tq_sql(DF_SQL)} * sqrt(v), 7) upp, n FROM mt, mv"""))
def g05(spark, sf):
    t = E.survey_mean(order_design(spark, sf), "happy")
    return t.select(*mean_cols(), F.round("var", 10).alias("var"), F.round("cv", 8).alias("cv"),
                    F.round("low", 7).alias("low"), F.round("upp", 7).alias("upp"), "n")


@query("g05_mean_missing", with_orders(mean_sql("spend") +
       " SELECT round(mean, 8) mean, round(sqrt(v), 8) se, n FROM mt, mv"))
def g05b(spark, sf):
    return E.survey_mean(order_design(spark, sf), "spend", df=INF).select(*mean_cols(), "n")


@query("g06_mean_level90", with_orders(mean_sql("happy") + """ SELECT round(mean, 8) mean,
 round(mean - 1.6448536269514722 * sqrt(v), 8) low, round(mean + 1.6448536269514722 * sqrt(v), 8) upp FROM mt, mv"""))
def g06(spark, sf):
    t = E.survey_mean(order_design(spark, sf), "happy", level=0.90, df=INF)
    return t.select(F.round("mean", 8).alias("mean"), F.round("low", 8).alias("low"), F.round("upp", 8).alias("upp"))


@query("g07_design_effect", with_orders(mean_sql("happy") + """ SELECT round(mean, 8) mean, round(sqrt(v), 8) se,
 round(v / ((nhat - n) / nhat * ((SELECT sum(w * (happy - mt.mean) * (happy - mt.mean)) FROM d) / nhat * n / (n - 1)) / n), 6) deff
 FROM mt, mv"""))
def g07(spark, sf):
    t = E.survey_mean(order_design(spark, sf), "happy", deff=True, df=INF)
    return t.select(*mean_cols(), F.round("deff", 6).alias("deff"))


@query("g08_grouped_mean", with_orders(mean_sql("y", "female, grp3") + f""" SELECT female, grp3, round(mean, 8) mean,
 round(sqrt(v), 8) se, round(mean - {tq_sql(DF_SQL)} * sqrt(v), 7) low, round(mean + {tq_sql(DF_SQL)} * sqrt(v), 7) upp
 FROM mt JOIN mv USING (female, grp3)"""))
def g08(spark, sf):
    t = E.survey_mean(order_design(spark, sf).group_by("female", "grp3"), "y")
    return t.select("female", "grp3", *mean_cols(), F.round("low", 7).alias("low"), F.round("upp", 7).alias("upp"))


_G09 = ("y", "spend", "happy", "cnt", "age_m")


@query("g09_many_means", "SELECT * FROM (" + ") UNION ALL SELECT * FROM (".join(
    with_orders(mean_sql(v) + f" SELECT '{v}' variable, round(mean, 8) mean, round(sqrt(v), 8) se, n FROM mt, mv")
    for v in _G09) + ")")
def g09(spark, sf):
    t = E.survey_means(order_design(spark, sf), _G09, df=INF)
    return t.select("variable", *mean_cols(), "n")


@query("g10_survey_table", with_orders("SELECT female, grp3, sad, sum(w) n FROM d GROUP BY ALL"))
def g10(spark, sf):
    return E.survey_table(order_design(spark, sf), "female", "grp3", "sad")


@query("g11_prop_table_margin", with_orders("""t AS (SELECT sad, female, sum(w) n FROM d WHERE grp3 = 'A' GROUP BY ALL)
SELECT sad, female, round(n / sum(n) OVER (PARTITION BY female), 8) prop FROM t"""))
def g11(spark, sf):
    design = order_design(spark, sf).subset(F.col("grp3") == "A")
    t = E.prop_table(E.survey_table(design, "sad", "female"), ["female"])
    return t.select("sad", "female", F.round("prop", 8).alias("prop"))


@query("g12_survey_var", with_orders("""m AS (SELECT sum(w * y) / sum(w) m, sum(w) nhat, count(*) n FROM d),
zp AS (SELECT strata, cluster, sum(w * ((y - m) * (y - m) * n / (n - 1) - vv)) / min(nhat) t FROM d, m,
  (SELECT sum(w * (y - m) * (y - m)) / sum(w) * min(n) / (min(n) - 1) vv FROM d, m) GROUP BY ALL),
zv AS (""" + tv_sql("zp") + """)
SELECT round((SELECT sum(w * (y - m) * (y - m)) / sum(w) * min(n) / (min(n) - 1) FROM d, m), 8) variance,
 round(sqrt(v), 8) se FROM zv"""))
def g12(spark, sf):
    t = E.survey_var(order_design(spark, sf), "y")
    return t.select(F.round("variance", 8).alias("variance"), F.round("se", 8).alias("se"))


@query("g13_survey_total", with_orders(f"""zp AS (SELECT strata, cluster, female, sum(w * y) t FROM d GROUP BY ALL),
zv AS ({tv_sql('zp', keys='female')}), zt AS (SELECT female, sum(t) total FROM zp GROUP BY female)
SELECT female, round(total, 4) total, round(sqrt(v), 5) se, round(total - 1.959963984540054 * sqrt(v), 4) low,
 round(total + 1.959963984540054 * sqrt(v), 4) upp FROM zt JOIN zv USING (female)"""))
def g13(spark, sf):
    t = E.survey_total(order_design(spark, sf).group_by("female"), "y")
    return t.select("female", F.round("total", 4).alias("total"), F.round("se", 5).alias("se"),
                    F.round("low", 4).alias("low"), F.round("upp", 4).alias("upp"))


@query("g14_mean_normal_interval", with_orders(mean_sql("happy", "female") + """ SELECT female, round(mean, 8) mean,
 round(mean - 1.959963984540054 * sqrt(v), 8) low, round(mean + 1.959963984540054 * sqrt(v), 8) upp
 FROM mt JOIN mv USING (female)"""))
def g14(spark, sf):
    t = E.survey_mean(order_design(spark, sf).group_by("female"), "happy", df=INF)
    return t.select("female", F.round("mean", 8).alias("mean"), F.round("low", 8).alias("low"),
                    F.round("upp", 8).alias("upp"))


@query("g15_survey_quantile", with_orders("""c AS (SELECT y x, sum(sum(w)) OVER (ORDER BY y) cw FROM d GROUP BY y),
p AS (SELECT unnest([0.25, 0.5, 0.75]) p)
SELECT CAST(p AS DOUBLE) p, round(min(x), 8) quantile FROM p, c WHERE cw >= p * (SELECT sum(w) FROM d) GROUP BY p"""))
def g15(spark, sf):
    t = E.survey_quantile(order_design(spark, sf), "y", [0.25, 0.5, 0.75])
    return t.select("p", F.round("quantile", 8).alias("quantile"))


@query("g16_survey_histogram", with_orders("""a AS (SELECT w, least(greatest(ceil((age_m - 150) / 5) - 1, 0), 11) k FROM d WHERE age_m IS NOT NULL)
SELECT CAST(k AS INTEGER) bin, 150 + (k + 0.5) * 5 mids, round(sum(w) / (SELECT sum(w) FROM a) / 5, 8) density FROM a GROUP BY k"""))
def g16(spark, sf):
    rows = order_design(spark, sf).domain_rows()
    t = E.histogram(rows, "age_m", [150 + 5 * i for i in range(13)], "__w")
    return t.select("bin", "mids", F.round("density", 8).alias("density"))


@query("g17_weight_share_identity", with_orders("""SELECT female, sum(w) n, round(sum(w) / (SELECT sum(w) FROM d), 8) prop,
 TRUE same FROM d GROUP BY female"""))
def g17(spark, sf):
    design = order_design(spark, sf)
    plain = design.variables.groupBy("female").agg(F.sum("w").alias("sw"))
    t = null_safe_join(E.survey_count(design, "female", prop=True), plain, ["female"])
    return t.select("female", "n", F.round("prop", 8).alias("prop"),
                    (F.abs(F.col("n") - F.col("sw")) < 1e-9 * F.col("n")).alias("same"))


@query("g19_interval_width", with_orders(mean_sql("happy") +
       " SELECT round(mean, 8) mean, round(2 * 1.959963984540054 * sqrt(v), 8) AS \"range\" FROM mt, mv"))
def g19(spark, sf):
    t = E.survey_mean(order_design(spark, sf), "happy", df=INF)
    return t.select(F.round("mean", 8).alias("mean"), F.round(F.col("upp") - F.col("low"), 8).alias("range"))


@query("g08_few_psus", line_sql() + ", " + mean_sql("qty", "flag") +
       " SELECT flag, round(mean, 8) mean, round(sqrt(v), 8) se, n FROM mt JOIN mv USING (flag)")
def g08b(spark, sf):
    return E.survey_mean(line_design(spark, sf).group_by("flag"), "qty", df=INF).select("flag", *mean_cols(), "n")
