"""Association (I), regression (J) and prediction (K) queries."""

from functools import lru_cache

from pyspark.sql import functions as F

from designstats.functions.dist import INF
from designstats.operators import assoc as A
from designstats.operators import estimate as E
from designstats.operators import glm as G
from designstats.operators.categorical import multinomial, multinomial_replicates, negbin, ordinal
from designstats.operators.frame import prediction_grid
from designstats.operators.predict import (
    band, predict, predict_multinomial, predict_ordinal, predict_response,
)
from designstats.operators.replicate import as_rep, replicate_vcov
from designstats.operators.terms import cross, expand, inter, power
from designstats.plans.fixtures import DF_SQL, order_design, order_rows, tv_sql, with_orders
from designstats.plans.q_estimate import mean_sql
from designstats.plans.registry import query

LEVELS = {"female": ["0", "1"], "grp3": ["A", "B", "C"], "use_flag": ["0", "1"]}


def rounded(table, digits=6, **special):
    """Round every double column."""
    out = []
    for f in table.schema.fields:
        if f.dataType.typeName() == "double":
            out.append(F.round(f.name, special.get(f.name, digits)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return table.select(*out)


def row_frame(spark, **values):
    """One-row result table."""
    names = list(values)
    kinds = {float: "double", int: "bigint", str: "string", bool: "boolean"}
    clean = [v.item() if hasattr(v, "item") else v for v in values.values()]
    schema = ", ".join(f"`{n}` {kinds[type(v)]}" for n, v in zip(names, clean))
    return spark.createDataFrame([tuple(clean)], schema)


# -- I: association ----------------------------------------------------------------------
_CHI_BASE = """t AS (SELECT female a, CAST(sad AS VARCHAR) b, count(*) o FROM d WHERE use_flag = '0' GROUP BY ALL),
e AS (SELECT a, b, o, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / CAST(sum(o) OVER () AS DOUBLE) e FROM t)"""


@query("i01_pearson_chisq", with_orders(_CHI_BASE + """, g AS (SELECT least(0.5, min(abs(o - e))) c FROM e)
SELECT round(sum(power(abs(o - e) - c, 2) / e), 6) statistic, CAST(1 AS BIGINT) df FROM e, g"""))
def i01(spark, sf):
    r = A.chisq_counts(order_rows(spark, sf).where("use_flag = '0'"), "female", "sad")
    return rounded(row_frame(spark, statistic=r["statistic"], df=r["df"]))


# 2 x 2 closed forms in the domain use_flag = '0'
_CHI2 = f"""k AS (SELECT d.*, CASE WHEN female = '1' AND sad = 1 THEN 1.0 ELSE 0.0 END c11,
   CASE WHEN female = '1' THEN 1.0 ELSE 0.0 END r1, CASE WHEN sad = 1 THEN 1.0 ELSE 0.0 END s1 FROM d WHERE use_flag = '0'),
m AS (SELECT sum(w) nhat, count(*) n, sum(w * c11) / sum(w) p11, sum(w * r1) / sum(w) pr, sum(w * s1) / sum(w) pc FROM k),
wp AS (SELECT strata, cluster, sum(w * ((c11 - p11) - (r1 - pr) * pc - (s1 - pc) * pr)) / min(nhat) t FROM k, m GROUP BY ALL),
wv AS ({tv_sql('wp')}),
wald AS (SELECT (p11 - pr * pc) * (p11 - pr * pc) / v stat FROM m, wv),
pe AS (SELECT n * power(p11 - pr * pc, 2) * (1 / (pr * pc) + 1 / ((1 - pr) * pc) + 1 / (pr * (1 - pc)) + 1 / ((1 - pr) * (1 - pc))) x2,
   p11 q11, pr - p11 q10, pc - p11 q01, 1 - pr - pc + p11 q00, n, nhat FROM m),
lp AS (SELECT strata, cluster, sum(w * (CASE WHEN r1 = 1 AND s1 = 1 THEN 1 / q11 WHEN r1 = 1 THEN -1 / q10
   WHEN s1 = 1 THEN -1 / q01 ELSE 1 / q00 END)) / min(nhat) t FROM k, pe GROUP BY ALL),
lv AS ({tv_sql('lp')}),
de AS (SELECT x2, v / ((1 / q11 + 1 / q10 + 1 / q01 + 1 / q00) / n) delta FROM pe, lv)"""


@lru_cache(maxsize=8)
def _chi(spark, sf):
    design = order_design(spark, sf).filter(F.col("use_flag") == "0")
    return A.survey_chisq(design, "female", "sad")


def _chi_query(stat):
    def run(spark, sf):
        r = _chi(spark, sf)[stat]
        return rounded(row_frame(spark, statistic=r["statistic"], df1=float(r["df1"])))
    return run


query("i02_wald", with_orders(_CHI2 + " SELECT round(stat, 6) statistic, CAST(1 AS DOUBLE) df1 FROM wald"))(_chi_query("Wald"))
query("i03_adjusted_wald", with_orders(_CHI2 + " SELECT round(stat, 6) statistic, CAST(1 AS DOUBLE) df1 FROM wald"))(_chi_query("adjWald"))


@query("i04_rao_scott_first", with_orders(_CHI2 + " SELECT round(x2, 6) statistic, round(delta, 6) deltabar FROM de"))
def i04(spark, sf):
    r = _chi(spark, sf)["Chisq"]
    return rounded(row_frame(spark, statistic=r["statistic"], deltabar=r["deltabar"]))


query("i05_rao_scott_second", with_orders(_CHI2 + " SELECT round(x2 / delta, 6) statistic, CAST(1 AS DOUBLE) df1 FROM de"))(_chi_query("F"))


@query("i06_lincom", with_orders(_CHI2 + " SELECT round(x2, 6) statistic, TRUE equals_f FROM de"))
def i06(spark, sf):
    """With one eigenvalue the exact mixture tail is an F tail."""
    r = _chi(spark, sf)
    same = bool(abs(r["lincom"]["p"] - r["F"]["p"]) < 1e-6)
    return rounded(row_frame(spark, statistic=float(r["lincom"]["statistic"]), equals_f=same))


@query("i07_saddlepoint", with_orders(_CHI2 + " SELECT round(x2, 6) statistic, TRUE near_exact FROM de"))
def i07(spark, sf):
    r = _chi(spark, sf)
    near = bool(abs(r["saddlepoint"]["p"] - r["lincom"]["p"]) < 0.05)
    return rounded(row_frame(spark, statistic=float(r["saddlepoint"]["statistic"]), near_exact=near))


@query("i08_chisq_comparison")
def i08(spark, sf):
    return A.chisq_comparison(order_design(spark, sf).filter(F.col("use_flag") == "0"), "grp3", "sad")


_T = "round(estimate, 6) estimate, round(se, 6) se, round(df, 4) df, round(estimate / se, 5) t"


def _t(table):
    return table.select(F.round("estimate", 6).alias("estimate"), F.round("se", 6).alias("se"),
                        F.round("df", 4).alias("df"), F.round("t", 5).alias("t"))


def _ttest_sql(x):
    return with_orders(f"""q AS (SELECT avg({x}) estimate, stddev_samp({x}) / sqrt(count({x})) se, CAST(count({x}) - 1 AS DOUBLE) df FROM d)
SELECT {_T} FROM q""")


def _svy_ttest_sql(x):
    return with_orders(mean_sql(f"({x})") + f", q AS (SELECT mean estimate, sqrt(v) se, {DF_SQL} df FROM mt, mv) SELECT {_T} FROM q")


query("i09_one_sample_t", _ttest_sql("(happy - 2)"))(lambda s, f: _t(A.t_test(order_rows(s, f), "happy", 2.0)))
query("i09_survey_one_sample_t", _svy_ttest_sql("happy - 2"))(lambda s, f: _t(A.survey_t_test(order_design(s, f), "happy", 2.0)))
query("i10_paired_t", _ttest_sql("(item1 - item2)"))(lambda s, f: _t(A.t_test(order_rows(s, f), F.col("item1") - F.col("item2"))))
query("i10_survey_paired_t", _svy_ttest_sql("item1 - item2"))(
    lambda s, f: _t(A.survey_t_test(order_design(s, f), F.col("item1") - F.col("item2"))))
query("i11_welch_t", with_orders(f"""g AS (SELECT avg(y) FILTER (female = '0') m1, avg(y) FILTER (female = '1') m2,
 var_samp(y) FILTER (female = '0') / count(*) FILTER (female = '0') e1, var_samp(y) FILTER (female = '1') / count(*) FILTER (female = '1') e2,
 count(*) FILTER (female = '0') n1, count(*) FILTER (female = '1') n2 FROM d),
q AS (SELECT m2 - m1 estimate, sqrt(e1 + e2) se, power(e1 + e2, 2) / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1)) df FROM g)
SELECT {_T} FROM q"""))(lambda s, f: _t(A.welch_test(order_rows(s, f), "y", "female", "0", "1")))


@query("i11_survey_two_sample", with_orders(f"""m AS (SELECT female, sum(w) nh, sum(w * y) / sum(w) mean FROM d GROUP BY female),
zp AS (SELECT strata, cluster, sum(CASE WHEN female = '1' THEN 1 ELSE -1 END * w * (y - mean) / nh) t FROM d JOIN m USING (female) GROUP BY ALL),
zv AS ({tv_sql('zp')}),
q AS (SELECT (SELECT mean FROM m WHERE female = '1') - (SELECT mean FROM m WHERE female = '0') estimate, sqrt(v) se, {DF_SQL} - 1 df FROM zv)
SELECT {_T} FROM q"""))
def i11b(spark, sf):
    r = A.survey_two_sample(order_design(spark, sf), "y", "female", "0", "1")
    return _t(row_frame(spark, estimate=r["estimate"], se=r["se"], df=r["df"], t=r["t"]))


@query("i12_pearson_r", with_orders("""q AS (SELECT corr(item1, item2) r, count(*) n FROM d)
SELECT round(r, 8) r, round(r * sqrt((n - 2) / (1 - r * r)), 5) t, CAST(n - 2 AS DOUBLE) df FROM q"""))
def i12(spark, sf):
    return rounded(A.correlation_test(order_rows(spark, sf), "item1", "item2"), r=8, t=5)


@query("i13_weighted_r", with_orders("""m AS (SELECT sum(w * item1) / sum(w) a, sum(w * item2) / sum(w) b, count(*) n FROM d),
q AS (SELECT sum(w * (item1 - a) * (item2 - b)) / sqrt(sum(w * (item1 - a) * (item1 - a)) * sum(w * (item2 - b) * (item2 - b))) r, min(n) n FROM d, m)
SELECT round(r, 8) r, round(r / sqrt((1 - r * r) / (n - 2)), 5) t, CAST(n - 2 AS DOUBLE) df FROM q"""))
def i13(spark, sf):
    return rounded(A.survey_correlation(order_design(spark, sf), "item1", "item2"), r=8, t=5)


@query("i14_tile_counts", with_orders(f"""cp AS (SELECT strata, cluster, happy, cnt, sum(w) t FROM d GROUP BY ALL),
cv AS ({tv_sql('cp', keys='happy, cnt')}), cn AS (SELECT happy, cnt, sum(t) n FROM cp GROUP BY ALL)
SELECT happy, cnt, n, round(sqrt(v), 6) n_se FROM cn JOIN cv USING (happy, cnt)"""))
def i14(spark, sf):
    return rounded(E.survey_count(order_design(spark, sf), "happy", "cnt"))


def _cov(a, b):
    return f"covar_samp({a}, {b})"


_V3 = "(var_samp(item1) + var_samp(item2) + var_samp(item3))"


@query("i15_cronbach_alpha", with_orders(f"""q AS (SELECT 1.5 * (1 - {_V3} / var_samp(item1 + item2 + item3)) raw_alpha,
 (corr(item1, item2) + corr(item1, item3) + corr(item2, item3)) / 3 r,
 2 * (1 - (var_samp(item2) + var_samp(item3)) / var_samp(item2 + item3)) drop1 FROM d)
SELECT round(raw_alpha, 6) raw_alpha, round(3 * r / (1 + 2 * r), 6) std_alpha, round(r, 6) average_r, round(drop1, 6) drop1 FROM q"""))
def i15(spark, sf):
    r = A.cronbach_alpha(order_rows(spark, sf), ["item1", "item2", "item3"])
    return rounded(row_frame(spark, raw_alpha=float(r["raw_alpha"]), std_alpha=float(r["std_alpha"]),
                             average_r=float(r["average_r"]), drop1=float(r["dropped"]["item1"])))


@query("i16_survey_alpha", with_orders("""m AS (SELECT sum(w * item1) / sum(w) a, sum(w * item2) / sum(w) b, sum(w * item3) / sum(w) c FROM d WHERE use_flag = '1')
SELECT round(1.5 * (1 - sum(w * (power(item1 - a, 2) + power(item2 - b, 2) + power(item3 - c, 2))) /
 sum(w * power(item1 + item2 + item3 - a - b - c, 2))), 6) alpha FROM d, m WHERE use_flag = '1'"""))
def i16(spark, sf):
    design = order_design(spark, sf).filter(F.col("use_flag") == "1")
    return rounded(row_frame(spark, alpha=A.survey_alpha(design, ["item1", "item2", "item3", "item3"])))


# -- J: regressions ------------------------------------------------------------------------
def _tidy(spark, fit, stat=False):
    cols = ["term", "estimate", "std_error"] + (["statistic"] if stat else [])
    return rounded(fit.tidy(spark).select(*cols), 6, statistic=4)


@query("j01_term_expansion", with_orders("""SELECT rid, CASE WHEN grp3 = 'B' THEN 1.0 ELSE 0.0 END "grp3B", CASE WHEN grp3 = 'C' THEN 1.0 ELSE 0.0 END "grp3C",
 happy, happy * happy "happy^2", happy * cnt "happy:cnt", happy * happy * cnt "happy^2:cnt" FROM d"""))
def j01(spark, sf):
    d = order_rows(spark, sf)
    columns = expand(d, ["grp3", "happy", power("happy", 2), inter("happy", "cnt"), inter(power("happy", 2), "cnt")], False, LEVELS)
    return d.select("rid", *[c.alias(n) for n, c in columns])


_OLS = """q AS (SELECT regr_slope(y, cnt) b, regr_intercept(y, cnt) a, count(*) n, regr_sxx(y, cnt) sxx, avg(cnt) mx FROM d),
s AS (SELECT sum(power(y - a - b * cnt, 2)) rss, sum(power(y - (SELECT avg(y) FROM d), 2)) tss FROM d, q)"""


@query("j02_ols", with_orders(_OLS + """ SELECT 'cnt' term, round(b, 6) estimate, round(sqrt(rss / (n - 2) / sxx), 6) std_error FROM q, s
UNION ALL SELECT '(Intercept)', round(a, 6), round(sqrt(rss / (n - 2) * (1.0 / n + mx * mx / sxx)), 6) FROM q, s"""))
def j02(spark, sf):
    return _tidy(spark, G.glm(order_rows(spark, sf), "y", ["cnt"]))


@query("j02_ols_r2", with_orders(_OLS + " SELECT round(1 - rss / tss, 8) r2, round(sqrt(rss / (n - 2)), 6) sigma FROM q, s"))
def j02b(spark, sf):
    d = order_rows(spark, sf)
    fit, null = G.glm(d, "y", ["cnt"]), G.glm(d, "y", [])
    return rounded(row_frame(spark, r2=float(G.r_squared(fit, null)), sigma=float(fit.dispersion**0.5)), r2=8)


_WLS = """q AS (SELECT sum(w) sw, sum(w * cnt) sx, sum(w * cnt * cnt) sxx, sum(w * y) sy, sum(w * cnt * y) sxy, count(*) n FROM d),
c AS (SELECT *, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) b, sw * sxx - sx * sx det FROM q),
k AS (SELECT *, (sy - b * sx) / sw a FROM c)"""


@query("j03_weighted_ols", with_orders(_WLS + """, s AS (SELECT sum(w * power(y - a - b * cnt, 2)) / (min(n) - 2) s2 FROM d, k)
SELECT 'cnt' term, round(b, 6) estimate, round(sqrt(s2 * sw / det), 6) std_error FROM k, s
UNION ALL SELECT '(Intercept)', round(a, 6), round(sqrt(s2 * sxx / det), 6) FROM k, s"""))
def j03(spark, sf):
    return _tidy(spark, G.glm(order_rows(spark, sf), "y", ["cnt"], weights="w"))


_SVYLM = _WLS + f""", p1 AS (SELECT strata, cluster, sum(w * (y - a - b * cnt) * (sw * cnt - sx) / det) t FROM d, k GROUP BY ALL),
p0 AS (SELECT strata, cluster, sum(w * (y - a - b * cnt) * (sxx - sx * cnt) / det) t FROM d, k GROUP BY ALL),
v1 AS ({tv_sql('p1')}), v0 AS ({tv_sql('p0')})"""


@query("j04_survey_linear", with_orders(_SVYLM + """ SELECT 'cnt' term, round(b, 6) estimate, round(sqrt(v), 6) std_error FROM k, v1
UNION ALL SELECT '(Intercept)', round(a, 6), round(sqrt(v), 6) FROM k, v0"""))
def j04(spark, sf):
    return _tidy(spark, G.glm(order_design(spark, sf), "y", ["cnt"]))


@query("j05_dispersion_r2", with_orders(_WLS + """, m AS (SELECT sum(w * y) / sum(w) m FROM d),
s AS (SELECT sum(w * power(y - a - b * cnt, 2)) / sum(w) * count(*) / (count(*) - 1) d1, sum(w * power(y - m, 2)) / sum(w) * count(*) / (count(*) - 1) d0 FROM d, k, m)
SELECT round(d0, 7) null_dispersion, round(d0, 7) survey_variance, round(1 - d1 / d0, 8) r2 FROM s"""))
def j05(spark, sf):
    design = order_design(spark, sf)
    fit, null = G.glm(design, "y", ["cnt"]), G.glm(design, "y", [])
    t = E.survey_var(design, "y").select(
        F.lit(float(null.dispersion)).alias("null_dispersion"), F.col("variance").alias("survey_variance"),
        F.lit(float(G.pseudo_r_squared(fit, null))).alias("r2"))
    return rounded(t, 7, r2=8)


def saturated_sql(y, family, design=True, group="grp3", levels=("A", "B", "C"), where="TRUE"):
    """Coefficients and errors of a model with one factor: links of the cell means."""
    link = {"gaussian": "{m}", "binomial": "ln({m} / (1 - {m}))", "poisson": "ln({m})"}[family]
    slope = {"gaussian": "1.0", "binomial": "({m} * (1 - {m}))", "poisson": "{m}"}[family]
    w = "w" if design else "1.0"
    ms = ", ".join(f"sum(CASE WHEN {group} = '{g}' THEN {w} * {y} END) / sum(CASE WHEN {group} = '{g}' THEN {w} END) m{i}, "
                   f"sum(CASE WHEN {group} = '{g}' THEN {w} END) n{i}" for i, g in enumerate(levels))
    ctes = f"dd AS (SELECT * FROM d WHERE {where}), m AS (SELECT {ms} FROM dd)"
    parts = []
    if design:
        ts = ", ".join(f"sum(CASE WHEN {group} = '{g}' THEN w * ({y} - m{i}) / (n{i} * {slope.format(m=f'm{i}')}) ELSE 0 END) t{i}"
                       for i, g in enumerate(levels))
        ctes += f", zp AS (SELECT strata, cluster, {ts} FROM dd, m GROUP BY strata, cluster)"
    for i, g in enumerate(levels):
        name = "(Intercept)" if i == 0 else f"{group}{g}"
        est = link.format(m=f"m{i}") + ("" if i == 0 else " - " + link.format(m="m0"))
        if design:
            ctes += f", z{i} AS (SELECT strata, cluster, t{i}{'' if i == 0 else ' - t0'} t FROM zp), y{i} AS ({tv_sql(f'z{i}')})"
            parts.append(f"SELECT '{name}' term, round({est}, 6) estimate, round(sqrt(v), 6) std_error FROM m, y{i}")
        else:
            var = f"1 / (n{i} * {slope.format(m=f'm{i}')})" + ("" if i == 0 else f" + 1 / (n0 * {slope.format(m='m0')})")
            parts.append(f"SELECT '{name}' term, round({est}, 6) estimate, round(sqrt({var}), 6) std_error FROM m")
    return with_orders(ctes + " " + " UNION ALL ".join(parts))


def _fit_query(y, family, design=True, where=None, **kw):
    def run(spark, sf):
        data = order_design(spark, sf) if design else order_rows(spark, sf)
        if where is not None:
            data = data.filter(where()) if design else data.where(where())
        return _tidy(spark, G.glm(data, y, ["grp3"], family, levels=LEVELS, **kw))
    return run


query("j04_survey_linear_factor", saturated_sql("y", "gaussian"))(_fit_query("y", "gaussian"))
query("j06_logit", saturated_sql("sad", "binomial", False))(_fit_query("sad", "binomial", False))
query("j07_survey_logit", saturated_sql("sad", "binomial"))(_fit_query("sad", "binomial"))
query("j10_poisson", saturated_sql("cnt", "poisson", False))(_fit_query("cnt", "poisson", False))
query("j11_survey_poisson", saturated_sql("cnt", "poisson"))(_fit_query("cnt", "poisson"))
_USERS = lambda: F.col("use_flag") == "1"
query("j27_domain_linear", saturated_sql("y", "gaussian", where="use_flag = '1'"))(_fit_query("y", "gaussian", where=_USERS))
query("j27_domain_logit", saturated_sql("sad", "binomial", where="use_flag = '1'"))(_fit_query("sad", "binomial", where=_USERS))
query("j27_plain_subset_logit", saturated_sql("sad", "binomial", False, where="use_flag = '1'"))(
    _fit_query("sad", "binomial", False, where=_USERS))


@query("j10_quasipoisson", with_orders("""m AS (SELECT grp3, avg(cnt) m, count(*) n FROM d GROUP BY 1)
SELECT round(sum(power(cnt - m, 2) / m) / (count(*) - 3), 6) dispersion FROM d JOIN m USING (grp3)"""))
def j10(spark, sf):
    fit = G.glm(order_rows(spark, sf), "cnt", ["grp3"], "poisson", levels=LEVELS, quasi=True)
    return rounded(row_frame(spark, dispersion=float(fit.dispersion)))


FULL_TERMS = ["happy", "cnt", "use_flag", "item1", power("item1", 2), "item2", inter("item1", "item2"), inter(power("item1", 2), "item2")]
SMALL_TERMS = FULL_TERMS[:6]
TERM_NAMES = ["(Intercept)", "happy", "cnt", "use_flag1", "item1", "item1^2", "item2", "item1:item2", "item1^2:item2"]


@lru_cache(maxsize=32)
def _fits(spark, sf, family, plain, small):
    y = {"gaussian": "y", "binomial": "sad", "poisson": "cnt"}[family]
    items = [i for i in (SMALL_TERMS if small else FULL_TERMS) if i != y]
    return G.glm(order_rows(spark, sf) if plain else order_design(spark, sf), y, items, family, levels=LEVELS)


def _zeros(names):
    return "SELECT * FROM (VALUES " + ", ".join(f"('{n}', 0.0::DOUBLE)" for n in names) + ") v(term, score)"


def _score(spark, fit):
    """Normal equations at the solution, relative to the size of the data: all zero."""
    scale = float(fit.n)
    rows = [(t, abs(round(float(s) / scale, 6))) for t, s in zip(fit.terms, fit.extra["score"])]
    return spark.createDataFrame(rows, "term string, score double")


query("j07_survey_logit_interactions", _zeros(TERM_NAMES))(lambda s, f: _score(s, _fits(s, f, "binomial", False, False)))
query("j04_survey_linear_interactions", _zeros(TERM_NAMES))(lambda s, f: _score(s, _fits(s, f, "gaussian", False, False)))
query("j11_survey_poisson_interactions", _zeros([t for t in TERM_NAMES if t != "cnt"]))(
    lambda s, f: _score(s, _fits(s, f, "poisson", False, False)))


def _ordinal_parts(design):
    """CTEs, and per cut: name, estimate, standard error and relation."""
    w = "w" if design else "1.0"
    parts, ctes = [], [f"m AS (SELECT sum({w}) nh, " + ", ".join(f"sum(CASE WHEN happy <= {k} THEN {w} ELSE 0.0 END) / sum({w}) c{k}" for k in range(1, 5)) + " FROM d)"]
    for k in range(1, 5):
        est = f"ln(c{k} / (1 - c{k}))"
        if design:
            ctes.append(f"z{k} AS (SELECT strata, cluster, sum(w * (CASE WHEN happy <= {k} THEN 1 - c{k} ELSE -c{k} END) / (nh * c{k} * (1 - c{k}))) t FROM d, m GROUP BY ALL), y{k} AS ({tv_sql(f'z{k}')})")
            parts.append((f"{float(k)}|{float(k + 1)}", est, "sqrt(v)", f"m, y{k}"))
        else:
            parts.append((f"{float(k)}|{float(k + 1)}", est, f"1 / sqrt(nh * c{k} * (1 - c{k}))", "m"))
    return ", ".join(ctes), parts


def _tidy_sql(parts):
    return " UNION ALL ".join(f"SELECT '{n}' term, round({e}, 6) estimate, round({se}, 6) std_error FROM {src}" for n, e, se, src in parts)


def _ordinal_sql(design):
    ctes, parts = _ordinal_parts(design)
    return with_orders(ctes + " " + _tidy_sql(parts))


HAPPY = [1.0, 2.0, 3.0, 4.0, 5.0]
query("j08_ordinal", _ordinal_sql(False))(lambda s, f: _tidy(s, ordinal(order_rows(s, f), "happy", [], y_levels=HAPPY)))
query("j09_survey_ordinal", _ordinal_sql(True))(lambda s, f: _tidy(s, ordinal(order_design(s, f), "happy", [], y_levels=HAPPY)))
ORD_TERMS = ["cnt", "use_flag", "item1", power("item1", 2), "item2", inter("item1", "item2")]
ORD_NAMES = ["cnt", "use_flag1", "item1", "item1^2", "item2", "item1:item2"]


@lru_cache(maxsize=8)
def _ordinal_fit(spark, sf):
    return ordinal(order_design(spark, sf), "happy", ORD_TERMS, levels=LEVELS, y_levels=HAPPY)


@query("j09_survey_ordinal_score", "SELECT CAST(10 AS BIGINT) params, 0.0::DOUBLE worst")
def j09b(spark, sf):
    fit = _ordinal_fit(spark, sf)
    worst = max(abs(float(s)) for s in fit.extra["score"]) / fit.n
    return row_frame(spark, params=len(fit.terms), worst=round(worst, 6))


def _negbin_query(design):
    def run(spark, sf):
        data = order_design(spark, sf) if design else order_rows(spark, sf)
        fit = negbin(data, "cnt", [])
        size = fit.extra["theta"]
        w = F.col("w") if design else F.lit(1.0)
        mean = F.lit(float(fit.n)) * 0 + F.lit(float(2.718281828459045 ** fit.coef[0]))
        y = F.col("cnt")
        terms = F.aggregate(F.when(y >= 1, F.sequence(F.lit(0), y.cast("int") - 1)).otherwise(F.array().cast("array<int>")),
                            F.lit(0.0), lambda acc, i: acc + 1.0 / (i + F.lit(size)))
        score = w * (terms + F.log(F.lit(size) / (size + mean)) + 1 - (y + size) / (mean + size))
        rows = order_rows(spark, sf)
        return rows.agg(F.lit(round(float(fit.coef[0]), 6)).alias("log_mean"),
                        (F.abs(F.sum(score) / F.sum(w)) < 1e-6).alias("size_score_zero"))
    return run


query("j12_negbin", with_orders("SELECT round(ln(avg(cnt)), 6) log_mean, TRUE size_score_zero FROM d"))(_negbin_query(False))
query("j13_survey_negbin", with_orders("SELECT round(ln(sum(w * cnt) / sum(w)), 6) log_mean, TRUE size_score_zero FROM d"))(_negbin_query(True))


@lru_cache(maxsize=8)
def _negbin_full(spark, sf):
    items = [i for i in SMALL_TERMS if i != "cnt"]
    return negbin(order_design(spark, sf), "cnt", items, levels=LEVELS)


@query("j13_survey_negbin_terms", "SELECT CAST(7 AS BIGINT) params, 0.0::DOUBLE worst")
def j13b(spark, sf):
    fit = _negbin_full(spark, sf)
    worst = max(abs(float(s)) for s in fit.extra["score"]) / fit.n
    return row_frame(spark, params=len(fit.terms), worst=round(worst, 6))


LANES = ["0", "1", "2", "3"]


def _with_lane(data):
    """A four-way outcome dealt by order and customer number."""
    lane = ((F.col("rid") * 5 + F.col("cluster")) % 4).cast("string")
    return data.mutate(lane=lane) if hasattr(data, "mutate") else data.withColumn("lane", lane)


def _multinom_parts(design):
    w = "w" if design else "1.0"
    ctes = ["dd AS (SELECT *, CAST((rid * 5 + cluster) % 4 AS VARCHAR) lane FROM d)",
            "m AS (SELECT " + ", ".join(f"sum(CASE WHEN female = '{g}' AND lane = '{t}' THEN {w} ELSE 0.0 END) n{g}{k}"
                                        for g in "01" for k, t in enumerate(LANES)) + " FROM dd)"]
    parts = []
    for k in (1, 2, 3):
        for g in "01":
            name = ("(Intercept)" if g == "0" else "female1") + f":{k}"
            est = f"ln(n0{k} / n00)" if g == "0" else f"ln(n1{k} / n10) - ln(n0{k} / n00)"
            if design:
                own = lambda s: f"CASE WHEN female = '{s}' AND lane = '{LANES[k]}' THEN 1 / n{s}{k} WHEN female = '{s}' AND lane = '{LANES[0]}' THEN -1 / n{s}0 ELSE 0 END"
                for tag, inf in (("z", own("0") if g == "0" else f"({own('1')}) - ({own('0')})"), ("l", own(g))):
                    ctes.append(f"{tag}{k}{g} AS (SELECT strata, cluster, sum(w * ({inf})) t FROM dd, m GROUP BY ALL), y{tag}{k}{g} AS ({tv_sql(f'{tag}{k}{g}')})")
                parts.append((name, est, "sqrt(v)", f"m, yz{k}{g}"))
            else:
                parts.append((name, est, f"sqrt(1 / n0{k} + 1 / n00" + ("" if g == "0" else f" + 1 / n1{k} + 1 / n10") + ")", "m"))
    return ", ".join(ctes), parts


def _multinom_sql(design):
    ctes, parts = _multinom_parts(design)
    return with_orders(ctes + " " + _tidy_sql(parts))


query("j14_multinomial", _multinom_sql(False))(
    lambda s, f: _tidy(s, multinomial(_with_lane(order_rows(s, f)), "lane", ["female"], levels=LEVELS, y_levels=LANES)))
query("j15_survey_multinomial", _multinom_sql(True))(
    lambda s, f: _tidy(s, multinomial(_with_lane(order_design(s, f)), "lane", ["female"], levels=LEVELS, y_levels=LANES)))
MULTI_TERMS = ["y", "cnt", "use_flag", *cross(["item1", power("item1", 2)], "item2")]


@lru_cache(maxsize=8)
def _multi_fit(spark, sf):
    return multinomial(_with_lane(order_design(spark, sf)), "lane", MULTI_TERMS, levels=LEVELS, y_levels=LANES)


@query("j15_survey_multinomial_score", "SELECT CAST(27 AS BIGINT) params, 0.0::DOUBLE worst")
def j15b(spark, sf):
    fit = _multi_fit(spark, sf)
    worst = max(abs(float(s)) for s in fit.extra["score"]) / fit.n
    return row_frame(spark, params=len(fit.terms), worst=round(worst, 6))


@lru_cache(maxsize=8)
def _multi_boot(spark, sf):
    rep = as_rep(_with_lane(order_design(spark, sf)), "bootstrap", replicates=20, seed=7)
    fit, values = multinomial_replicates(rep, "lane", ["female", "cnt"], levels=LEVELS, y_levels=LANES)
    return fit, values


@query("j16_multinomial_bootstrap")
def j16(spark, sf):
    fit, values = _multi_boot(spark, sf)
    return replicate_vcov(values, "term", fit.terms).where("a = b").select(
        F.col("a").alias("term"), F.col("mean_a").alias("estimate"), F.sqrt("cov").alias("std_error"))


@query("j17_replicate_tests")
def j17(spark, sf):
    from designstats.operators.report import wrap_replicates
    from designstats.functions.columns import stars

    return wrap_replicates(j16(spark, sf)).withColumn("mark", stars("p_value"))


@query("j18_confidence_interval", with_orders(_SVYLM + """ SELECT 'cnt' term, round(b, 6) estimate,
 round(b - 1.959963984540054 * sqrt(v), 6) low, round(b + 1.959963984540054 * sqrt(v), 6) upp FROM k, v1"""))
def j18(spark, sf):
    return rounded(G.glm(order_design(spark, sf), "y", ["cnt"]).confint(spark, df=INF).where("term = 'cnt'"))


@query("j19_tidy_table", with_orders(_SVYLM + """ SELECT 'cnt' term, round(b, 6) estimate, round(sqrt(v), 6) std_error, round(b / sqrt(v), 4) statistic FROM k, v1
UNION ALL SELECT '(Intercept)', round(a, 6), round(sqrt(v), 6), round(a / sqrt(v), 4) FROM k, v0"""))
def j19(spark, sf):
    return _tidy(spark, G.glm(order_design(spark, sf), "y", ["cnt"]), True)


@query("j20_anova_f", with_orders(_OLS + " SELECT round((tss - rss) / (rss / (n - 2)), 5) f, CAST(1 AS BIGINT) df1, CAST(n - 2 AS DOUBLE) df2 FROM q, s"))
def j20(spark, sf):
    d = order_rows(spark, sf)
    r = G.anova_f(G.glm(d, "y", []), G.glm(d, "y", ["cnt"]))
    return rounded(row_frame(spark, f=float(r["f"]), df1=r["df1"], df2=float(r["df2"])), f=5)


@query("j21_wald_terms", with_orders(_SVYLM + f" SELECT round(b * b / v, 5) f, CAST(1 AS BIGINT) df1, {DF_SQL} - 1 df2 FROM k, v1"))
def j21(spark, sf):
    r = G.wald_test(G.glm(order_design(spark, sf), "y", ["cnt"]), ["cnt"])
    return rounded(row_frame(spark, f=float(r["f"]), df1=r["df1"], df2=float(r["df2"])), f=5)


_RSS = _SVYLM + """, m AS (SELECT sum(w * y) / sum(w) m FROM d),
r AS (SELECT sum(w * power(y - m, 2)) rss0, sum(w * power(y - a - b * cnt, 2)) rss1 FROM d, k, m)"""


@query("j22_rao_scott_lrt", with_orders(_RSS + " SELECT round((rss0 - rss1) * n / sw, 4) chisq, round(v / (sw / det * sw / n), 6) eigenvalue FROM r, k, v1"))
def j22(spark, sf):
    design = order_design(spark, sf)
    r = G.rao_scott_lrt(G.glm(design, "y", []), G.glm(design, "y", ["cnt"]))
    return rounded(row_frame(spark, chisq=float(r["chisq"]), eigenvalue=float(r["lambdas"][0])), chisq=4)


@query("j22_rao_scott_lrt_interactions")
def j22b(spark, sf):
    r = G.rao_scott_lrt(_fits(spark, sf, "binomial", False, True), _fits(spark, sf, "binomial", False, False))
    return row_frame(spark, chisq=float(r["chisq"]), df1=r["df1"], p=float(r["p"]), p_saddle=float(r["p_saddle"]))


_LOGLIK = """l AS (SELECT grp3, avg(sad) m, count(*) n FROM d GROUP BY 1), z AS (SELECT avg(sad) m, count(*) n FROM d),
q AS (SELECT sum(n * (m * ln(m) + (1 - m) * ln(1 - m))) l1, min((SELECT n * (m * ln(m) + (1 - m) * ln(1 - m)) FROM z)) l0, sum(n) n FROM l)"""


@query("j23_likelihood_ratio", with_orders(_LOGLIK + " SELECT round(2 * (l1 - l0), 5) chisq, CAST(2 AS BIGINT) df FROM q"))
def j23(spark, sf):
    d = order_rows(spark, sf)
    r = G.lr_test(G.glm(d, "sad", [], "binomial"), G.glm(d, "sad", ["grp3"], "binomial", levels=LEVELS))
    return rounded(row_frame(spark, chisq=float(r["chisq"]), df=r["df"]), chisq=5)


@query("j24_aic_bic", with_orders(_LOGLIK + " SELECT round(-2 * l1 + 6, 4) aic, round(-2 * l1 + 3 * ln(n), 4) bic FROM q"))
def j24(spark, sf):
    fit = G.glm(order_rows(spark, sf), "sad", ["grp3"], "binomial", levels=LEVELS)
    return rounded(row_frame(spark, aic=float(G.aic(fit)), bic=float(G.bic(fit))), 4)


@query("j25_design_aic", with_orders(_RSS + """, e AS (SELECT v / (sw / det * (sw / n) * (rss1 / sw * n / (n - 1))) eff, n, rss1 / (sw / n) dev FROM r, k, v1)
SELECT round(eff, 6) eff_p, round(n * (ln(2 * pi() * dev / n) + 1) + 2 * eff, 4) aic FROM e"""))
def j25(spark, sf):
    r = G.design_aic(G.glm(order_design(spark, sf), "y", ["cnt"]))
    return rounded(row_frame(spark, eff_p=float(r["eff_p"]), aic=float(r["aic"])), aic=4)


@query("j25_design_aic_models")
def j25b(spark, sf):
    rows = [(f, *[float(v) for v in G.design_aic(_fits(spark, sf, f, False, s)).values()], s)
            for f in ("gaussian", "binomial") for s in (True, False)]
    return spark.createDataFrame(rows, "family string, eff_p double, aic double, deltabar double, small boolean")


@query("j26_design_bic", with_orders(_SVYLM + """ SELECT TRUE small, round(b * b / v + ln(n), 5) bic FROM k, v1
UNION ALL SELECT FALSE, round(2 * ln(n), 5) FROM k"""))
def j26(spark, sf):
    design = order_design(spark, sf)
    fits = {True: G.glm(design, "y", []), False: G.glm(design, "y", ["cnt"])}
    rows = [(s, float(G.design_bic(f, fits[False]))) for s, f in fits.items()]
    return rounded(spark.createDataFrame(rows, "small boolean, bic double"), 5)


@query("j28_compare_statistics", with_orders(_SVYLM + """, o AS (SELECT regr_slope(y, cnt) b, sqrt((regr_syy(y, cnt) - power(regr_sxy(y, cnt), 2) / regr_sxx(y, cnt)) / (count(*) - 2) / regr_sxx(y, cnt)) se FROM d)
SELECT 'cnt' term, round(o.b / o.se, 4) cs_no, round(k.b / sqrt(v), 4) cs_yes FROM k, v1, o"""))
def j28(spark, sf):
    t = G.compare_statistics(G.glm(order_rows(spark, sf), "y", ["cnt"]), G.glm(order_design(spark, sf), "y", ["cnt"]), spark)
    return rounded(t.where("term = 'cnt'"), 4)


# -- K: prediction ---------------------------------------------------------------------------
_K1 = _SVYLM + f""", pc AS (SELECT strata, cluster, p0.t a, p1.t b FROM p0 JOIN p1 USING (strata, cluster)),
v01 AS ({tv_sql('pc', 'a', u='b')}), g AS (SELECT unnest([0.0, 2.0, 4.0, 6.0]) c),
pr AS (SELECT CAST(c AS DOUBLE) cnt, a + b * c link, sqrt(v0.v + 2 * c * v01.v + c * c * v1.v) se FROM g, k, v0, v1, v01)"""


@lru_cache(maxsize=8)
def _lin(spark, sf):
    return G.glm(order_design(spark, sf), "y", ["cnt"])


@query("k01_predict_link", with_orders(_K1 + " SELECT cnt, round(link, 6) link, round(se, 6) se FROM pr"))
def k01(spark, sf):
    return rounded(predict(_lin(spark, sf), prediction_grid(spark, cnt=[0.0, 2.0, 4.0, 6.0])))


@query("k02_predict_band", with_orders(_K1 + " SELECT cnt, round(link, 6) predy, round(link - 1.96 * se, 6) ll, round(link + 1.96 * se, 6) ul FROM pr"))
def k02(spark, sf):
    t = band(predict(_lin(spark, sf), prediction_grid(spark, cnt=[0.0, 2.0, 4.0, 6.0])))
    return rounded(t.select("cnt", "predy", "ll", "ul"))


def _band_sql(y, family):
    """Bands of a model with one factor, from its cell means."""
    inv = {"binomial": ("ln(m / (1 - m))", "(m * (1 - m))", "1 / (1 + exp(-({e})))"), "poisson": ("ln(m)", "m", "exp({e})")}[family]
    return with_orders(f"""m AS (SELECT grp3, sum(w * {y}) / sum(w) m, sum(w) nh FROM d GROUP BY 1),
zp AS (SELECT strata, cluster, grp3, sum(w * ({y} - m)) / min(nh * {inv[1]}) t FROM d JOIN m USING (grp3) GROUP BY ALL),
zv AS ({tv_sql('zp', keys='grp3')})
SELECT grp3, round(m, 6) predy, round({inv[2].format(e=inv[0] + ' - 1.96 * sqrt(v)')}, 6) ll, round({inv[2].format(e=inv[0] + ' + 1.96 * sqrt(v)')}, 6) ul
FROM m JOIN zv USING (grp3)""")


@query("k03_probability_band", _band_sql("sad", "binomial"))
def k03(spark, sf):
    fit = G.glm(order_design(spark, sf), "sad", ["grp3"], "binomial", levels=LEVELS)
    t = band(predict(fit, prediction_grid(spark, grp3=["A", "B", "C"])), "logit")
    return rounded(t.select("grp3", "predy", "ll", "ul"))


@query("k04_rate_band", _band_sql("cnt", "poisson"))
def k04(spark, sf):
    fit = G.glm(order_design(spark, sf), "cnt", ["grp3"], "poisson", levels=LEVELS)
    t = band(predict(fit, prediction_grid(spark, grp3=["A", "B", "C"])), "log")
    return rounded(t.select("grp3", "predy", "ll", "ul"))


@query("k05_ordinal_probabilities", with_orders("SELECT CAST(happy AS VARCHAR) AS \"name\", round(sum(w) / (SELECT sum(w) FROM d), 6) predy FROM d GROUP BY happy"))
def k05(spark, sf):
    fit = ordinal(order_design(spark, sf), "happy", [], y_levels=HAPPY)
    return rounded(predict_ordinal(fit, spark.range(1), ["id"]).select("name", "predy"))


def _ordinal_band_sql():
    ctes, parts = _ordinal_parts(True)
    one = ", ".join(f"({e}) e{k}, (SELECT sqrt(v) FROM y{k}) s{k}" for k, (_, e, _, _) in enumerate(parts, 1))
    cdf = lambda k, sign: "0" if k == 0 else "1" if k == 5 else f"1 / (1 + exp(-(e{k} {sign} * s{k})))"
    diff = lambda k, sign: f"{cdf(k, sign)} - {cdf(k - 1, sign)}"
    rows = " UNION ALL ".join(f"""SELECT '{float(k)}' AS "name", round({diff(k, '+ 0')}, 6) predy,
 round(least({diff(k, '- 1.96')}, {diff(k, '+ 1.96')}), 6) ll, round(greatest({diff(k, '- 1.96')}, {diff(k, '+ 1.96')}), 6) ul FROM x""" for k in range(1, 6))
    return with_orders(f"{ctes}, x AS (SELECT {one} FROM m) {rows}")


@query("k06_ordinal_bands", _ordinal_band_sql())
def k06(spark, sf):
    fit = ordinal(order_design(spark, sf), "happy", [], y_levels=HAPPY)
    return rounded(predict_ordinal(fit, spark.range(1), []))


@query("k06_ordinal_bands_grid")
def k06b(spark, sf):
    grid = prediction_grid(spark, cnt=[0.0, 3.0], use_flag=["1"], item1=[1.0, 2.0, 3.0], item2=[1.0, 4.0])
    return predict_ordinal(_ordinal_fit(spark, sf), grid, ["cnt", "item1", "item2"])


@query("k07_multinomial_probabilities", with_orders("""dd AS (SELECT *, CAST((rid * 5 + cluster) % 4 AS VARCHAR) lane FROM d)
SELECT female, lane AS "name", round(sum(w) / sum(sum(w)) OVER (PARTITION BY female), 6) predy FROM dd GROUP BY female, lane"""))
def k07(spark, sf):
    fit = multinomial(_with_lane(order_design(spark, sf)), "lane", ["female"], levels=LEVELS, y_levels=LANES)
    t = predict_multinomial(fit, prediction_grid(spark, female=["0", "1"]), ["female"])
    return rounded(t.select("female", "name", "predy"))


def _multinom_band_sql():
    ctes, _ = _multinom_parts(True)
    rows = []
    for g in "01":
        up = lambda k, sign: "1" if k == 0 else f"exp(ln(n{g}{k} / n{g}0) {sign} * (SELECT sqrt(v) FROM yl{k}{g}))"
        total = lambda sign: " + ".join(up(k, sign) for k in range(4))
        for k, t in enumerate(LANES):
            p = lambda sign: f"({up(k, sign)}) / ({total(sign)})"
            rows.append(f"""SELECT '{g}' female, '{t}' AS "name", round({p('+ 0')}, 6) predy, round(least({p('- 1.96')}, {p('+ 1.96')}), 6) ll,
 round(greatest({p('- 1.96')}, {p('+ 1.96')}), 6) ul FROM m""")
    return with_orders(ctes + " " + " UNION ALL ".join(rows))


@lru_cache(maxsize=8)
def _female_fit(spark, sf):
    return multinomial(_with_lane(order_design(spark, sf)), "lane", ["female"], levels=LEVELS, y_levels=LANES)


@query("k08_multinomial_bands", _multinom_band_sql())
def k08(spark, sf):
    return rounded(predict_multinomial(_female_fit(spark, sf), prediction_grid(spark, female=["0", "1"]), ["female"]))


@query("k08_multinomial_bands_grid")
def k08b(spark, sf):
    grid = prediction_grid(spark, y=[2.5], cnt=[0.0, 3.0], use_flag=["1"], item1=[1.0, 2.0, 3.0], item2=[1.0, 4.0])
    return predict_multinomial(_multi_fit(spark, sf), grid, ["cnt", "item1", "item2"])


@query("k09_restore_scale", with_orders(_WLS + """, m AS (SELECT sum(w * cnt) / sum(w) m FROM d), g AS (SELECT unnest([1.0, 2.0, 3.0]) c)
SELECT CAST(c AS DOUBLE) cnt, round(a + b * c, 6) predy FROM g, k, m"""))
def k09(spark, sf):
    design = order_design(spark, sf)
    centred = E.centre(design, "cnt")
    fit = G.glm(centred, "y", ["cnt"])
    m = E.weighted_mean(design.domain_rows(), "cnt")
    grid = prediction_grid(spark, c=[1.0, 2.0, 3.0]).withColumn("cnt", F.col("c") - m)
    t = predict(fit, grid, se=False).withColumn("cnt", F.col("cnt") + m)
    return t.select(F.round("cnt", 6).alias("cnt"), F.round("link", 6).alias("predy"))


@query("k10_predict_whole_table", with_orders("""m AS (SELECT grp3, sum(w * sad) / sum(w) p FROM d GROUP BY 1)
SELECT rid, round(p, 6) p FROM d JOIN m USING (grp3)"""))
def k10(spark, sf):
    design = order_design(spark, sf)
    fit = G.glm(design, "sad", ["grp3"], "binomial", levels=LEVELS)
    return rounded(predict_response(fit, design.variables, "p").select("rid", "p"))
