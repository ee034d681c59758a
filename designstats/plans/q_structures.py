"""Moments and paths (L), missing data (M), multilevel (N), propensity (O), reports (P)."""

from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

from designstats import sources
from designstats.functions.dist import INF
from designstats.operators import estimate as E
from designstats.operators import glm as G
from designstats.operators import missing as M
from designstats.operators import moments as S
from designstats.operators import multilevel as N
from designstats.operators import propensity as O
from designstats.operators import report as R
from designstats.operators.design import Design
from designstats.operators.frame import mean_interval, to_wide, union_tagged
from designstats.plans import q_models as Q
from designstats.plans.fixtures import DF_SQL, order_design, order_rows, table, tq_sql, tv_sql, with_orders
from designstats.plans.q_estimate import mean_sql
from designstats.plans.q_models import LEVELS, rounded, row_frame
from designstats.plans.registry import query

# -- L: moments and path models ------------------------------------------------------------
ITEMS = ["item1", "item2", "item3", "happy"]
PAIRS = [(a, b) for i, a in enumerate(ITEMS) for b in ITEMS[i:]]


def _moment_sql(design):
    w = "w" if design else "1.0"
    return ("m AS (SELECT " + ", ".join(f"sum({w} * {v}) / sum({w}) m_{v}" for v in ITEMS) + f", sum({w}) nh, count(*) / (count(*) - 1.0) k FROM d), "
            "c AS (SELECT " + ", ".join(f"sum({w} * ({a} - m_{a}) * ({b} - m_{b})) / min(nh) * min(k) c_{a}_{b}" for a, b in PAIRS) + " FROM d, m)")


def _moments_query(design):
    def run(spark, sf):
        data = order_design(spark, sf) if design else order_rows(spark, sf)
        return rounded(S.Moments(data, ITEMS).table(spark), 8)
    return run


_MOMENT_OUT = " UNION ALL ".join(f"SELECT '{a}' a, '{b}' b, round(c_{a}_{b}, 8) cov, round(m_{a}, 8) mean_a FROM c, m" for a, b in PAIRS)
query("l01_weighted_moments", with_orders(_moment_sql(True) + " " + _MOMENT_OUT))(_moments_query(True))
query("l03_plain_moments", with_orders(_moment_sql(False) + " " + _MOMENT_OUT))(_moments_query(False))


def _gamma_sql():
    ctes = [_moment_sql(True)]
    parts = []
    z = {f"{v}~1": f"({v} - m_{v})" for v in ITEMS}
    z.update({f"{a}~~{b}": f"(k * ({a} - m_{a}) * ({b} - m_{b}) - c_{a}_{b})" for a, b in PAIRS})
    cols = ", ".join(f"sum(w * {e}) / min(nh) t{i}" for i, e in enumerate(z.values()))
    ctes.append(f"zp AS (SELECT strata, cluster, {cols} FROM d, m, c GROUP BY strata, cluster)")
    for i, n in enumerate(z):
        ctes.append(f"y{i} AS ({tv_sql('zp', f't{i}')})")
        parts.append(f"SELECT '{n}' moment, round(v, 10) variance FROM y{i}")
    return with_orders(", ".join(ctes) + " " + " UNION ALL ".join(parts))


@query("l02_moment_covariance", _gamma_sql())
def l02(spark, sf):
    m = S.Moments(order_design(spark, sf), ITEMS)
    rows = [(n, float(v)) for n, v in zip(m.names, np.diag(m.gamma()))]
    return rounded(spark.createDataFrame(rows, "moment string, variance double"), 10)


@query("l03_plain_moment_covariance", with_orders(_moment_sql(False) + ", n1 AS (SELECT count(*) n FROM d) " + " UNION ALL ".join(
    f"SELECT '{a}~~{b}' moment, round(sum(power((k * ({a} - m_{a}) * ({b} - m_{b}) - c_{a}_{b}), 2)) / min(n) / (min(n) - 1), 10) variance FROM d, m, c, n1"
    for a, b in PAIRS)))
def l03(spark, sf):
    m = S.Moments(order_rows(spark, sf), ITEMS)
    rows = [(n, float(v)) for n, v in zip(m.names, np.diag(m.gamma())) if "~~" in n]
    return rounded(spark.createDataFrame(rows, "moment string, variance double"), 10)


EQUATIONS = {"cnt": ["item1"], "y": ["cnt"]}
EFFECTS = {"IE": lambda c: c["cnt~item1"] * c["y~cnt"]}


@lru_cache(maxsize=8)
def _path(spark, sf, design=True, full=False):
    equations = {"cnt": ["item1", "happy"], "y": ["cnt", "item1", "happy"]} if full else EQUATIONS
    data = order_design(spark, sf).filter(F.col("use_flag") == "1") if design else order_rows(spark, sf).where("use_flag = '1'")
    return S.path_model(data, equations)


def _slope_sql(y, x, tag):
    return f"""q{tag} AS (SELECT sum(w) sw, sum(w * {x}) sx, sum(w * {x} * {x}) sxx, sum(w * {y}) sy, sum(w * {x} * {y}) sxy FROM d WHERE use_flag = '1'),
k{tag} AS (SELECT *, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) b, sw * sxx - sx * sx det, (sy - (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * sx) / sw a FROM q{tag}),
p{tag} AS (SELECT strata, cluster, sum(w * ({y} - a - b * {x}) * (sw * {x} - sx) / det) t FROM d, k{tag} WHERE use_flag = '1' GROUP BY strata, cluster)"""


_PATH_SQL = f"""{_slope_sql('cnt', 'item1', 'a')}, {_slope_sql('y', 'cnt', 'b')}, va AS ({tv_sql('pa')}), vb AS ({tv_sql('pb')}),
pab AS (SELECT strata, cluster, pa.t t, pb.t u FROM pa JOIN pb USING (strata, cluster)), vab AS ({tv_sql('pab', 't', u='u')}),
g AS (SELECT ka.b a, kb.b b, va.v va, vb.v vb, vab.v vab FROM ka, kb, va, vb, vab)"""


@query("l04_path_model", with_orders(_PATH_SQL + """ SELECT 'cnt~item1' term, round(a, 6) estimate, round(sqrt(va), 6) std_error FROM g
UNION ALL SELECT 'y~cnt', round(b, 6), round(sqrt(vb), 6) FROM g"""))
def l04(spark, sf):
    t = _path(spark, sf).tidy(spark).select("term", "estimate", "std_error")
    return rounded(t.where(F.col("term").isin("cnt~item1", "y~cnt")))


@query("l05_indirect_effect", with_orders(_PATH_SQL + """ SELECT 'IE' term, round(a * b, 7) estimate,
 round(sqrt(b * b * va + a * a * vb + 2 * a * b * vab), 7) std_error FROM g"""))
def l05(spark, sf):
    return rounded(S.defined_effects(_path(spark, sf), EFFECTS).tidy(spark).select("term", "estimate", "std_error"), 7)


@query("l06_coefficient_difference", with_orders(_PATH_SQL + """ SELECT 'p1-p2' term, round(a - b, 6) estimate,
 round(sqrt(va + vb - 2 * vab), 6) std_error FROM g"""))
def l06(spark, sf):
    f = S.defined_effects(_path(spark, sf), {"p1-p2": lambda c: c["cnt~item1"] - c["y~cnt"]})
    return rounded(f.tidy(spark).select("term", "estimate", "std_error"))


def _parameters(spark, sf, design):
    fit = _path(spark, sf, design, True)
    effects = S.defined_effects(fit, {
        "IE": lambda c: c["cnt~item1"] * c["y~cnt"], "DE": lambda c: c["y~item1"],
        "TE": lambda c: c["y~item1"] + c["cnt~item1"] * c["y~cnt"]})
    return S.parameter_table(fit, spark).unionByName(S.parameter_table(effects, spark))


def _plain_slope_sql(y, x, tag):
    return f"""o{tag} AS (SELECT regr_slope({y}, {x}) ob, regr_intercept({y}, {x}) oa, regr_sxx({y}, {x}) xx, avg({x}) mx FROM d WHERE use_flag = '1'),
r{tag} AS (SELECT sqrt(sum(power(({y} - oa - ob * {x}) * ({x} - mx) / xx, 2))) ose FROM d, o{tag} WHERE use_flag = '1')"""


@query("l07_path_ratio", with_orders(_PATH_SQL + f""", {_plain_slope_sql('cnt', 'item1', 'a')}, {_plain_slope_sql('y', 'cnt', 'b')}
SELECT 'cnt' lhs, 'item1' rhs, round(a / ob, 5) ratio, abs(ob / ose) > abs(a / sqrt(va)) first_is_stronger FROM g, oa, ra
UNION ALL SELECT 'y', 'cnt', round(b / ob, 5), abs(ob / ose) > abs(b / sqrt(vb)) FROM g, ob, rb"""))
def l07b(spark, sf):
    t = R.paired_estimates(S.parameter_table(_path(spark, sf, False), spark), S.parameter_table(_path(spark, sf, True), spark), ["lhs", "op", "rhs"])
    return t.where("op = '~'").select("lhs", "rhs", F.round("ratio", 5).alias("ratio"), "first_is_stronger")


@query("l07_path_comparison")
def l07(spark, sf):
    return R.paired_estimates(_parameters(spark, sf, False), _parameters(spark, sf, True), ["lhs", "op", "rhs"])


@query("l08_srmr_measures", with_orders("""c AS (SELECT covar_samp(item1, item2) c12, var_samp(item1) v1, var_samp(item2) v2 FROM d)
SELECT 'srmr' source, round(sqrt(power(c12 / sqrt(v1 * v2), 2) / 3), 5) cs_n FROM c"""))
def l08(spark, sf):
    m = S.Moments(order_rows(spark, sf), ["item1", "item2"]).table(spark).select("a", "b", "cov")
    implied = m.withColumn("cov", F.when(F.col("a") == F.col("b"), F.col("cov")).otherwise(0.0))
    t = S.srmr(m, implied).select(F.lit("srmr").alias("source"), F.col("srmr").alias("cs_n"))
    other = t.select(F.lit("npar").alias("source"), F.lit(2.0).alias("cs_n"))
    return R.fit_measures(t.unionByName(other))


@query("l09_scale_score", with_orders("SELECT rid, round((item1 + item2 + item3) / 3, 8) score FROM d"))
def l09(spark, sf):
    from designstats.functions.columns import row_mean

    return order_rows(spark, sf).select("rid", F.round(row_mean(["item1", "item2", "item3"]), 8).alias("score"))


# -- M: missing data -----------------------------------------------------------------------
@query("m01_case_counts", with_orders("""SELECT count(*) FILTER (spend IS NULL OR age_m IS NULL) n_miss,
 count(*) FILTER (spend IS NOT NULL AND age_m IS NOT NULL) n_complete FROM d"""))
def m01(spark, sf):
    return M.case_counts(order_rows(spark, sf))


@query("m02_missing_summary", with_orders(" UNION ALL ".join(
    f"SELECT '{c}' variable, count(*) - count({c}) n_miss, round(100.0 * (count(*) - count({c})) / count(*), 6) pct_miss FROM d"
    for c in ("rid", "y", "spend", "age_m", "happy"))))
def m02(spark, sf):
    return rounded(M.missing_summary(order_rows(spark, sf), ["rid", "y", "spend", "age_m", "happy"]))


COPIES = 20


@lru_cache(maxsize=4)
def _imputed(spark, sf):
    """Users only, so that age_m is the one incomplete column. The copies are not kept: the rows are repeated as they are
    read, and only the filled ones are looked up."""
    rows = order_rows(spark, sf).where("use_flag = '1'")
    return M.impute(rows, "rid", ["age_m"], ["y", "happy", "cnt", "item1"], m=COPIES)


@query("m03_imputation_invariants", with_orders(f"""SELECT CAST(range + 1 AS INTEGER) AS "__imp", (SELECT count(*) FROM d WHERE use_flag = '1') n,
 CAST(0 AS BIGINT) still_missing, CAST(0 AS BIGINT) not_a_donor, CAST(0 AS BIGINT) changed FROM range({COPIES})"""))
def m03(spark, sf):
    """Every gap is filled by an observed value and no observed value changes."""
    source = order_rows(spark, sf).where("use_flag = '1'")
    seen = source.where("age_m is not null").select(F.col("age_m").alias("__seen")).distinct()
    done = _imputed(spark, sf).join(source.select("rid", F.col("age_m").alias("old")), "rid")
    # counted by value first: rows of one value would all meet in one task at the join with the donors
    values = done.groupBy("__imp", "age_m").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("old") != F.col("age_m")).cast("long")).alias("changed"))
    values = values.join(seen, values.age_m == F.col("__seen"), "left")
    number = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return values.groupBy("__imp").agg(
        F.sum("n").alias("n"), number(F.col("age_m").isNull()).alias("still_missing"),
        number(F.col("__seen").isNull()).alias("not_a_donor"), F.coalesce(F.sum("changed"), F.lit(0)).alias("changed"))


@query("m03_chained_two_columns", with_orders("""SELECT CAST(range + 1 AS INTEGER) AS "__imp", (SELECT count(*) FROM d) n,
 CAST(0 AS BIGINT) still_missing FROM range(2)"""))
def m03b(spark, sf):
    t = M.impute(order_rows(spark, sf), "rid", ["age_m", "spend"], ["y", "happy", "cnt"], m=2, sweeps=1)
    return t.groupBy("__imp").agg(F.count(F.lit(1)).alias("n"),
                                  F.sum((F.col("age_m").isNull() | F.col("spend").isNull()).cast("long")).alias("still_missing"))

# Drawn categories, in SQL with the same draws: the fit of a model of one two-level predictor is that of its cells, its
# covariance follows from their counts, and the normals and uniforms come from md5.
def _uniform_sql(text):
    return f"((('0x' || substr(md5({text}), 1, 12))::BIGINT + 0.5) / 281474976710656.0)"


def _normal_sql(prefix, j):
    return f"sqrt(-2 * ln({_uniform_sql(f'{prefix} || {chr(39)}|{j}|0{chr(39)}')})) * cos(2 * pi() * {_uniform_sql(f'{prefix} || {chr(39)}|{j}|1{chr(39)}')})"


def _category_sql(target, levels, value, rows="d", seed=1234, m=COPIES):
    """CTEs: st (the coefficients drawn for each copy) and drawn (copy, rid, category) of the rows without a value."""
    k, names = len(levels), []
    count = ", ".join(f"count(*) FILTER (t = '{v}' AND female = '{f}')::DOUBLE n{f}_{c}" for f in "01" for c, v in enumerate(levels))
    theta, cov = [], {}
    for c in range(1, k):
        theta += [f"ln(n0_{c} / n0_0)", f"ln(n1_{c} / n1_0) - ln(n0_{c} / n0_0)"]
    cell = lambda f, c, d: f"(1 / n{f}_0" + (f" + 1 / n{f}_{c})" if c == d else ")")
    for c in range(1, k):
        for d in range(1, k):
            a, b = 2 * (c - 1), 2 * (d - 1)
            cov[a, b], cov[a, b + 1], cov[a + 1, b] = cell(0, c, d), f"(-{cell(0, c, d)})", f"(-{cell(0, c, d)})"
            cov[a + 1, b + 1] = f"({cell(0, c, d)} + {cell(1, c, d)})"
    steps, q = [f"SELECT *, {', '.join(f'{t} t{j}' for j, t in enumerate(theta))} FROM nc"], 2 * (k - 1)
    for j in range(q):  # Cholesky, one column after another
        own = " - ".join([cov[j, j], *[f"l{j}_{r} * l{j}_{r}" for r in range(j)]])
        steps.append(f"SELECT *, sqrt({own}) l{j}_{j} FROM ({steps[-1]})")
        if j + 1 < q:
            below = ", ".join("(" + " - ".join([cov[i, j], *[f"l{i}_{r} * l{j}_{r}" for r in range(j)]]) + f") / l{j}_{j} l{i}_{j}" for i in range(j + 1, q))
            steps.append(f"SELECT *, {below} FROM ({steps[-1]})")
    text = f"'{seed}|1|{target}|' || imp"
    z = ", ".join(f"{_normal_sql(text, j)} z{j}" for j in range(q))
    star = ", ".join(f"t{i} + " + " + ".join(f"l{i}_{j} * z{j}" for j in range(i + 1)) + f" s{i}" for i in range(q))
    links = ", ".join(["1.0 e0", *[f"exp(s{2 * (c - 1)} + s{2 * (c - 1) + 1} * CASE WHEN female = '1' THEN 1 ELSE 0 END) e{c}" for c in range(1, k)]])
    total = " + ".join(f"e{c}" for c in range(k))
    uniform = _uniform_sql(f"'{seed}|1|{target}' || '|' || imp || '|' || rid")
    pick = "CASE " + " ".join(f"WHEN {' + '.join(f'e{i}' for i in range(c + 1))} >= u * ({total}) THEN '{levels[c]}'" for c in range(k - 1)) + f" ELSE '{levels[-1]}' END"
    return f"""v AS (SELECT rid, female, {value} t FROM {rows}),
nc AS (SELECT {count} FROM v), ch AS ({steps[-1]}),
st AS (SELECT imp, {star} FROM ch, (SELECT range + 1 imp, {z} FROM (SELECT range, range + 1 imp FROM range({m})))),
drawn AS (SELECT CAST(imp AS INTEGER) "__imp", rid, {pick} category FROM (
  SELECT imp, rid, {uniform} u, {links} FROM v, st WHERE t IS NULL))"""


_LANE_NULL = "CASE WHEN rid % 9 <> 4 THEN grp3 END"


@query("m03_polytomous", with_orders(_category_sql("lane", ["A", "B", "C"], _LANE_NULL) + " SELECT * FROM drawn"))
def m03_polytomous(spark, sf):
    """A factor with three levels, drawn from polytomous models of another factor; the filled rows of all copies."""
    rows = order_rows(spark, sf).withColumn("lane", F.when(F.col("rid") % 9 != 4, F.col("grp3")))
    t = M.impute(rows, "rid", ["lane"], ["female"], m=COPIES, categories={"lane": ["A", "B", "C"], "female": ["0", "1"]})
    return t.where(F.col("rid") % 9 == 4).select("__imp", "rid", F.col("lane").alias("category"))


@query("m03_logit", with_orders(_category_sql("flag", ["0", "1"], "CASE WHEN (rid + cluster) % 11 <> 0 THEN CAST(sad AS VARCHAR) END") + " SELECT * FROM drawn"))
def m03_logit(spark, sf):
    """A factor with two levels, drawn from logit models; the filled rows of all copies."""
    gap = (F.col("rid") + F.col("cluster")) % 11 == 0
    rows = order_rows(spark, sf).withColumn("flag", F.when(~gap, F.col("sad").cast("string")))
    t = M.impute(rows, "rid", ["flag"], ["female"], m=COPIES, categories={"flag": ["0", "1"], "female": ["0", "1"]})
    return t.where(gap).select("__imp", "rid", F.col("flag").alias("category"))


@query("m06_pooled_share", with_orders(_category_sql("lane", ["A", "B", "C"], _LANE_NULL) + """,
f AS (SELECT x."__imp", d.w, coalesce(v.t, x.category) lane FROM drawn x JOIN d USING (rid) JOIN v USING (rid)
  UNION ALL SELECT CAST(range + 1 AS INTEGER), d.w, v.t FROM range(""" + str(COPIES) + """), d JOIN v USING (rid) WHERE v.t IS NOT NULL),
e AS (SELECT "__imp", sum(w) FILTER (lane = 'A') / sum(w) p FROM f GROUP BY 1)
SELECT round(avg(p), 10) estimate, round(var_samp(p), 14) between, count(*) m FROM e"""))
def m06_share(spark, sf):
    """The weighted share of a level over the completed copies, and its variance between them."""
    rows = order_rows(spark, sf).withColumn("lane", F.when(F.col("rid") % 9 != 4, F.col("grp3")))
    t = M.impute(rows, "rid", ["lane"], ["female"], m=COPIES, categories={"lane": ["A", "B", "C"], "female": ["0", "1"]})
    per = t.groupBy("__imp").agg((F.sum(F.when(F.col("lane") == "A", F.col("w")).otherwise(0.0)) / F.sum("w")).alias("mean"))
    t = M.pool(per.withColumn("var", F.lit(0.0)), [])
    return t.select(F.round("estimate", 10).alias("estimate"), F.round("between", 14).alias("between"), "m")


@query("m03_chained_mixed", with_orders("""SELECT CAST(range + 1 AS INTEGER) AS "__imp", (SELECT count(*) FROM d) n,
 CAST(0 AS BIGINT) still_missing, CAST(0 AS BIGINT) changed FROM range(2)"""))
def m03_mixed(spark, sf):
    """A number and a factor imputed in turn, each from the other."""
    rows = order_rows(spark, sf).withColumn("lane", F.when(F.col("rid") % 9 != 4, F.col("grp3")))
    t = M.impute(rows, "rid", ["age_m", "lane"], ["y", "happy"], m=2, sweeps=2, categories={"lane": ["A", "B", "C"]})
    bad = lambda c: F.sum(c.cast("long"))
    return t.groupBy("__imp").agg(
        F.count(F.lit(1)).alias("n"), bad(F.col("age_m").isNull() | ~F.col("lane").isin("A", "B", "C")).alias("still_missing"),
        bad((F.col("rid") % 9 != 4) & (F.col("lane") != F.col("grp3"))).alias("changed"))


@query("m04_stacked_copies", with_orders(f"SELECT CAST(range + 1 AS INTEGER) AS \"__imp\", (SELECT sum(w) FROM d WHERE use_flag = '1') pop FROM range({COPIES})"))
def m04(spark, sf):
    return _imputed(spark, sf).groupBy("__imp").agg(F.sum("w").alias("pop"))


@lru_cache(maxsize=4)
def _imputed_design(spark, sf):
    """One design over all copies: PSU and strata counts come from the full single table."""
    full = order_design(spark, sf)
    copies = Design.of(_imputed(spark, sf), "cluster", "strata", "w", "fpc", validate=False)
    return Design(copies.df, ("__imp",), full.lonely, True, full.full, full._cache)


@query("m05_design_over_imputations", "SELECT * FROM (" + ") UNION ALL SELECT * FROM (".join(
    with_orders(mean_sql("y", where="use_flag = '1'") + f" SELECT CAST({i} AS INTEGER) AS \"__imp\", round(mean, 8) mean, round(sqrt(v), 8) se FROM mt, mv")
    for i in range(1, COPIES + 1)) + ")")
def m05(spark, sf):
    return rounded(E.survey_mean(_imputed_design(spark, sf), "y", df=INF).select("__imp", "mean", "se"), 8)


@query("m06_pooled_complete", with_orders(mean_sql("y", where="use_flag = '1'") +
       f" SELECT round(mean, 8) estimate, round(sqrt(v), 8) se, 0.0::DOUBLE between, CAST({COPIES} AS BIGINT) m FROM mt, mv"))
def m06(spark, sf):
    t = E.survey_mean(_imputed_design(spark, sf), "y", df=INF)
    return rounded(M.pool(t, []).select("estimate", "se", "between", "m"), 8)


@query("m06_pooled_imputed")
def m06b(spark, sf):
    t = E.survey_mean(_imputed_design(spark, sf), "age_m", df=INF)
    return M.pool(t, [])


@query("m07_listwise_vs_imputed")
def m07(spark, sf):
    listwise = E.survey_mean(order_design(spark, sf).filter(F.col("use_flag") == "1"), "age_m", df=INF)
    no = listwise.select(F.lit("age_m").alias("variable"), F.col("mean").alias("est_no"), F.col("se").alias("se_no"))
    mi = m06b(spark, sf).select(F.lit("age_m").alias("variable"), F.col("estimate").alias("est_mi"), F.col("se").alias("se_mi"))
    return no.join(mi, "variable", "left")


# -- N: multilevel ---------------------------------------------------------------------------
_N01 = """SELECT rid, w * count(*) OVER c / sum(w) OVER c aw1, w * sum(w) OVER c / sum(w * w) OVER c bw1 FROM d WINDOW c AS (PARTITION BY cluster)"""


@query("n01_rescaled_weights", with_orders(f"SELECT rid, round(aw1, 8) aw1, round(bw1, 8) bw1 FROM ({_N01})"))
def n01(spark, sf):
    t = N.rescale_weights(order_rows(spark, sf), "cluster", "w")
    return rounded(t.select("rid", "aw1", "bw1"), 8)


@query("n02_weight_correlations", with_orders(f"r AS (SELECT w, aw1, bw1 FROM ({_N01}) JOIN d USING (rid)) " + " UNION ALL ".join(
    f"SELECT '{a}' a, '{b}' b, round(corr({a}, {b}), 8) r FROM r" for a, b in (("w", "w"), ("w", "aw1"), ("w", "bw1"), ("aw1", "aw1"), ("aw1", "bw1"), ("bw1", "bw1")))))
def n02(spark, sf):
    from designstats.operators.frame import correlations

    return rounded(correlations(N.rescale_weights(order_rows(spark, sf), "cluster", "w"), ["w", "aw1", "bw1"]), 8)


_SCHOOLS = {f"{level}_{kind}": float(n) for level, sizes in (("High", (120, 80, 95, 60, 70)), ("Middle", (60, 140, 85, 75, 110)))
            for kind, n in zip(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), sizes)}
# cell of a cluster: level by the parity of its id, type = market segment
_LEVEL = "CASE WHEN cluster % 2 = 0 THEN 'High' ELSE 'Middle' END"


@query("n03_cluster_weights", with_orders(f"""s AS (SELECT level, strata, count(*) n FROM (SELECT DISTINCT cluster, {_LEVEL} AS level, strata FROM d) GROUP BY ALL),
p AS (SELECT * FROM (VALUES {', '.join(f"('{k.split('_')[0]}', '{k.split('_')[1]}', {v})" for k, v in _SCHOOLS.items())}) v(level, strata, value))
SELECT level, strata, round((value / (SELECT sum(value) FROM p)) / (n / (SELECT sum(n) FROM s)), 8) w2 FROM s JOIN p USING (level, strata)"""))
def n03(spark, sf):
    wide = sources.literal_table(spark, [tuple(_SCHOOLS.values())], ", ".join(f"{k} double" for k in _SCHOOLS))
    population = sources.counts_from_wide(wide, ["level", "strata"])
    rows = order_rows(spark, sf).withColumn("level", F.when(F.col("cluster") % 2 == 0, "High").otherwise("Middle"))
    return rounded(N.cluster_weights(rows, "cluster", ["level", "strata"], population), 8)


@query("n04_group_mean_centre", with_orders("SELECT rid, round(happy - avg(happy) OVER (PARTITION BY cluster), 6) mc FROM d"))
def n04(spark, sf):
    return rounded(N.centre_within(order_rows(spark, sf), "cluster", "happy", "mc").select("rid", "mc"))


@lru_cache(maxsize=4)
def _levels_rows(spark, sf):
    rows = N.rescale_weights(order_rows(spark, sf), "cluster", "w")
    rows = N.centre_within(rows, "cluster", "happy", "mc_happy")
    # level-2 weight by stratum; a shared effect per cluster so that its variance is not zero
    return rows.select(
        "cluster", "aw1", "bw1", "mc_happy", "grp3", (1 + F.length("strata") % 3).cast("double").alias("w2"),
        (F.col("y") + (F.col("cluster") % 7) / 3.0 + F.col("mc_happy") * (F.col("cluster") % 5) / 10.0).alias("out"),
    ).persist()


_MODELS = {"M0": ([], None), "MI": (["mc_happy", "grp3"], None), "MIS": (["mc_happy", "grp3"], "mc_happy")}


@lru_cache(maxsize=32)
def _mixed(spark, sf, model, method):
    items, slope = _MODELS[model]
    w1 = {"N": None, "A": "aw1", "B": "bw1"}[method]
    return N.mixed(_levels_rows(spark, sf), "cluster", "out", items, slope, w1, None if w1 is None else "w2", levels=LEVELS)


def _stationary(model, method):
    """The fitted variances solve the likelihood equations (gradient zero relative to size)."""
    def run(spark, sf):
        fit = _mixed(spark, sf, model, method)
        return row_frame(spark, clusters=fit.clusters, params=len(fit.terms) + len(fit.components),
                         worst=round(float(np.max(np.abs(fit.gradient))) / fit.n, 6) + 0.0)
    return run


for _m, _p in (("M0", 3), ("MI", 6), ("MIS", 7)):
    for _k, _id in (("N", "n06" if _m == "MIS" else "n05"), ("A", "n07"), ("B", "n07")):
        query(f"{_id}_mixed_{_m.lower()}_{_k.lower()}", with_orders(
            f"SELECT count(DISTINCT cluster) clusters, CAST({_p} AS BIGINT) params, 0.0::DOUBLE worst FROM d"))(_stationary(_m, _k))


@query("n08_cluster_robust")
def n08(spark, sf):
    return _mixed(spark, sf, "MI", "A").tidy(spark, robust=True)


@query("n09_variance_reduction")
def n09(spark, sf):
    r = N.variance_reduction(_mixed(spark, sf, "M0", "N"), _mixed(spark, sf, "MI", "N"))
    return spark.createDataFrame([(k, float(v)) for k, v in r.items()], "component string, reduction double")


@query("n10_mixed_report")
def n10(spark, sf):
    tidies = {f"{m}-{k}": _mixed(spark, sf, m, k).tidy(spark, robust=k != "N") for m in _MODELS for k in "NAB"}
    return R.mlm_table(tidies)


@query("n11_wald_fixed")
def n11(spark, sf):
    fit = _mixed(spark, sf, "MIS", "A")
    rows = [("joint", *map(float, fit.wald(["mc_happy", "grp3B"]).values())), ("value", *map(float, fit.wald(["mc_happy"], [-0.22]).values()))]
    return spark.createDataFrame(rows, "test string, chisq double, df double, p double")


@query("n12_wald_components")
def n12(spark, sf):
    fit = _mixed(spark, sf, "MIS", "A")
    rows = [("joint", *map(float, fit.wald_components().values())),
            ("value", *map(float, fit.wald_components(["cluster.mc_happy"], [0.06]).values()))]
    return spark.createDataFrame(rows, "test string, chisq double, df double, p double")


# -- O: propensity -----------------------------------------------------------------------------
PS_TERMS = ["y", "cnt", "item1", "w"]


@query("o01_propensity_logit", with_orders("m AS (SELECT grp3, avg(sad) p FROM d GROUP BY 1) SELECT rid, round(p, 6) p FROM d JOIN m USING (grp3)"))
def o01(spark, sf):
    from designstats.operators.predict import predict_response

    d = order_rows(spark, sf)
    fit = G.glm(d, "sad", ["grp3"], "binomial", levels=LEVELS)
    return rounded(predict_response(fit, d, "p").select("rid", "p"))


@lru_cache(maxsize=4)
def _pairs(spark, sf):
    from designstats.operators.predict import predict_response

    d = order_rows(spark, sf)
    fit = G.glm(d, "sad", PS_TERMS, "binomial")
    scored = predict_response(fit, d, "distance0")
    return scored, O.match_nearest(scored, "rid", F.col("sad") == 1, F.col("distance0")).persist()


@query("o02_matching", with_orders("""SELECT least(count(*) FILTER (sad = 1), count(*) FILTER (sad = 0)) pairs, least(count(*) FILTER (sad = 1), count(*) FILTER (sad = 0)) treated,
 least(count(*) FILTER (sad = 1), count(*) FILTER (sad = 0)) controls FROM d"""))
def o02(spark, sf):
    _, pairs = _pairs(spark, sf)
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("treated_id").alias("treated"),
                     F.countDistinct("control_id").alias("controls"))


@query("o03_matched_rows", with_orders("""SELECT sad, least((SELECT count(*) FROM d WHERE sad = 1), (SELECT count(*) FROM d WHERE sad = 0)) n, TRUE unit FROM (SELECT DISTINCT sad FROM d)"""))
def o03(spark, sf):
    scored, pairs = _pairs(spark, sf)
    t = O.matched_rows(scored, "rid", "distance0", pairs)
    return t.groupBy("sad").agg(F.count(F.lit(1)).alias("n"), (F.min("weights") == F.max("weights")).alias("unit"))


@lru_cache(maxsize=4)
def _effects(spark, sf):
    scored, pairs = _pairs(spark, sf)
    design = order_design(spark, sf)
    matched = Design.of(O.matched_rows(scored, "rid", "distance0", pairs), "cluster", "strata", "w", "fpc", validate=False)
    outcome = lambda data: G.glm(data, "happy", ["sad"])
    return {
        "rows": outcome(order_rows(spark, sf)),
        "design": outcome(design),
        "matched": outcome(matched),
        "weighted": outcome(_ate_design(spark, sf)),
    }


@query("o04_att")
def o04(spark, sf):
    return _effects(spark, sf)["matched"].confint(spark)


query("o05_survey_propensity", with_orders("m AS (SELECT grp3, sum(w * sad) / sum(w) p FROM d GROUP BY 1) SELECT rid, round(p, 6) p FROM d JOIN m USING (grp3)"))(
    lambda s, f: Q.k10(s, f))


@lru_cache(maxsize=4)
def _ate_rows(spark, sf):
    from designstats.operators.predict import predict_response

    design = order_design(spark, sf)
    fit = G.glm(design, "sad", ["grp3"], "binomial", levels=LEVELS)
    scored = predict_response(fit, design.variables, "psc")
    return scored.withColumn("iptw", O.iptw(F.col("sad") == 1, F.col("psc"))).withColumn("atewt", F.col("iptw") * F.col("w"))


def _ate_design(spark, sf):
    return Design.of(_ate_rows(spark, sf), "cluster", "strata", "atewt", "fpc", validate=False)


_ATE = """m AS (SELECT grp3, sum(w * sad) / sum(w) p FROM d GROUP BY 1),
e AS (SELECT d.* EXCLUDE (w), w * CASE WHEN sad = 1 THEN 1 / p ELSE 1 / (1 - p) END w, CASE WHEN sad = 1 THEN 1 / p ELSE 1 / (1 - p) END iptw FROM d JOIN m USING (grp3))"""


@query("o06_iptw", with_orders(_ATE + " SELECT rid, round(iptw, 6) iptw, round(w, 6) atewt FROM e"))
def o06(spark, sf):
    return rounded(_ate_rows(spark, sf).select("rid", "iptw", "atewt"))


@query("o07_ate", with_orders(_ATE + f""", g AS (SELECT sad, sum(w) nh, sum(w * happy) / sum(w) mean FROM e GROUP BY sad),
zp AS (SELECT strata, cluster, sum(CASE WHEN sad = 1 THEN 1 ELSE -1 END * w * (happy - mean) / nh) t FROM e JOIN g USING (sad) GROUP BY ALL), zv AS ({tv_sql('zp')})
SELECT 'sad' term, round((SELECT mean FROM g WHERE sad = 1) - (SELECT mean FROM g WHERE sad = 0), 6) estimate, round(sqrt(v), 6) std_error FROM zv"""))
def o07(spark, sf):
    fit = G.glm(_ate_design(spark, sf), "happy", ["sad"])
    return rounded(fit.tidy(spark).where("term = 'sad'").select("term", "estimate", "std_error"))


@query("o08_effect_comparison")
def o08(spark, sf):
    traits = {"rows": {"design": False, "balanced_by": "none"}, "design": {"design": True, "balanced_by": "none"},
              "matched": {"design": True, "balanced_by": "pairs"}, "weighted": {"design": True, "balanced_by": "weights"}}
    return O.effect_table(_effects(spark, sf), "sad", spark, traits)


@query("o09_balance", with_orders(" UNION ALL ".join(
    f"""SELECT '{c}' covariate, round(sum(w * {c}) FILTER (sad = 1) / sum(w) FILTER (sad = 1), 6) mean_treated,
 round(sum(w * {c}) FILTER (sad = 0) / sum(w) FILTER (sad = 0), 6) mean_control,
 round((sum(w * {c}) FILTER (sad = 1) / sum(w) FILTER (sad = 1) - sum(w * {c}) FILTER (sad = 0) / sum(w) FILTER (sad = 0)) / stddev_samp({c}) FILTER (sad = 1), 6) std_diff FROM d"""
    for c in ("y", "cnt", "item1"))))
def o09(spark, sf):
    return rounded(O.balance(order_rows(spark, sf), "sad", ["y", "cnt", "item1"], "w"))


# -- P: reports and chart data -------------------------------------------------------------------
def _cell_sql(est, se):
    return f"printf('%.4f', round({est}, 4)) || {{stars}} || chr(10) || '(' || printf('%.4f', round({se}, 4)) || ')'"


_STAR_SQL = "CASE WHEN z > 3.29053 THEN '***' WHEN z > 2.57583 THEN '**' WHEN z > 1.95996 THEN '*' ELSE '' END"


@query("p01_wrap_cell", with_orders(Q._SVYLM + f""", t AS (SELECT 'cnt' term, b est, sqrt(v) se, abs(b) / sqrt(v) z FROM k, v1 UNION ALL SELECT '(Intercept)', a, sqrt(v), abs(a) / sqrt(v) FROM k, v0)
SELECT term, {_cell_sql('est', 'se').format(stars=_STAR_SQL)} cell_text FROM t"""))
def p01(spark, sf):
    return R.wrap(G.glm(order_design(spark, sf), "y", ["cnt"]).tidy(spark))


def _cells_sql(parts, star, name=lambda n: f"'{n}' term"):
    return " UNION ALL ".join(f"SELECT {name(n)}, {_cell_sql('e', 's').format(stars=star)} cell_text FROM (SELECT {e} e, {se} s, abs({e}) / ({se}) z FROM {src})"
                              for n, e, se, src in parts)


_ONE_TAIL_SQL = "CASE WHEN z > 3.09023 THEN '***' WHEN z > 2.32635 THEN '**' WHEN z > 1.64485 THEN '*' ELSE '' END"


@query("p02_wrap_ordinal", with_orders(Q._ordinal_parts(True)[0] + " " + _cells_sql(Q._ordinal_parts(True)[1], _ONE_TAIL_SQL)))
def p02(spark, sf):
    from designstats.operators.categorical import ordinal

    fit = ordinal(order_design(spark, sf), "happy", [], y_levels=Q.HAPPY)
    return R.wrap_ordinal(fit.tidy(spark), fit.df)


@query("p02_wrap_ordinal_terms")
def p02b(spark, sf):
    fit = Q._ordinal_fit(spark, sf)
    return R.wrap_ordinal(fit.tidy(spark), fit.df)


@query("p03_wrap_negbin")
def p03(spark, sf):
    fit = Q._negbin_full(spark, sf)
    t = fit.tidy(spark).where("term <> 'log(theta)'")
    return R.wrap_negbin(t, (fit.extra["theta"], fit.extra["se_theta"]))


_CATEGORIES = {"1": "lane_1", "2": "lane_2", "3": "lane_3"}


def _multinom_wide_sql():
    ctes, parts = Q._multinom_parts(True)
    long = _cells_sql(parts, _STAR_SQL, lambda n: f"'{n.split(':')[0]}' term, '{n.split(':')[1]}' lev")
    wide = ", ".join(f"max(CASE WHEN lev = '{k}' THEN cell_text END) \"{v}\"" for k, v in _CATEGORIES.items())
    return with_orders(f"{ctes}, q AS ({long}) SELECT term, {wide} FROM q GROUP BY term")


@query("p04_wrap_multinomial", _multinom_wide_sql())
def p04(spark, sf):
    return R.wrap_multinomial(Q._female_fit(spark, sf).tidy(spark), _CATEGORIES)


@query("p04_wrap_multinomial_bootstrap")
def p04b(spark, sf):
    t = Q.j17(spark, sf).select("term", "estimate", "std_error", "p_value")
    return R.wrap_multinomial(t, _CATEGORIES)


@query("p05_model_table", with_orders(Q._SVYLM + f""", o AS (SELECT regr_slope(y, cnt) ob, regr_intercept(y, cnt) oa, count(*) n, regr_sxx(y, cnt) xx, avg(cnt) mx FROM d),
rr AS (SELECT sum(power(y - oa - ob * cnt, 2)) / (min(n) - 2) s2 FROM d, o),
ta AS ({_cells_sql([("cnt", "b", "sqrt(v)", "k, v1"), ("(Intercept)", "a", "sqrt(v)", "k, v0")], _STAR_SQL)}),
tb AS ({_cells_sql([("cnt", "ob", "sqrt(s2 / xx)", "o, rr"), ("(Intercept)", "oa", "sqrt(s2 * (1.0 / n + mx * mx / xx))", "o, rr")], _STAR_SQL)})
SELECT term, tb.cell_text m1_no, ta.cell_text m1_yes FROM ta JOIN tb USING (term)"""))
def p05(spark, sf):
    fits = {"m1_no": G.glm(order_rows(spark, sf), "y", ["cnt"]), "m1_yes": G.glm(order_design(spark, sf), "y", ["cnt"])}
    return R.model_table({k: f.tidy(spark) for k, f in fits.items()})


@query("p05_model_table_interactions")
def p05b(spark, sf):
    fits = {"m1_no": Q._fits(spark, sf, "gaussian", True, True), "m1_yes": Q._fits(spark, sf, "gaussian", False, True),
            "m2_no": Q._fits(spark, sf, "gaussian", True, False), "m2_yes": Q._fits(spark, sf, "gaussian", False, False)}
    return R.model_table({k: f.tidy(spark) for k, f in fits.items()})


_P06 = ("y", "happy", "cnt")


@query("p06_mean_comparison", with_orders(" UNION ALL ".join(f"SELECT '{v}' variable, 'No' AS \"name\", round(avg({v}), 4) mean FROM d UNION ALL SELECT '{v}', 'Yes', round(sum(w * {v}) / sum(w), 4) FROM d" for v in _P06)))
def p06(spark, sf):
    plain = union_tagged({v: mean_interval(order_rows(spark, sf), v) for v in _P06}, "variable")
    report = R.mean_comparison(plain, E.survey_means(order_design(spark, sf), _P06))
    return R.parse_intervals(report).select("variable", "name", "mean")


def _mean_report_sql():
    text = lambda m, half: f"printf('%.4f', round({m}, 4)) || chr(10) || '(' || printf('%.4f', round({m} - {half}, 4)) || ', ' || printf('%.4f', round({m} + {half}, 4)) || ')'"
    parts = []
    for v in _P06:
        plain = text(f"avg({v})", f"{tq_sql('(count(*) - 1)')} * stddev_samp({v}) / sqrt(count(*))")
        survey = text("mean", f"{tq_sql(DF_SQL)} * sqrt(v)")
        parts.append(with_orders(mean_sql(v) + f" SELECT '{v}' variable, (SELECT {plain} FROM d) AS \"no\", {survey} yes FROM mt, mv"))
    return "SELECT * FROM (" + ") UNION ALL SELECT * FROM (".join(parts) + ")"


@query("g18_mean_report", _mean_report_sql())
def g18(spark, sf):
    plain = union_tagged({v: mean_interval(order_rows(spark, sf), v) for v in _P06}, "variable")
    return R.mean_comparison(plain, E.survey_means(order_design(spark, sf), _P06))


@query("p06_share_bars", with_orders("""SELECT 'No' cs, grp3, count(*)::DOUBLE n, round(count(*) / (SELECT count(*) FROM d), 8) prop FROM d GROUP BY grp3
UNION ALL SELECT 'Yes', grp3, sum(w), round(sum(w) / (SELECT sum(w) FROM d), 8) FROM d GROUP BY grp3"""))
def p06b(spark, sf):
    from designstats.operators.frame import count_share

    no = count_share(order_rows(spark, sf), ["grp3"]).withColumn("n", F.col("n").cast("double"))
    yes = E.survey_count(order_design(spark, sf), "grp3", prop=True).select("grp3", "n", "prop")
    return rounded(union_tagged({"No": no, "Yes": yes}, "cs"), 8)


@query("p06_prediction_ribbon", with_orders(Q._WLS + """, g AS (SELECT unnest([0.0, 2.0, 4.0]) c), o AS (SELECT regr_slope(y, cnt) ob, regr_intercept(y, cnt) oa FROM d)
SELECT 'design' model, CAST(c AS DOUBLE) cnt, round(a + b * c, 6) predy FROM g, k
UNION ALL SELECT 'rows', c, round(oa + ob * c, 6) FROM g, o"""))
def p06c(spark, sf):
    from designstats.operators.frame import prediction_grid
    from designstats.operators.predict import band, predict

    grid = prediction_grid(spark, cnt=[0.0, 2.0, 4.0])
    fits = {"design": Q._lin(spark, sf), "rows": G.glm(order_rows(spark, sf), "y", ["cnt"])}
    t = union_tagged({k: band(predict(f, grid)) for k, f in fits.items()}, "model")
    return rounded(t.select("model", "cnt", "predy"))


@query("p07_fourfold_table", with_orders("""SELECT CASE sad WHEN 0 THEN 'No' ELSE 'Yes' END sad, round(sum(w) FILTER (female = '0')) "open_orders", round(sum(w) FILTER (female = '1')) "filled_orders" FROM d WHERE grp3 = 'A' GROUP BY 1"""))
def p07(spark, sf):
    design = order_design(spark, sf).subset(F.col("grp3") == "A")
    t = to_wide(E.survey_table(design, "sad", "female"), ["sad"], "female", "n", ["0", "1"])
    return t.select(F.when(F.col("sad") == 0, "No").otherwise("Yes").alias("sad"), F.round("0").alias("open_orders"), F.round("1").alias("filled_orders"))


@query("p08_labels_two_by_two", """SELECT quality, toxic, count(*) n, round(count(*) / (SELECT count(*) FROM labels), 8) prop FROM labels JOIN documents USING (doc_id) GROUP BY ALL""")
def p08(spark, sf):
    from designstats.operators.frame import count_share

    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id"), "doc_id")
    return rounded(count_share(rows, ["quality", "toxic"]), 8)
