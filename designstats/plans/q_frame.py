"""Sources (A), projections (B), filters (CF), joins and reshapes (D), plain aggregates (E)."""

from pyspark.sql import Window, functions as F

from designstats import sources
from designstats.functions import columns as C
from designstats.operators import frame as X
from designstats.operators import estimate as E
from designstats.plans.fixtures import order_design, order_rows, table, tq_sql, with_orders
from designstats.plans.registry import query
from designstats.session import scratch_path


def simple(name, oracle):
    """Register a query on the order rows."""
    def register(fn):
        query(name, with_orders(oracle))(lambda spark, sf: fn(order_rows(spark, sf)))
        return fn
    return register


# -- A: sources and sinks --------------------------------------------------------
@query("a01_load_labelled", "SELECT l_returnflag flag, count(*) n, 'Accepted' label_a FROM lineitem GROUP BY 1")
def a01(spark, sf):
    df = sources.read_table(spark, f"{sf}/lineitem.parquet",
                            labels={"l_returnflag": {"A": "Accepted", "N": "None", "R": "Returned"}})
    label = sources.tables.value_labels(df, "l_returnflag")["A"]
    return df.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"),
                                                               F.lit(label).alias("label_a"))


@query("a02_lower_names", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def a02(spark, sf):
    nation = table(spark, sf, "nation")
    return sources.lower_names(nation.toDF(*[c.upper() for c in nation.columns]))


@query("a03_side_table", "SELECT r_name, count(*) n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def a03(spark, sf):
    side = table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return X.lookup_join(table(spark, sf, "nation"), side, ["n_regionkey"]).groupBy("r_name").agg(
        F.count(F.lit(1)).alias("n"))


@query("a04_report_csv", with_orders("""SELECT grp3, printf('%.4f', round(avg(y), 4)) || chr(10) || '(' || count(*) || ')' cell_text
FROM d GROUP BY grp3"""))
def a04(spark, sf):
    t = order_rows(spark, sf).groupBy("grp3").agg(F.avg("y").alias("m"), F.count(F.lit(1)).alias("n"))
    t = t.select("grp3", F.concat(C.fixed("m"), F.lit("\n("), F.col("n").cast("string"), F.lit(")")).alias("cell_text"))
    path = scratch_path(spark, "report")
    sources.write_report(t, path)
    return sources.read_table(spark, path, "csv", schema="grp3 string, cell_text string")


@query("a05_literal_table", "SELECT grp3, label, count(*) n FROM (" + with_orders(
    "SELECT grp3 FROM d") + ") JOIN (VALUES ('A', 'first'), ('B', 'second'), ('C', 'third')) v(grp3, label) USING (grp3) GROUP BY ALL")
def a05(spark, sf):
    names = sources.literal_table(spark, [("A", "first"), ("B", "second"), ("C", "third")], "grp3 string, label string")
    return order_rows(spark, sf).join(F.broadcast(names), "grp3").groupBy("grp3", "label").agg(F.count(F.lit(1)).alias("n"))


@query("a06_inspect", "SELECT count(*) n_rows, 11 n_cols FROM lineitem")
def a06(spark, sf):
    df = table(spark, sf, "lineitem")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_cols"))


@query("a07_saved_fit", with_orders("SELECT grp3 term, round(sum(w * y) / sum(w), 8) estimate FROM d GROUP BY grp3"))
def a07(spark, sf):
    t = E.survey_mean(order_design(spark, sf).group_by("grp3"), "y", df=float("inf"))
    path = scratch_path(spark, "fit")
    sources.save_fit_table(t.select(F.col("grp3").alias("term"), F.round("mean", 8).alias("estimate")), path)
    return sources.load_fit_table(spark, path)


# -- B: projections ----------------------------------------------------------------
@simple("b01_mutate_sequence", "SELECT rid, cnt * 2 a, cnt * 2 + 1 c, cnt * 4 + 2 e FROM d")
def b01(d):
    return d.withColumn("a", F.col("cnt") * 2).withColumn("c", F.col("a") + 1).withColumn(
        "e", F.col("c") * 2).select("rid", "a", "c", "e")


@simple("b02_if_else_null", """SELECT rid, CASE WHEN spend IS NULL THEN NULL WHEN spend > 3 THEN 'hi'
 WHEN spend = 0 THEN 'none' ELSE 'lo' END v FROM d""")
def b02(d):
    s = F.col("spend")
    return d.select("rid", C.if_else(s > 3, "hi", C.if_else(s == 0, "none", "lo")).alias("v"))


@simple("b03_factor_labels", """SELECT CASE happy WHEN 1 THEN 'vh' WHEN 2 THEN 'h' WHEN 3 THEN 'm' WHEN 4 THEN 'l' ELSE 'vl' END f,
 count(*) n FROM d GROUP BY 1""")
def b03(d):
    return X.count(X.as_factor(d, "happy", ["vh", "h", "m", "l", "vl"], "f"), "f")


@simple("b04_first_appearance", """SELECT grp3, n, CAST(row_number() OVER (ORDER BY n DESC, grp3) AS INTEGER) ord
 FROM (SELECT grp3, count(*) n FROM d GROUP BY 1)""")
def b04(d):
    from designstats.operators.report import first_appearance

    return first_appearance(X.count(d, "grp3"), "grp3", [F.desc("n"), "grp3"])


@simple("b05_arithmetic", "SELECT rid, age_m / 12 agey, 6 - happy rev, power(cnt, 2) sq, (5 * cnt + 2 * happy) / 420 hrs FROM d")
def b05(d):
    return d.select("rid", (F.col("age_m") / 12).alias("agey"), (6 - F.col("happy")).alias("rev"),
                    F.pow("cnt", F.lit(2)).alias("sq"), ((5 * F.col("cnt") + 2 * F.col("happy")) / 420).alias("hrs"))


@simple("b06_row_mean", "SELECT rid, 5 - (item1 + item2 + spend) / 3 score FROM d")
def b06(d):
    return d.select("rid", (5 - C.row_mean(["item1", "item2", "spend"])).alias("score"))


@simple("b07_null_fill", "SELECT rid, coalesce(spend, 0) spend0 FROM d")
def b07(d):
    return d.select("rid", C.fill_null("spend", 0.0).alias("spend0"))


@simple("b08_null_by_condition", "SELECT rid, CASE WHEN use_flag = '1' THEN item1 END v FROM d")
def b08(d):
    return d.select("rid", C.null_unless(F.col("use_flag") == "1", "item1").alias("v"))


@simple("b09_select_columns", "SELECT rid, item1, item2, item3, y, happy, cnt FROM d")
def b09(d):
    picked = ["rid", *C.cols(d, prefix="item"), "y",
              *[c for c in C.cols(d, dtype="double", between=("spend", "cnt")) if c != "spend"]]
    return d.select(*picked)


@simple("b10_rename", "SELECT rid, y price, happy mood FROM d")
def b10(d):
    return d.withColumnsRenamed({"y": "price", "happy": "mood"}).select("rid", "price", "mood")


@simple("b11_across", """SELECT round(avg(y), 8) y, round(avg(spend), 8) spend, round(avg(happy), 8) happy,
 round(avg(cnt), 8) cnt FROM d""")
def b11(d):
    return d.agg(*[F.round(F.avg(c), 8).alias(c) for c in ("y", "spend", "happy", "cnt")])


@simple("b12_centre_plain", "SELECT rid, round(y - (SELECT avg(y) FROM d), 8) y, round(spend - (SELECT avg(spend) FROM d), 8) spend FROM d")
def b12(d):
    from designstats.operators.design import Design

    out = E.centre(Design.of(d, "cluster", "strata", "w", validate=False), "y", "spend", weighted=False)
    return out.variables.select("rid", F.round("y", 8).alias("y"), F.round("spend", 8).alias("spend"))


@query("b13_centre_weighted", with_orders("""SELECT rid, round(y - (SELECT sum(w * y) / sum(w) FROM d), 8) y,
 round(spend - (SELECT sum(w * spend) / sum(w) FROM d WHERE spend IS NOT NULL), 8) spend FROM d"""))
def b13(spark, sf):
    out = E.centre(order_design(spark, sf), "y", "spend")
    return out.variables.select("rid", F.round("y", 8).alias("y"), F.round("spend", 8).alias("spend"))


@simple("b14_concat", "SELECT rid, grp3 || '-' || female || '-' || CASE WHEN spend > 3 THEN 'x' END v FROM d")
def b14(d):
    return d.select("rid", F.concat("grp3", F.lit("-"), "female", F.lit("-"), F.when(F.col("spend") > 3, "x")).alias("v"))


@simple("b15_fixed_text", "SELECT rid, printf('%.4f', round(cnt / 8, 4)) v, printf('%.4f', round(w * 1000, 4)) big FROM d")
def b15(d):
    return d.select("rid", C.fixed(F.col("cnt") / 8).alias("v"), C.fixed(F.col("w") * 1000).alias("big"))


@simple("b16_round", "SELECT rid, round(y, 3) y3, round(w / 3, 4) w4 FROM d")
def b16(d):
    return d.select("rid", F.round("y", 3).alias("y3"), F.round(F.col("w") / 3, 4).alias("w4"))


@query("b17_detect", "SELECT o_orderkey, contains(o_orderpriority, 'HIGH') has, o_orderpriority LIKE '4%' starts, regexp_matches(o_orderpriority, '^[12]-') top FROM orders")
def b17(spark, sf):
    p = F.col("o_orderpriority")
    return table(spark, sf, "orders").select("o_orderkey", p.contains("HIGH").alias("has"),
                                             p.startswith("4").alias("starts"), p.rlike("^[12]-").alias("top"))


@query("b18_remove_replace", """SELECT o_orderkey, replace(o_orderpriority, 'E', '') all_e, regexp_replace(o_orderpriority, 'E', '') first_e,
 replace(o_orderpriority, 'NOT SPECIFIED', 'NONE') swapped FROM orders""")
def b18(spark, sf):
    p = F.col("o_orderpriority")
    first = F.regexp_replace(p, "^([^E]*)E", "$1")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.regexp_replace(p, "E", "").alias("all_e"), first.alias("first_e"),
        F.replace(p, F.lit("NOT SPECIFIED"), F.lit("NONE")).alias("swapped"))


@query("b19_extract", "SELECT c_custkey, regexp_extract(c_name, '(\\d)$', 1) last_digit FROM customer")
def b19(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.regexp_extract("c_name", r"(\d)$", 1).alias("last_digit"))


@query("b20_separate", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) code, split_part(o_orderpriority, '-', 2) label FROM orders")
def b20(spark, sf):
    parts = F.split("o_orderpriority", "-")
    return table(spark, sf, "orders").select("o_orderkey", parts.getItem(0).alias("code"), parts.getItem(1).alias("label"))


@simple("b21_cast", "SELECT rid, CAST(female AS DOUBLE) f, CAST(sad AS VARCHAR) s FROM d")
def b21(d):
    return d.select("rid", F.col("female").cast("double").alias("f"), F.col("sad").cast("string").alias("s"))


@simple("b22_cut_stars", """SELECT rid, CASE WHEN p <= 0.001 THEN '***' WHEN p <= 0.01 THEN '**' WHEN p <= 0.05 THEN '*' WHEN p <= 1 THEN '' END s,
 CASE WHEN p <= 0.001 THEN '***' WHEN p <= 0.5 THEN '**' WHEN p <= 1 THEN '' END s2 FROM (SELECT rid, y / 5 p FROM d)""")
def b22(d):
    p = F.col("y") / 5
    return d.select("rid", C.stars(p).alias("s"), C.stars(p, C.PATH_STAR_BREAKS, C.PATH_STAR_LABELS).alias("s2"))


@simple("b23_math", """SELECT rid, round(exp(-y), 8) e, round(1 / (1 + exp(-y)), 8) lg, abs(happy - 3) ab, round(sqrt(cnt), 8) sq,
 least(item1, item2, item3) lo, greatest(item1, item2, item3) hi FROM d""")
def b23(d):
    return d.select("rid", F.round(F.exp(-F.col("y")), 8).alias("e"), F.round(C.logistic("y"), 8).alias("lg"),
                    F.abs(F.col("happy") - 3).alias("ab"), F.round(F.sqrt("cnt"), 8).alias("sq"),
                    F.least("item1", "item2", "item3").alias("lo"), F.greatest("item1", "item2", "item3").alias("hi"))


@simple("b24_row_min_max", "SELECT rid, least(y, happy) ll, greatest(y, happy) ul FROM d")
def b24(d):
    return d.select("rid", F.least("y", "happy").alias("ll"), F.greatest("y", "happy").alias("ul"))


@simple("b25_diff_to_class", """SELECT rid, c, round(p, 8) p FROM (SELECT rid, 1 c, item1 / 10 p FROM d UNION ALL
 SELECT rid, 2, (4 + item2) / 10 - item1 / 10 FROM d UNION ALL SELECT rid, 3, 1 - (4 + item2) / 10 FROM d)""")
def b25(d):
    from designstats.operators.predict import differences

    probs = differences([F.col("item1") / 10, (4 + F.col("item2")) / 10])
    return d.select("rid", F.posexplode(F.array(*probs))).select("rid", (F.col("pos") + 1).alias("c"),
                                                                 F.round("col", 8).alias("p"))


@query("b26_distribution_tails")
def b26(spark, sf):
    """Two-sided p-values of the grouped means against 2.5 (one row per group)."""
    from designstats.functions.dist import norm_pvalue_col, t_pvalue_col

    t = E.survey_mean(order_design(spark, sf).group_by("grp3"), "y", df=float("inf"))
    z = (F.col("mean") - 2.5) / F.col("se")
    return t.select("grp3", t_pvalue_col(z, F.lit(float(order_design(spark, sf).degf()))).alias("p_t"), norm_pvalue_col(z).alias("p_z"))


_U = "(('0x' || substr(md5('{t}|' || rid), 1, 12))::BIGINT + 0.5) / 281474976710656.0"


@query("b27_seeded_normals", with_orders(f"SELECT rid, round(sqrt(-2 * ln({_U.format(t=1)})) * cos(2 * pi() * {_U.format(t=2)}), 6) x FROM d"))
def b27(spark, sf):
    """Normal noise keyed by seed and row id, so that it does not depend on the partitioning."""
    return order_rows(spark, sf).select("rid", F.round(C.seeded_normal("rid", 1), 6).alias("x"))


# -- CF: filters ---------------------------------------------------------------------
@simple("cf01_row_filter", "SELECT grp3, count(*) n FROM d WHERE use_flag = '0' GROUP BY 1")
def cf01(d):
    return X.count(d.where(F.col("use_flag") == "0"), "grp3")


@query("cf02_domain_keeps_psus", with_orders("""SELECT (SELECT CAST(sum(n_h) AS BIGINT) FROM h) n_psu,
 (SELECT count(DISTINCT cluster) FROM d WHERE use_flag = '0') psu_with_rows, (SELECT sum(w) FROM d WHERE use_flag = '0') pop"""))
def cf02(spark, sf):
    design = order_design(spark, sf).filter(F.col("use_flag") == "0")
    psus = design.strata().agg(F.sum("n_h").alias("p")).scalar()
    filled = design.domain_rows().select("cluster").distinct().agg(F.count(F.lit(1)).alias("c")).scalar()
    return design.domain_rows().agg(psus.alias("n_psu"), filled.alias("psu_with_rows"), F.sum("w").alias("pop"))


@simple("cf03_drop_null", "SELECT count(*) n, sum(spend) s FROM d WHERE spend IS NOT NULL")
def cf03(d):
    return d.dropna(subset=["spend"]).agg(F.count(F.lit(1)).alias("n"), F.sum("spend").alias("s"))


@simple("cf04_predicates", "SELECT count(*) n FROM d WHERE grp3 = 'A' OR grp3 = 'C' OR (happy <> 3 AND cnt >= 6)")
def cf04(d):
    g = F.col("grp3")
    return d.where((g == "A") | (g == "C") | ((F.col("happy") != 3) & (F.col("cnt") >= 6))).agg(F.count(F.lit(1)).alias("n"))


@query("cf05_listwise_domain", with_orders("SELECT count(*) n, sum(w) pop FROM d WHERE spend IS NOT NULL AND age_m IS NOT NULL"))
def cf05(spark, sf):
    design = order_design(spark, sf).filter(F.col("spend").isNotNull() & F.col("age_m").isNotNull())
    return design.domain_rows().agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("pop"))


# -- D: joins and reshapes -------------------------------------------------------------
@query("d01_inner_join", with_orders("""SELECT d.strata, d.female, CAST(sum(d.cnt) AS DOUBLE) s, min(k.m) m FROM d JOIN
 (SELECT strata, female, max(happy) m FROM d GROUP BY ALL) k ON d.strata = k.strata AND d.female = k.female GROUP BY ALL"""))
def d01(spark, sf):
    d = order_rows(spark, sf)
    k = d.groupBy("strata", "female").agg(F.max("happy").alias("m"))
    return X.lookup_join(d, k, ["strata", "female"], "inner").groupBy("strata", "female").agg(
        F.sum("cnt").alias("s"), F.min("m").alias("m"))


@query("d02_full_join", """SELECT coalesce(a.k, b.k) k, na, nb FROM (SELECT l_linenumber - 3 k, count(*) na FROM lineitem GROUP BY 1) a
 FULL JOIN (SELECT p_size k, count(*) nb FROM part GROUP BY 1) b ON a.k = b.k""")
def d02(spark, sf):
    a = X.count(table(spark, sf, "lineitem").select((F.col("l_linenumber") - 3).alias("k")), "k", name="na")
    b = X.count(table(spark, sf, "part").withColumnRenamed("p_size", "k"), "k", name="nb")
    return a.join(b, "k", "full")


@query("d03_left_join", "SELECT o_orderkey, label FROM orders LEFT JOIN (VALUES ('F', 'final'), ('O', 'open')) v(s, label) ON o_orderstatus = s")
def d03(spark, sf):
    names = sources.literal_table(spark, [("F", "final"), ("O", "open")], "o_orderstatus string, label string")
    return table(spark, sf, "orders").join(F.broadcast(names), "o_orderstatus", "left").select("o_orderkey", "label")


@simple("d04_attach_total", "SELECT grp3, n, n / (SELECT count(*) FROM d) prop FROM (SELECT grp3, count(*) n FROM d GROUP BY 1)")
def d04(d):
    t = X.count(d, "grp3")
    return t.withColumn("prop", F.col("n") / d.agg(F.count(F.lit(1)).alias("s")).scalar())


@simple("d05_union_fill", """SELECT grp3 g, count(*) n, NULL::DOUBLE m, 'a' tag FROM d GROUP BY 1
 UNION ALL SELECT female, NULL, avg(cnt), 'b' FROM d GROUP BY 1""")
def d05(d):
    a = X.count(d, "grp3").withColumnRenamed("grp3", "g")
    b = d.groupBy(F.col("female").alias("g")).agg(F.avg("cnt").alias("m"))
    return X.union_tagged({"a": a, "b": b}, "tag")


@simple("d06_map_union", " UNION ALL ".join(f"SELECT '{v}' variable, {v} AS \"group\", count(*) n FROM d GROUP BY {v}" for v in ("female", "grp3", "use_flag")))
def d06(d):
    tables = {v: X.count(d.withColumn("group", F.col(v)), "group") for v in ("female", "grp3", "use_flag")}
    return X.union_tagged(tables, "variable")


@simple("d07_to_long", """SELECT strata, name, round(value, 8) value FROM (UNPIVOT (SELECT strata, avg(y) y, avg(cnt) cnt, avg(happy) happy FROM d GROUP BY 1)
 ON y, cnt, happy INTO NAME name VALUE value)""")
def d07(d):
    t = d.groupBy("strata").agg(F.avg("y").alias("y"), F.avg("cnt").alias("cnt"), F.avg("happy").alias("happy"))
    return X.to_long(t, ["strata"], ["y", "cnt", "happy"]).withColumn("value", F.round("value", 8))


@simple("d08_to_wide", """SELECT strata, max(CASE WHEN female = '0' THEN n END) f0, max(CASE WHEN female = '1' THEN n END) f1 FROM
 (SELECT strata, female, count(*) n FROM d GROUP BY ALL) GROUP BY strata""")
def d08(d):
    return X.to_wide(X.count(d, "strata", "female"), ["strata"], "female", "n", ["0", "1"]).withColumnsRenamed({"0": "f0", "1": "f1"})


@simple("d08_to_wide_values", """SELECT strata, max(CASE WHEN female = '0' THEN n END) "0_n", max(CASE WHEN female = '0' THEN m END) "0_m",
 max(CASE WHEN female = '1' THEN n END) "1_n", max(CASE WHEN female = '1' THEN m END) "1_m" FROM
 (SELECT strata, female, count(*) n, max(cnt) m FROM d GROUP BY ALL) GROUP BY strata""")
def d08b(d):
    t = d.groupBy("strata", "female").agg(F.count(F.lit(1)).alias("n"), F.max("cnt").alias("m"))
    return X.to_wide(t, ["strata"], "female", ["n", "m"], ["0", "1"])


@simple("d09_unnest", "SELECT strata, unnest([min(cnt), max(cnt)]) v FROM d GROUP BY strata")
def d09(d):
    return d.groupBy("strata").agg(F.array(F.min("cnt"), F.max("cnt")).alias("v")).select("strata", F.explode("v").alias("v"))


@query("d10_prediction_grid", with_orders("""SELECT a, round(c - (SELECT sum(w * happy) / sum(w) FROM d), 8) c, u FROM (SELECT unnest([0.0, 1.0]) a),
 (SELECT CAST(unnest([1, 2, 3, 4]) AS DOUBLE) c), (SELECT '1' u)"""))
def d10(spark, sf):
    m = E.weighted_mean(order_design(spark, sf).domain_rows(), "happy")
    grid = X.prediction_grid(spark, a=[0.0, 1.0], c=[1.0, 2.0, 3.0, 4.0], u=["1"])
    return grid.withColumn("c", F.round(F.col("c") - m, 8))


@simple("d11_row_id", "SELECT strata, female, n, CAST(row_number() OVER (ORDER BY strata, female) AS INTEGER) rid FROM (SELECT strata, female, count(*) n FROM d GROUP BY ALL)")
def d11(d):
    t = X.count(d, "strata", "female")
    return t.withColumn("rid", F.row_number().over(Window.orderBy("strata", "female")))


@query("d11_number_rows", with_orders("""SELECT strata, cluster, row_number() OVER (PARTITION BY strata
 ORDER BY ('0x' || substr(md5(CAST(cluster AS VARCHAR)), 1, 2))::BIGINT, cluster) rn FROM (SELECT DISTINCT strata, cluster FROM d)"""))
def d11b(spark, sf):
    psus = order_rows(spark, sf).select("strata", "cluster").distinct()
    return X.number_rows(psus, ["strata"], "cluster")


@simple("d12_transpose", """SELECT name, max(CASE WHEN strata = 'BUILDING' THEN value END) "BUILDING", max(CASE WHEN strata = 'MACHINERY' THEN value END) "MACHINERY"
 FROM (UNPIVOT (SELECT strata, round(avg(y), 8) y, round(avg(cnt), 8) cnt FROM d GROUP BY 1) ON y, cnt INTO NAME name VALUE value) GROUP BY name""")
def d12(d):
    t = d.groupBy("strata").agg(F.round(F.avg("y"), 8).alias("y"), F.round(F.avg("cnt"), 8).alias("cnt"))
    return X.to_wide(X.to_long(t, ["strata"], ["y", "cnt"]), ["name"], "strata", "value", ["BUILDING", "MACHINERY"])


@query("d13_paired_comparison", with_orders("""x AS (SELECT grp3, avg(y) m FROM d GROUP BY 1), z AS (SELECT grp3, sum(w * y) / sum(w) m FROM d GROUP BY 1)
SELECT grp3, round(z.m / x.m, 8) ratio, abs(x.m) > abs(z.m) conserv FROM x JOIN z USING (grp3)"""))
def d13(spark, sf):
    d = order_rows(spark, sf)
    x = d.groupBy("grp3").agg(F.avg("y").alias("est_x"))
    z = E.survey_mean(order_design(spark, sf).group_by("grp3"), "y", df=float("inf")).select("grp3", F.col("mean").alias("est_y"))
    t = x.join(z, "grp3")
    return t.select("grp3", F.round(F.col("est_y") / F.col("est_x"), 8).alias("ratio"),
                    (F.abs("est_x") > F.abs("est_y")).alias("conserv"))


# -- E: plain aggregates ---------------------------------------------------------------
@simple("e01_count", "SELECT grp3, spend, count(*) n FROM d GROUP BY ALL")
def e01(d):
    return X.count(d, "grp3", "spend")


@simple("e02_share_overall", "SELECT female, count(*) n, round(count(*) / (SELECT count(*) FROM d), 8) prop FROM d GROUP BY 1")
def e02(d):
    return X.count_share(d, ["female"]).withColumn("prop", F.round("prop", 8))


@simple("e03_share_within", """SELECT female, grp3, sad, n, round(n / sum(n) OVER (PARTITION BY female, grp3), 8) prop FROM
 (SELECT female, grp3, sad, count(*) n FROM d GROUP BY ALL)""")
def e03(d):
    return X.count_share(d, ["sad"], ["female", "grp3"]).withColumn("prop", F.round("prop", 8))


@simple("e04_fpc_constancy", "SELECT n_fpc, count(*) n FROM (SELECT cluster, count(DISTINCT fpc) n_fpc FROM d GROUP BY 1) GROUP BY 1")
def e04(d):
    return X.fpc_constancy(d, "cluster", "fpc")


@simple("e05_group_summary", "SELECT grp3, round(avg(y), 8) m, sum(w) s FROM d GROUP BY 1")
def e05(d):
    return d.groupBy("grp3").agg(F.round(F.avg("y"), 8).alias("m"), F.sum("w").alias("s"))


@simple("e05_strict_mean", "SELECT grp3, round(CASE WHEN count(spend) = count(*) THEN avg(spend) END, 8) m, round(avg(cnt), 8) c FROM d GROUP BY 1")
def e05b(d):
    return d.groupBy("grp3").agg(F.round(C.strict_mean("spend"), 8).alias("m"), F.round(C.strict_mean("cnt"), 8).alias("c"))


@simple("e06_group_mutate", "SELECT rid, sum(w) OVER (PARTITION BY cluster) sumw, count(*) OVER (PARTITION BY cluster) nj, round(cnt - avg(cnt) OVER (PARTITION BY cluster), 6) dev FROM d")
def e06(d):
    t = X.group_attach(d, ["cluster"], sumw=F.sum("w"), nj=F.count(F.lit(1)), m=F.avg("cnt"))
    return t.select("rid", "sumw", "nj", F.round(F.col("cnt") - F.col("m"), 6).alias("dev"))


@simple("e07_row_number", "SELECT strata, grp3, CAST(row_number() OVER (PARTITION BY strata ORDER BY n DESC, grp3) AS INTEGER) rn FROM (SELECT strata, grp3, count(*) n FROM d GROUP BY ALL)")
def e07(d):
    w = Window.partitionBy("strata").orderBy(F.desc("n"), "grp3")
    return X.count(d, "strata", "grp3").select("strata", "grp3", F.row_number().over(w).alias("rn"))


@simple("e08_whole_table", "SELECT count(*) n, sum(w) s FROM d")
def e08(d):
    return d.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("s"))


@simple("e09_mean_var", "SELECT round(avg(y), 8) m, round(var_samp(y), 8) v FROM d")
def e09(d):
    return d.agg(F.round(F.avg("y"), 8).alias("m"), F.round(F.var_samp("y"), 8).alias("v"))


@simple("e10_quantiles", "SELECT CAST(p AS DOUBLE) p, round(quantile_cont(y, p), 8) quantile FROM d, (SELECT unnest([0, 0.25, 0.5, 0.75, 1]) p) GROUP BY p".replace(
    "quantile_cont(y, p)", "CASE p WHEN 0 THEN min(y) WHEN 0.25 THEN quantile_cont(y, 0.25) WHEN 0.5 THEN quantile_cont(y, 0.5) WHEN 0.75 THEN quantile_cont(y, 0.75) ELSE max(y) END"))
def e10(d):
    return X.quantile_type7(d, "y", [0.0, 0.25, 0.5, 0.75, 1.0]).withColumn("quantile", F.round("quantile", 8))


_E11 = f"""round(avg(y), 8) mean, round(avg(y) - {tq_sql('(count(*) - 1)')} * stddev_samp(y) / sqrt(count(*)), 6) low,
 round(avg(y) + {tq_sql('(count(*) - 1)')} * stddev_samp(y) / sqrt(count(*)), 6) upp"""


@simple("e11_mean_interval", f"SELECT female, grp3, {_E11} FROM d GROUP BY ALL")
def e11(d):
    t = X.mean_interval(d, "y", ["female", "grp3"])
    return t.select("female", "grp3", F.round("mean", 8).alias("mean"), F.round("low", 6).alias("low"), F.round("upp", 6).alias("upp"))


@simple("e12_crosstab", "SELECT female, count(*) FILTER (sad = 0) \"0\", count(*) FILTER (sad = 1) \"1\" FROM d WHERE use_flag = '0' GROUP BY 1")
def e12(d):
    return X.crosstab(d.where("use_flag = '0'"), "female", "sad", [0, 1])


@simple("e13_correlations", " UNION ALL ".join(f"SELECT '{a}' a, '{b}' b, round(corr({a}, {b}), 8) r FROM d" for a, b in (("w", "w"), ("w", "y"), ("w", "cnt"), ("y", "y"), ("y", "cnt"), ("cnt", "cnt"))))
def e13(d):
    return X.correlations(d, ["w", "y", "cnt"]).withColumn("r", F.round("r", 8))


@simple("e14_arrange", "SELECT grp3, n, CAST(row_number() OVER (ORDER BY n) AS INTEGER) place FROM (SELECT grp3, count(*) n FROM d GROUP BY 1) ORDER BY n")
def e14(d):
    t = X.count(d, "grp3").orderBy("n")
    return t.withColumn("place", F.row_number().over(Window.orderBy("n")))


@simple("e15_top_k", "SELECT rid, y FROM d ORDER BY y DESC, rid LIMIT 6")
def e15(d):
    return d.select("rid", "y").orderBy(F.desc("y"), "rid").limit(6)


@simple("e16_histogram", """SELECT CAST(k AS INTEGER) bin, 150 + (k + 0.5) * 5 mids, round(count(*) / (SELECT count(age_m) FROM d) / 5, 8) density
 FROM (SELECT least(greatest(ceil((age_m - 150) / 5) - 1, 0), 11) k FROM d WHERE age_m IS NOT NULL) GROUP BY k""")
def e16(d):
    return E.histogram(d, "age_m", E.default_breaks(d, "age_m")).withColumn("density", F.round("density", 8))


@simple("e17_jackknife_mean", "SELECT round(avg(y), 8) jack_mean, round(var_samp(y), 8) jack_var FROM d")
def e17(d):
    return X.jackknife_mean(d, "y").select(F.round("jack_mean", 8).alias("jack_mean"), F.round("jack_var", 8).alias("jack_var"))
