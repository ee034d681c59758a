"""Survey-like tables derived from the driver's tables, in DataFrame form and as SQL."""

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from designstats.operators.design import Design
from designstats.operators.frame import lookup_join


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@lru_cache(maxsize=64)
def order_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order; strata = market segment, cluster = customer."""
    orders = table(spark, sf, "orders")
    customer = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    base = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("rid"), F.col("c_mktsegment").alias("strata"),
        F.col("o_custkey").alias("cluster"), F.col("o_orderstatus").alias("st"),
        F.col("o_totalprice").alias("tp"), F.col("o_orderpriority").alias("pr"),
    )
    sizes = base.groupBy("strata", "cluster").agg(F.lit(1).alias("one"))
    sizes = sizes.groupBy("strata").agg(F.count("one").alias("npsu"))
    d = lookup_join(base, sizes, ["strata"], "inner")
    rid, tp, cl = F.col("rid"), F.col("tp"), F.col("cluster")
    price_class = F.floor(tp / 1000)
    as_double = lambda c: c.cast("double")
    return d.select(
        "rid", "strata", "cluster",
        as_double(1 + rid % 5).alias("w"),
        as_double(2 * F.col("npsu")).alias("fpc"),
        F.when(F.col("st") == "F", "1").otherwise("0").alias("female"),
        F.when(F.col("pr").startswith("1") | F.col("pr").startswith("2"), "A")
        .when(F.col("pr").startswith("3"), "B").otherwise("C").alias("grp3"),
        F.when(rid % 10 == 3, "0").otherwise("1").alias("use_flag"),
        (tp / 100000.0).alias("y"),
        F.when(rid % 10 != 3, as_double(rid % 7)).alias("spend"),
        as_double(1 + F.floor(tp) % 5).alias("happy"),
        as_double((rid * 3 + cl) % 8).alias("cnt"),
        F.when((rid * 7 + cl) % 3 == 0, 1).otherwise(0).alias("sad"),
        as_double(1 + price_class % 4).alias("item1"),
        as_double(1 + (price_class + rid % 2) % 4).alias("item2"),
        as_double(1 + (price_class + 2 * (rid % 2)) % 4).alias("item3"),
        F.when((rid + cl) % 50 != 0, as_double(rid % 60) + 150).alias("age_m"),
    )


# The same table in SQL: CTEs b, n, d. Every oracle starts from it.
ORDER_SQL = """
b AS (SELECT o.o_orderkey rid, c.c_mktsegment strata, o.o_custkey cluster, o.o_orderstatus st,
             o.o_totalprice tp, o.o_orderpriority pr
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
n AS (SELECT strata, count(DISTINCT cluster) npsu FROM b GROUP BY strata),
d AS (SELECT b.rid, b.strata, b.cluster, CAST(1 + b.rid % 5 AS DOUBLE) w,
             CAST(2 * n.npsu AS DOUBLE) fpc,
             CASE WHEN st = 'F' THEN '1' ELSE '0' END female,
             CASE WHEN pr LIKE '1%' OR pr LIKE '2%' THEN 'A' WHEN pr LIKE '3%' THEN 'B' ELSE 'C' END grp3,
             CASE WHEN b.rid % 10 = 3 THEN '0' ELSE '1' END use_flag,
             tp / 100000.0 y,
             CASE WHEN b.rid % 10 = 3 THEN NULL ELSE CAST(b.rid % 7 AS DOUBLE) END spend,
             CAST(1 + floor(tp) % 5 AS DOUBLE) happy,
             CAST((b.rid * 3 + b.cluster) % 8 AS DOUBLE) cnt,
             CASE WHEN (b.rid * 7 + b.cluster) % 3 = 0 THEN 1 ELSE 0 END sad,
             CAST(1 + floor(tp / 1000) % 4 AS DOUBLE) item1,
             CAST(1 + (floor(tp / 1000) + (b.rid % 2)) % 4 AS DOUBLE) item2,
             CAST(1 + (floor(tp / 1000) + 2 * (b.rid % 2)) % 4 AS DOUBLE) item3,
             CASE WHEN (b.rid + b.cluster) % 50 = 0 THEN NULL
                  ELSE CAST(b.rid % 60 AS DOUBLE) + 150 END age_m
      FROM b JOIN n ON b.strata = n.strata),
h AS (SELECT strata, npsu n_h, 0.5 f_h FROM n)
"""


def with_orders(sql: str) -> str:
    return f"WITH {ORDER_SQL}, {sql}" if not sql.lstrip().upper().startswith("SELECT") else f"WITH {ORDER_SQL} {sql}"


def tv_sql(psu: str, t: str = "t", keys: str = "", u: str | None = None, fpc: bool = True) -> str:
    """SQL: covariance of totals from a PSU-level relation with columns strata, cluster, keys, t."""
    u = u or t
    f = "f_h" if fpc else "0.0"
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}sum((1 - {f}) * n_h / (n_h - 1) * (q - s1 * s2 / n_h)) v
      FROM (SELECT strata, {k}sum({t}) s1, sum({u}) s2, sum({t} * {u}) q FROM {psu} GROUP BY {k}strata) x
      JOIN h USING (strata) {group}"""


def tq_sql(df: str) -> str:
    """97.5 % t quantile by its expansion around the normal quantile (large df)."""
    z = 1.959963984540054
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    return f"({z} + {g1} / {df} + {g2} / power({df}, 2) + {g3} / power({df}, 3) + {g4} / power({df}, 4))"


DF_SQL = "(SELECT CAST(sum(n_h) - count(*) AS DOUBLE) FROM h)"


@lru_cache(maxsize=64)
def order_design(spark: SparkSession, sf: str, fpc: bool = True) -> Design:
    return Design.of(order_rows(spark, sf), "cluster", "strata", "w", "fpc" if fpc else None,
                     validate=False)


@lru_cache(maxsize=64)
def line_rows(spark: SparkSession, sf: str, strata: str = "n_regionkey") -> DataFrame:
    """One row per order line; PSU = supplier, strata = region or nation of the supplier."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag")
    place = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select("s_suppkey", F.col(strata).alias("strata"))
    rows = line.join(place, F.col("l_suppkey") == F.col("s_suppkey"))
    sizes = rows.select("strata", "l_suppkey").distinct().groupBy("strata").agg(F.count(F.lit(1)).alias("npsu"))
    rows = lookup_join(rows, sizes, ["strata"], "inner")
    return rows.select(
        "strata", F.col("l_suppkey").alias("cluster"),
        (1 + F.col("l_orderkey") % 5).cast("double").alias("w"),
        (2 * F.col("npsu")).cast("double").alias("fpc"),
        F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"),
    )


def line_sql(strata: str = "n_regionkey") -> str:
    return f"""WITH b AS (SELECT {strata} strata, l_suppkey cluster, CAST(1 + l_orderkey % 5 AS DOUBLE) w,
             l_quantity qty, l_returnflag flag
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
h AS (SELECT strata, count(DISTINCT cluster) n_h, 0.5 f_h FROM b GROUP BY strata),
d AS (SELECT b.*, 2.0 * n_h fpc FROM b JOIN h USING (strata))"""


@lru_cache(maxsize=64)
def line_design(spark: SparkSession, sf: str, fpc: bool = True, strata: str = "n_regionkey",
                lonely: str = "fail") -> Design:
    return Design.of(line_rows(spark, sf, strata), "cluster", "strata", "w",
                     "fpc" if fpc else None, lonely=lonely, validate=False)
