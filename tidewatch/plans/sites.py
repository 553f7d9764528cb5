"""Site markets on the test tables: nations as districts, market segments as quarters, orders as trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import sites, spatial
from tidewatch.plans import query, table


@query("""
WITH t AS (SELECT c_nationkey AS lawd_cd, c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' ' || c_custkey % 3 END AS umd_nm, year(o_orderdate) * 12 + month(o_orderdate) AS m,
                  o_totalprice / (1 + o_orderkey % 90) AS m2, o_orderstatus = 'P' AS off FROM orders JOIN customer ON o_custkey = c_custkey),
a AS (SELECT lawd_cd, max(m) AS m FROM t WHERE lawd_cd % 2 = 0 OR m < 1996 * 12 GROUP BY 1),
s AS (SELECT n_nationkey AS lawd_cd, unnest(['BUILDING', 'MACHINERY 1']) AS umd FROM nation),
j AS (SELECT s.lawd_cd, umd, a.m AS ym, t.m >= a.m - 11 AS now, off, m2 FROM s JOIN a USING (lawd_cd) JOIN t ON t.lawd_cd = s.lawd_cd AND t.m BETWEEN a.m - 23 AND a.m AND (umd_nm = umd OR umd_nm LIKE umd || ' %')),
g AS (SELECT lawd_cd, umd, ym, count(*) FILTER (NOT off AND now) AS trades_12m, count(*) FILTER (NOT off AND NOT now) AS trades_before, count(*) FILTER (off AND now) AS cancels_12m,
             quantile_cont(m2, 0.5) FILTER (NOT off AND now) AS a, quantile_cont(m2, 0.5) FILTER (NOT off AND NOT now) AS b FROM j GROUP BY 1, 2, 3)
SELECT lawd_cd, umd, trades_12m, trades_before, cancels_12m, round(a, 1) AS m2, round(b, 1) AS m2_before,
       CASE WHEN trades_before > 0 THEN round((trades_12m - trades_before) * 100 / trades_before, 1) END AS trades_change,
       CASE WHEN round(b, 1) <> 0 THEN round((round(a, 1) - round(b, 1)) * 100 / round(b, 1), 1) END AS m2_change,
       CASE WHEN trades_12m + cancels_12m > 0 THEN round(cancels_12m * 100 / (trades_12m + cancels_12m), 1) END AS cancel_rate FROM g
""")
def site_markets(spark, sf_dir):
    """The last twelve months around each site against the twelve before."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    quarter = F.concat("c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit(" "), (F.col("c_custkey") % 3).cast("string"))))
    ym = F.year("o_orderdate") * 100 + F.month("o_orderdate")
    t = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_nationkey").alias("lawd_cd"), quarter.alias("umd_nm"), ym.alias("deal_ym"), F.col("o_totalprice").alias("deal_amount"),
        (1 + F.col("o_orderkey") % 90).alias("exclu_use_ar"), (F.col("o_orderstatus") == "P").alias("cancelled"),
    )
    anchors = t.where("lawd_cd % 2 = 0 OR deal_ym < 199512").groupBy(F.col("lawd_cd").alias("region_cd")).agg(F.max("deal_ym").alias("ym"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("region_cd"), F.col("n_nationkey").alias("lawd_cd"), F.explode(F.array(F.lit("BUILDING"), F.lit("MACHINERY 1"))).alias("umd"))
    return sites.markets(n, anchors, t).drop("region_cd", "ym")


_SHAPES = """
WITH n AS (SELECT n_nationkey AS k, -500.0 + (n_nationkey % 5) * 2200 AS cx, 500.0 + (n_nationkey // 5) * 2000 AS cy FROM nation),
e AS (SELECT k, cx - 900 AS x, cy - 700 AS y, cx + 1300 AS x2, cy - 200 AS y2 FROM n UNION ALL SELECT k, cx + 1300, cy - 200, cx, cy + 950 FROM n UNION ALL SELECT k, cx, cy + 950, cx - 900, cy - 700 FROM n
  UNION ALL SELECT k, cx + a, cy + b, cx + c, cy + d FROM n, (VALUES (-200, -200, 200, -200), (200, -200, 200, 200), (200, 200, -200, 200), (-200, 200, -200, -200)) AS v(a, b, c, d) WHERE k % 3 = 0),
p AS (SELECT c_custkey, c_acctbal AS px, CAST(c_custkey * 37 % 10007 AS DOUBLE) AS py FROM customer)
"""


@query(_SHAPES + """
SELECT c_custkey, k AS nation FROM p JOIN e ON least(y, y2) <= py AND py < greatest(y, y2) AND px < x + (py - y) * (x2 - x) / (y2 - y) GROUP BY 1, 2 HAVING count(*) % 2 = 1
""")
def places_in_regions(spark, sf_dir):
    """Customers placed on a map and the regions, some with a hole, that they lie in."""
    c = F.col
    n = table(spark, sf_dir, "nation").select(c("n_nationkey").alias("region"), (c("n_nationkey") % 5 * 2200 - 500.0).alias("cx"), (F.floor(c("n_nationkey") / 5) * 2000 + 500.0).alias("cy"))
    ring = lambda *corners: F.array(*[F.struct((c("cx") + x).alias("x"), (c("cy") + y).alias("y")) for x, y in corners])
    outline, hole = ring((-900, -700), (1300, -200), (0, 950)), ring((-200, -200), (200, -200), (200, 200), (-200, 200))
    shapes = n.select("region", F.when(c("region") % 3 == 0, F.array(outline, hole)).otherwise(F.array(outline)).alias("rings"))
    points = table(spark, sf_dir, "customer").select("c_custkey", c("c_acctbal").alias("x"), (c("c_custkey") * 37 % 10007).cast("double").alias("y"))
    return spatial.located(points, shapes, 500.0).select("c_custkey", c("region").alias("nation"))
