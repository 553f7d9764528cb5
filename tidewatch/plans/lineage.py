"""Walks over what alerts were made of, and provenance kept through a roll-up, on the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions import periods
from tidewatch.operators import lineage, statements
from tidewatch.plans import query, table

_KEYS = ["corp_code", "period_key", "fs_div", "std_code"]


def _lines(spark, sf_dir):
    """Orders as lines of what a nation's segment reports: two accounts by priority, amounts in cents."""
    c = F.col
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), c("o_custkey") == c("c_custkey"))
    return o.select(
        F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("corp_code"), F.concat(F.year("o_orderdate"), F.lit("Q"), F.quarter("o_orderdate")).alias("quarter"), F.lit("CFS").alias("fs_div"),
        F.when(c("o_orderpriority") < "3", "OP").otherwise("DEBT").alias("std_code"), F.lit(1).alias("map_id"), F.lit("IS").alias("sj_div"), c("o_orderkey").alias("line_no"), F.round(c("o_totalprice") * 100).cast("decimal(24,0)").alias("value"),
    )


def _statements(spark, sf_dir):
    """(statements, lines): year-to-date rows of the quarters that have lines, quarters as their differences, and the lines of each year to date."""
    own = _lines(spark, sf_dir)
    there = own.select("corp_code", F.col("quarter").alias("period_key"), "fs_div", "std_code").distinct()
    same = (F.substring("period_key", 1, 4) == F.substring("quarter", 1, 4)) & (F.col("quarter") <= F.col("period_key"))
    # at most four quarters take a line up
    later = F.explode(F.transform(F.sequence(F.substring("quarter", 6, 1).cast("int"), F.lit(4)), lambda q: F.concat(F.substring("quarter", 1, 5), q.cast("string"))))
    lines = own.withColumn("period_key", later).join(there, _KEYS).where(same).drop("quarter")
    cum = lines.groupBy(*_KEYS).agg(F.sum("value").cast("decimal(24,0)").alias("amount"))
    qtr = statements.decumulate(cum.withColumn("_q", periods.quarter_ordinal(F.col("period_key"))), ["corp_code", "fs_div", "std_code"], "_q", "amount", "_v")
    qtr = qtr.select(*_KEYS, F.lit("QTR").alias("basis"), F.col("_v").cast("decimal(24,0)").alias("amount"))
    return cum.select(*_KEYS, F.lit("CUM").alias("basis"), "amount").unionByName(qtr), lines


_BASE = """
WITH l AS (SELECT c_nationkey || '-' || c_mktsegment AS corp, year(o_orderdate) AS y, quarter(o_orderdate) AS q, CASE WHEN o_orderpriority < '3' THEN 'OP' ELSE 'DEBT' END AS std, CAST(round(o_totalprice * 100) AS BIGINT) AS v
           FROM orders JOIN customer ON o_custkey = c_custkey),
t AS (SELECT corp, y, q, std, sum(v) AS v, count(*) AS n FROM l GROUP BY ALL),
cum AS (SELECT corp, y, q, std, CAST(sum(v) OVER w AS BIGINT) AS a, CAST(sum(n) OVER w AS BIGINT) AS n, lag(q) OVER w AS bq FROM t WINDOW w AS (PARTITION BY corp, y, std ORDER BY q)),
qtr AS (SELECT c.corp, c.y, c.q, c.std, CASE WHEN c.q = 1 THEN c.a ELSE c.a - b.a END AS a, c.n + coalesce(b.n, 0) AS n_lines, CASE WHEN c.q = 1 THEN 1 ELSE 2 END AS n_cum
        FROM cum c LEFT JOIN cum b ON b.corp = c.corp AND b.y = c.y AND b.std = c.std AND b.q = c.q - 1 WHERE c.q = 1 OR b.q IS NOT NULL)
"""


@query(_BASE + """,
cover AS (SELECT o.corp, o.y, o.q, o.a AS num, d.a AS den, o.n_lines + d.n_lines AS n_lines, o.n_cum + d.n_cum AS n_cum FROM qtr o JOIN qtr d USING (corp, y, q) WHERE o.std = 'OP' AND d.std = 'DEBT' AND d.a > 0),
hit AS (SELECT a.corp, a.y, a.q, a.n_lines + b.n_lines AS n_lines, a.n_cum + b.n_cum AS n_cum FROM cover a JOIN cover b ON b.corp = a.corp AND b.q = a.q AND b.y = a.y - 1 WHERE CAST(a.num AS HUGEINT) * b.den >= 2 * CAST(b.num AS HUGEINT) * a.den)
SELECT corp || ' ' || y || 'Q' || q AS alert, k.kind, CAST(k.n AS BIGINT) AS n, k.depth FROM hit, LATERAL (VALUES ('ALERT', 1, 0), ('METRIC', 3, 2), ('STATEMENT', 4 + n_cum, 4), ('LINE', n_lines, 5)) AS k(kind, n, depth)
""")  # fmt: skip
def lineage_walk(spark, sf_dir):
    """From alerts of a ratio that doubled in a year to metrics, quarters, years to date and lines: nodes of each kind and the greatest depth."""
    c = F.col
    s, lines = _statements(spark, sf_dir)
    q = s.where("basis = 'QTR'").groupBy("corp_code", "period_key").agg(*[F.max(F.when(c("std_code") == x, c("amount"))).alias(x) for x in ("OP", "DEBT")]).where("OP IS NOT NULL AND DEBT > 0")
    ago = Window.partitionBy("corp_code").orderBy("_q").rangeBetween(-4, -4)
    q = q.withColumn("_q", periods.quarter_ordinal(c("period_key"))).withColumns({"_op": F.first("OP").over(ago), "_debt": F.first("DEBT").over(ago)})
    hits = q.where(c("OP").cast("decimal(38,0)") * c("_debt") >= 2 * c("_op").cast("decimal(38,0)") * c("DEBT"))
    alert = F.concat_ws(" ", "corp_code", "period_key")
    seen = hits.select(alert.alias("alert_id"), F.lit("R-1").alias("rule_code"), F.lit("COMPANY").alias("target_type"), F.col("corp_code").alias("target"), F.col("period_key").alias("period"), F.lit(None).cast("string").alias("rcept_no"))
    rules = spark.range(1).select(F.lit("R-1").alias("rule_code"), F.lit("COVER_YOY").alias("metric_code"))
    leg = lambda name, x: q.select("corp_code", "period_key", F.lit("COVER").alias("metric_code"), F.lit(name).alias("leg"), F.lit("CFS").alias("fs_div"), F.lit(x).alias("std_code"), F.lit("QTR").alias("basis"), c(x).alias("amount"))
    legs = leg("numerator", "OP").unionByName(leg("denominator", "DEBT"))
    changes = hits.select("corp_code", "period_key", F.lit("COVER_YOY").alias("metric_code"))
    edges = lineage.alert_edges(seen, rules).unionByName(lineage.metric_edges(legs, s, changes)).unionByName(lineage.statement_edges(s, lines))
    found = lineage.walk(hits.select(alert.alias("root"), lineage.node("ALERT", alert).alias("node")), edges)
    return found.groupBy(c("root").alias("alert"), F.split_part("node", F.lit("|"), F.lit(1)).alias("kind")).agg(F.count("*").alias("n"), F.max("depth").alias("depth"))


@query(_BASE + """,
stored AS (SELECT corp, y, q, std, 'CUM' AS basis, a + CASE WHEN (y * 4 + q) % 7 = 0 THEN 1 ELSE 0 END AS amount, a AS expected, n AS n_lines, (y * 4 + q) % 7 <> 0 AS ok FROM cum),
quarters AS (SELECT x.corp, x.y, x.q, x.std, 'QTR' AS basis, x.a AS amount, c.amount - coalesce(b.amount, 0) AS expected, CAST(0 AS BIGINT) AS n_lines, c.ok AND coalesce(b.ok, true) AND c.amount - coalesce(b.amount, 0) = x.a AS ok
  FROM qtr x JOIN stored c USING (corp, y, q, std) LEFT JOIN stored b ON b.corp = x.corp AND b.y = x.y AND b.std = x.std AND b.q = x.q - 1)
SELECT corp, y || 'Q' || q AS period_key, std, basis, CAST(amount AS BIGINT) AS amount, CAST(expected AS BIGINT) AS expected, n_lines, ok AS reproduced FROM (SELECT * FROM stored UNION ALL SELECT * FROM quarters)
""")  # fmt: skip
def lineage_statements(spark, sf_dir):
    """Whether lines and years to date give the stored statements again, some of which were changed since."""
    s, lines = _statements(spark, sf_dir)
    late = (F.col("basis") == "CUM") & (F.pmod(periods.quarter_ordinal(F.col("period_key")) + 1, F.lit(7)) == 0)
    s = s.withColumn("amount", (F.col("amount") + F.when(late, 1).otherwise(0)).cast("decimal(24,0)"))
    r = lineage.reproduced(s, lines)
    return r.select(F.col("corp_code").alias("corp"), "period_key", F.col("std_code").alias("std"), "basis", F.col("amount").cast("long").alias("amount"), F.col("expected").cast("long").alias("expected"), F.col("n_lines").cast("long").alias("n_lines"), "reproduced")


def _stats(spark, sf_dir):
    """(stats, regions): monthly orders of nations and, in odd months, of regions themselves; customers as households of a year."""
    c = F.col
    n = table(spark, sf_dir, "nation")
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), c("o_custkey") == c("c_custkey")).withColumn("m", F.date_format("o_orderdate", "yyyyMM"))
    cents = F.round(c("o_totalprice") * 100).cast("long")
    nation = F.concat(F.lit("N"), c("c_nationkey")).alias("region")
    of_nations = o.groupBy(nation, c("m").alias("period")).agg(F.count("*").alias("UNSOLD"), F.max(cents).alias("SALE_IDX"))
    of_regions = o.join(n, c("c_nationkey") == c("n_nationkey")).where("substring(m, 6, 1) IN ('1', '3', '5', '7', '9')").groupBy(F.concat(F.lit("R"), c("n_regionkey")).alias("region"), c("m").alias("period")).agg(F.count("*").alias("UNSOLD"))
    homes = table(spark, sf_dir, "customer").groupBy(nation).agg(F.count("*").alias("value")).withColumn("period", F.explode(F.array(F.lit("1996"), F.lit("1999")))).withColumn("stat", F.lit(lineage.HOUSEHOLDS))
    stats = of_nations.unionByName(of_regions, allowMissingColumns=True).unpivot(["region", "period"], ["UNSOLD", "SALE_IDX"], "stat", "value").where("value IS NOT NULL").unionByName(homes)
    regions = n.select(F.concat(F.lit("N"), "n_nationkey").alias("region_cd"), F.concat(F.lit("R"), "n_regionkey").alias("parent_cd"))
    return stats, regions.unionByName(regions.select(c("parent_cd").alias("region_cd"), F.lit(None).cast("string").alias("parent_cd")).distinct())


_REGIONS = """
WITH o AS (SELECT 'N' || c_nationkey AS nation, 'R' || n_regionkey AS top, strftime(o_orderdate, '%Y%m') AS m, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
n AS (SELECT nation, top, m, count(*) AS k, max(v) AS v FROM o GROUP BY ALL),
r AS (SELECT top, m, count(*) AS k FROM o WHERE CAST(m AS INTEGER) % 2 = 1 GROUP BY ALL)
"""


@query(_REGIONS + """
SELECT 'UNSOLD' AS stat, nation AS region, m AS period, 'OWN' AS role, CAST(k AS DOUBLE) AS value, CAST(1 AS BIGINT) AS n_sources, CAST(k AS BIGINT) AS of_sources, nation AS first_source FROM n
UNION ALL SELECT 'SALE_IDX', nation, m, 'OWN', v, 1, v, nation FROM n
UNION ALL SELECT 'UNSOLD', top, m, 'OWN', k, 1, k, top FROM r
UNION ALL SELECT 'UNSOLD', top, m, 'CHILD', sum(k), count(*), CAST(sum(k) AS BIGINT), min(nation) FROM n WHERE CAST(m AS INTEGER) % 2 = 0 GROUP BY top, m
UNION ALL SELECT 'SALE_IDX', top, m, 'CHILD', CAST(sum(v) AS DOUBLE) / count(*), count(*), CAST(sum(v) AS BIGINT), min(nation) FROM n GROUP BY top, m
""")
def region_provenance(spark, sf_dir):
    """Values of nations and regions with the rows behind them: sums, means, and regions' own rows where there are any."""
    stats, regions = _stats(spark, sf_dir)
    r = lineage.rolled_up(stats.where(F.col("stat") != lineage.HOUSEHOLDS), regions, ["SALE_IDX"])
    total = F.aggregate("sources", F.lit(0).cast("long"), lambda a, x: a + x["value"])
    return r.select("stat", "region", "period", "role", F.col("value").cast("double").alias("value"), F.size("sources").cast("long").alias("n_sources"), total.alias("of_sources"), F.array_min(F.col("sources.source")).alias("first_source"))


@query(_REGIONS + """,
months AS (SELECT DISTINCT top, m FROM n),
shifted AS (SELECT top, m, strftime(strptime(m, '%Y%m') - INTERVAL 3 MONTH, '%Y%m') AS ago, substr(m, 1, 4) AS y FROM months),
behind AS (SELECT top, m, CASE WHEN CAST(m AS INTEGER) % 2 = 1 THEN 1 ELSE 0 END AS own, CASE WHEN CAST(m AS INTEGER) % 2 = 1 THEN 0 ELSE count(*) END AS child, count(*) AS nations FROM n GROUP BY top, m),
homes AS (SELECT n_regionkey, count(DISTINCT c_nationkey) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT s.top AS region, s.m AS period, x.metric_code, CAST(x.own AS BIGINT) AS own, CAST(x.child AS BIGINT) AS child FROM shifted s JOIN behind b ON b.top = s.top AND b.m = s.m LEFT JOIN behind a ON a.top = s.top AND a.m = s.ago LEFT JOIN homes h ON s.top = 'R' || h.n_regionkey,
LATERAL (VALUES ('UNSOLD_UNITS', b.own, b.child), ('UNSOLD_3M_CHG', b.own + coalesce(a.own, 0), b.child + coalesce(a.child, 0)), ('UNSOLD_PER_1K_HH', b.own, b.child + CASE WHEN s.y >= '1996' THEN h.k ELSE 0 END), ('PRICE_IDX_3M_CHG', 0, b.nations + coalesce(a.nations, 0))) AS x(metric_code, own, child)
""")  # fmt: skip
def region_lineage(spark, sf_dir):
    """How many rows of regions themselves and of their nations each metric of a region and month was made of."""
    stats, regions = _stats(spark, sf_dir)
    codes = F.explode(F.array(*map(F.lit, ("UNSOLD_UNITS", "UNSOLD_3M_CHG", "UNSOLD_PER_1K_HH", "PRICE_IDX_3M_CHG"))))
    months = lineage.sources(stats.where("stat = 'SALE_IDX'"), regions).where("region LIKE 'R%'").select("region", "period").distinct()
    edges = lineage.region_edges(months.withColumn("metric_code", codes), stats, regions)
    part = lambda i: F.split_part("parent", F.lit("|"), F.lit(i))
    return edges.groupBy(part(3).alias("region"), part(4).alias("period"), part(5).alias("metric_code")).agg(F.count_if(F.col("role") == "OWN").alias("own"), F.count_if(F.col("role") == "CHILD").alias("child"))
