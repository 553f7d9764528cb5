"""The domain's operators on the test tables: rules, lifecycles, shares, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import filings, lifecycle, ordered, regions, rules
from tidewatch.plans import query, table
from tidewatch.plans.aggregates import _nation_months, _orders


def _share(spark, sf_dir, unknown_stays):
    o = _orders(spark, sf_dir).select(F.col("o_custkey").alias("entity"), F.when(F.col("o_orderkey") % 13 != 0, F.col("c_nationkey") + F.col("o_orderkey") % 25).alias("region"), F.round(F.col("o_totalprice") * 100).cast("long").alias("amount"))
    latest = table(spark, sf_dir, "nation").where("n_nationkey % 4 != 0").select(F.col("n_nationkey").cast("long").alias("region"), F.col("n_nationkey").alias("value"))
    return regions.risk_share(o.withColumn("region", F.col("region").cast("long")), latest, 12, unknown_stays).select("entity", "n", "total", "risky", "n_risky", "excluded", F.col("share").cast("double").alias("share"))


_SHARE = """
WITH o AS (SELECT o_custkey AS entity, c_nationkey + o_orderkey % 25 AS region, CAST(round(o_totalprice * 100) AS BIGINT) AS amount
           FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 13 <> 0),
v AS (SELECT n_nationkey AS region, n_nationkey AS value FROM nation WHERE n_nationkey % 4 <> 0),
j AS (SELECT o.*, value, {counts} AS counts FROM o LEFT JOIN v USING (region)),
g AS (SELECT entity, count(*) FILTER (WHERE counts) AS n, CAST(sum(amount) FILTER (WHERE counts) AS BIGINT) AS total, CAST(coalesce(sum(amount) FILTER (WHERE value >= 12), 0) AS BIGINT) AS risky,
      count(*) FILTER (WHERE value >= 12) AS n_risky, count(*) FILTER (WHERE NOT counts) AS excluded FROM j GROUP BY 1)
SELECT *, CASE WHEN total > 0 THEN (CAST(risky AS HUGEINT) * 20000 + total) // (CAST(total AS HUGEINT) * 2) / 100.0 END AS share FROM g
"""


@query(_SHARE.format(counts="true"))
def risk_share_contracts(spark, sf_dir):
    """Share of amounts in risky regions; those without a value stay in the denominator."""
    return _share(spark, sf_dir, True)


@query(_SHARE.format(counts="value IS NOT NULL"))
def risk_share_presale(spark, sf_dir):
    """Share of amounts in risky regions; those without a value leave the denominator and are counted."""
    return _share(spark, sf_dir, False)


@query("""
WITH s AS (SELECT o_orderkey % 7 AS r, o_custkey AS t, o_orderkey AS a FROM orders),
active AS (SELECT 'R' || r AS rule_code, CAST(CASE WHEN a % 5 = 0 THEN 1 ELSE 2 END AS INTEGER) AS rule_version, t AS target, a AS as_of FROM s WHERE a % 2 = 0),
fired AS (SELECT 'R' || r AS rule_code, t AS target, a AS as_of FROM s WHERE a % 3 = 0),
o AS (SELECT DISTINCT 'R' || r AS rule_code, t AS target, r < 4 AS single_active, r <> 2 AS decided FROM s),
l AS (SELECT rule_code, target, max(as_of) AS latest FROM fired GROUP BY 1, 2),
c AS (SELECT ac.*, o.single_active, o.decided, f.as_of IS NOT NULL AS hit, CASE WHEN single_active THEN latest END AS open_as_of
      FROM active ac JOIN o USING (rule_code, target) LEFT JOIN fired f USING (rule_code, target, as_of) LEFT JOIN l USING (rule_code, target)),
closes AS (SELECT rule_code, rule_version, target, as_of, 'CLOSE' AS action,
   CASE WHEN rule_version <> 2 THEN 'RULE_CHANGED' WHEN single_active AND NOT decided THEN NULL
        WHEN NOT hit THEN CASE WHEN single_active OR as_of % 4 = 0 THEN 'RESOLVED' ELSE 'EXPIRED' END
        WHEN single_active AND as_of <> open_as_of THEN 'SUPERSEDED' END AS close_reason FROM c),
ups AS (SELECT f.rule_code, CAST(2 AS INTEGER) AS rule_version, f.target, f.as_of, CASE WHEN NOT single_active OR f.as_of = latest THEN 'OPEN' ELSE 'STORE_CLOSED' END AS action,
        CASE WHEN single_active AND f.as_of <> latest THEN 'SUPERSEDED' END AS close_reason
        FROM fired f JOIN o USING (rule_code, target) JOIN l USING (rule_code, target) WHERE NOT (single_active AND NOT decided))
SELECT * FROM closes WHERE close_reason IS NOT NULL AND (rule_code, rule_version, target, as_of) NOT IN (SELECT (rule_code, rule_version, target, as_of) FROM ups WHERE action = 'STORE_CLOSED')
UNION ALL SELECT * FROM ups
""")
def lifecycle_diff(spark, sf_dir):
    """What opens and closes between active alerts and findings, for rules of both kinds, undecided ones among them."""
    s = table(spark, sf_dir, "orders").select(F.concat(F.lit("R"), F.col("o_orderkey") % 7).alias("rule_code"), F.col("o_custkey").alias("target"), F.col("o_orderkey").alias("as_of"))
    active = s.where("as_of % 2 = 0").withColumn("rule_version", F.expr("if(as_of % 5 = 0, 1, 2)"))
    fired = s.where("as_of % 3 = 0")
    outcome = s.groupBy("rule_code", "target").agg(F.lit(2).alias("version"), (F.col("rule_code") < "R4").alias("single_active"), (F.col("rule_code") != "R2").alias("decided"), F.max(F.when(F.col("as_of") % 3 == 0, F.col("as_of"))).alias("latest_as_of"), F.collect_set(F.when(F.col("as_of") % 4 == 0, F.col("as_of"))).alias("evaluated"))
    return lifecycle.plan(active, fired, outcome)


@query("""
WITH o AS (SELECT c_nationkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS m, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
y AS (SELECT a.c_nationkey, a.m, a.n, CASE WHEN b.n IS NOT NULL THEN round((a.n - b.n) * 100.0 / b.n, 4) END AS yoy, b.n AS base, CASE WHEN c.n IS NOT NULL THEN (a.n - c.n) * 100.0 / c.n END AS chg
      FROM o a LEFT JOIN o b ON b.c_nationkey = a.c_nationkey AND b.m = a.m - 12 LEFT JOIN o c ON c.c_nationkey = a.c_nationkey AND c.m = a.m - 3)
SELECT 'R-R03' AS rule_code, CAST(c_nationkey AS VARCHAR) AS target, CAST(m // 12 * 100 + m % 12 + 1 AS VARCHAR) AS as_of,
       (CASE WHEN base < 2 THEN false WHEN base IS NOT NULL THEN true END) AND yoy <= -10 AND chg >= -5 AS verdict FROM y
""")
def trade_cliff_rule(spark, sf_dir):
    """The rule of falling trades over rising unsold stock, on months of orders standing for both."""
    from tidewatch.functions import periods, status

    m = _nation_months(spark, sf_dir).select(F.col("c_nationkey").cast("string").alias("target"), F.col("month_no"), F.col("n").cast("decimal(24,4)").alias("n"))
    m = ordered.shifted(ordered.shifted(m, ["target"], "month_no", "n", 12, "a"), ["target"], "month_no", "n", 3, "b")
    m = m.withColumn("period", periods.month_of_ordinal(F.col("month_no")))
    value = lambda x: status.valued(x, F.when(x.isNull(), "MISSING").otherwise("OK"))
    parts = {"TRADE_COUNT": value(F.col("n")), "TRADE_YOY": status.pct_change(F.col("n"), F.col("a")), "UNSOLD_3M_CHG": status.pct_change(F.col("n"), F.col("b"))}
    long = m.select("target", "period", F.explode(F.array(*[F.struct(F.lit(k).alias("metric_code"), v.alias("m")) for k, v in parts.items()])).alias("x")).select("target", "period", "x.metric_code", "x.m.*")
    rule = next(r for r in rules.RULES if r.code == "R-R03")
    return rules.evaluate(rule, long, {"max_yoy": -10, "min_unsold_chg": -5, "min_base": 2})


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey IN (3, 5) THEN 'MANUAL_EXCLUDE' WHEN s_suppkey IN (4, 6) THEN 'MANUAL_INCLUDE' WHEN s_suppkey % 10 = 0 THEN 'UNLISTED'
       WHEN s_suppkey % 3 = 0 THEN 'CLASS' WHEN s_nationkey % 5 = 4 THEN 'MATCH' ELSE 'INDUSTRY' END AS reason FROM supplier
""")
def universe_policy(spark, sf_dir):
    """Why each company is looked at or not; what is set by hand comes first."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("corp_code"), F.when(F.col("s_suppkey") % 10 != 0, "1").alias("stock_code"), F.when(F.col("s_suppkey") % 3 == 0, "E").otherwise("Y").alias("corp_cls"), F.concat(F.col("s_nationkey") % 5, F.lit("1")).alias("induty_code"))
    return rules.universe(s, include=["4", "6"], exclude=["3", "5"]).select("s_suppkey", "reason")


@query("""
SELECT owner, alert_id, revived FROM (
  SELECT 'all' AS owner, o_orderkey AS alert_id, o_orderkey % 3 = 0 AS revived FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
  UNION ALL SELECT 'some', o_orderkey, o_orderkey % 3 = 0 FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus IN ('F', 'P'))
""")
def inbox_fan_out(spark, sf_dir):
    """Alerts dealt to the inboxes of those who asked for them, once each."""
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("alert_id"), F.when(F.col("o_orderkey") % 3 == 0, "REOPENED").otherwise("NEW").alias("kind"), F.col("o_orderstatus").alias("rule_code"), F.lit("COMPANY").alias("target_type"), F.col("o_custkey").cast("string").alias("target"), F.when(F.col("o_orderpriority") == "1-URGENT", "HIGH").when(F.col("o_orderpriority") == "2-HIGH", "MEDIUM").otherwise("LOW").alias("severity"))
    s = spark.createDataFrame([("all", True, None, None, "MEDIUM", None), ("some", True, "COMPANY", ["F", "P"], "HIGH", None), ("some", True, "COMPANY", ["P"], "HIGH", None), ("none", False, None, None, "LOW", None)], "owner string, enabled boolean, target_type string, rule_codes array<string>, min_severity string, targets array<string>")
    return lifecycle.fan_out(e, s)


@query("""
WITH o AS (SELECT o_orderkey AS r, o_custkey AS c, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS k, o_orderstatus AS p,
                  CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate - INTERVAL 1 day AS DATE) END AS fixes FROM orders),
n AS (SELECT r, CASE WHEN k IS NOT NULL THEN nullif(first_value(r) OVER (PARTITION BY c, k ORDER BY d DESC, r DESC), r) END AS newest FROM o),
x AS (SELECT o.r, max(f.r) AS fix FROM o JOIN o f ON f.c = o.c AND f.fixes = o.d AND f.r > o.r AND (f.k = o.k OR f.p = o.p) GROUP BY 1),
t AS (SELECT o.r, max(t.r) AS terminated_by FROM o JOIN (SELECT * FROM o WHERE r % 5 = 0) t ON t.c = o.c AND t.d >= o.d AND t.k = o.k GROUP BY 1)
SELECT o.r AS rcept_no, coalesce(newest, fix) AS superseded_by, terminated_by FROM o JOIN n USING (r) LEFT JOIN x USING (r) LEFT JOIN t USING (r)
""")
def contract_links(spark, sf_dir):
    """Contracts replaced by later ones, by corrections, or ended by terminations."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rcept_no"), F.col("o_custkey").alias("corp_code"), F.col("o_orderdate").cast("date").alias("rcept_dt"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("name_key"), F.col("o_orderstatus").alias("counterparty"), F.lit(None).cast("long").alias("amount"))
    c = o.withColumn("corrects_date", F.when(F.col("rcept_no") % 2 == 0, F.date_sub("rcept_dt", 1)))
    t = o.where("rcept_no % 5 = 0").withColumn("contract_date", F.lit(None).cast("date"))
    return filings.link_contracts(c, t).select("rcept_no", "superseded_by", "terminated_by")

