"""Alert rules and snapshots on the test tables: customers' order sums stand for metrics, orders for filings and alerts."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tidewatch.operators import lifecycle, rules
from tidewatch.plans import query, table

_V = "CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS v"
_QUARTERS = f"""
g AS (SELECT o_custkey % 60 AS target, year(o_orderdate) * 4 + quarter(o_orderdate) AS n, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS as_of, {_V} FROM orders GROUP BY ALL),
m AS (SELECT target, n, as_of, CASE WHEN v % 11 <> 0 THEN v % 600 END AS dr, v % 97 AS yoy, CASE WHEN v % 7 <> 0 THEN v % 3 END AS ic, CASE WHEN v % 13 <> 0 THEN v % 4 - 2 END AS ocf FROM g),
e AS (SELECT 'R-C01' AS rule_code, target, as_of, dr > 300 AND yoy > 50 AS verdict FROM m
      UNION ALL SELECT 'R-C02', a.target, a.as_of, a.ic < 1 AND b.ic < 1 FROM m a LEFT JOIN m b ON b.target = a.target AND b.n = a.n - 1
      UNION ALL SELECT 'R-C03', a.target, a.as_of, a.ocf < 0 AND b.ocf < 0 AND c.ocf < 0 FROM m a LEFT JOIN m b ON b.target = a.target AND b.n = a.n - 1 LEFT JOIN m c ON c.target = a.target AND c.n = a.n - 2)
"""


def _sums(spark, sf_dir, period):
    o = table(spark, sf_dir, "orders")
    return o.groupBy((F.col("o_custkey") % 60).alias("target"), period.alias("period")).agg(F.sum(F.round("o_totalprice").cast("long")).alias("v"), F.count("*").alias("n"))


def _metrics(sums, series):
    """Rows of metrics from (code, value, whether it is known, whether there is a row) as SQL over v and n."""
    rows = [F.struct(F.lit(code).alias("metric_code"), F.expr(f"CASE WHEN {known} THEN CAST({value} AS DOUBLE) END").alias("value"), F.expr(f"CASE WHEN {known} THEN 'OK' ELSE 'MISSING' END").alias("status"), F.expr(there).alias("there")) for code, value, known, there in series]
    return sums.select("target", "period", F.explode(F.array(*rows)).alias("m")).where("m.there").select("target", "period", "m.metric_code", "m.value", "m.status")


def _quarterly(spark, sf_dir):
    period = F.concat(F.year("o_orderdate"), F.lit("Q"), F.quarter("o_orderdate"))
    series = [("DEBT_RATIO", "v % 600", "v % 11 != 0", "true"), ("DEBT_RATIO_YOY", "v % 97", "true", "true"), ("INTEREST_COVERAGE", "v % 3", "v % 7 != 0", "true"), ("OCF_QTR", "v % 4 - 2", "true", "v % 13 != 0")]
    metrics = _metrics(_sums(spark, sf_dir, period), series)
    out = None
    for r in rules.RULES:
        if not r.monthly:
            found = rules.evaluate(r, metrics)
            out = found if out is None else out.unionByName(found)
    return out


@query(f"WITH {_QUARTERS} SELECT * FROM e")
def company_rules(spark, sf_dir):
    """Rules over quarters: debt, interest covered twice running too little, cash flow negative three times running."""
    return _quarterly(spark, sf_dir)


@query(f"""
WITH {_QUARTERS}
SELECT rule_code, target, max(CASE WHEN verdict IS NOT NULL THEN as_of END) AS latest_as_of, bool_or(verdict IS NOT NULL) AS decided,
       coalesce(string_agg(CASE WHEN verdict THEN as_of END, ',' ORDER BY as_of), '') AS findings, count(verdict) AS n_evaluated FROM e GROUP BY 1, 2
""")
def rule_summary(spark, sf_dir):
    """What each rule found for each target, and up to when it is decided."""
    s = rules.summary(_quarterly(spark, sf_dir))
    return s.select("rule_code", "target", "latest_as_of", "decided", F.array_join("findings", ",").alias("findings"), F.size("evaluated").cast("long").alias("n_evaluated"))


@query(f"""
WITH g AS (SELECT o_custkey % 60 AS target, year(o_orderdate) * 12 + month(o_orderdate) AS n, strftime(o_orderdate, '%Y%m') AS as_of, count(*) * 20 AS trades, {_V} FROM orders GROUP BY 1, 2, 3),
m AS (SELECT *, v % 300 AS units, CASE WHEN v % 9 <> 0 THEN v % 120 - 10 END AS chg, v % 5 AS per, CASE WHEN v % 8 <> 0 THEN v % 3 - 2 END AS price, v % 150 - 100 AS yoy FROM g)
SELECT 'R-R01' AS rule_code, target, as_of, units >= 100 AND chg > 50 AND per > 2 AS verdict FROM m
UNION ALL SELECT 'R-R02', a.target, a.as_of, a.price < 0 AND b.price < 0 AND c.price < 0 AND a.chg > 0 FROM m a LEFT JOIN m b ON b.target = a.target AND b.n = a.n - 1 LEFT JOIN m c ON c.target = a.target AND c.n = a.n - 2
UNION ALL SELECT 'R-R03', a.target, a.as_of, CASE WHEN b.trades < 30 THEN false WHEN b.trades IS NOT NULL THEN true END AND a.yoy <= -40 AND a.chg >= 10 FROM m a LEFT JOIN m b ON b.target = a.target AND b.n = a.n - 12 WHERE a.v % 6 <> 0
""")
def region_rules(spark, sf_dir):
    """Rules over months: unsold flats, prices that fall three times running, trades against a year ago."""
    series = [
        ("UNSOLD_UNITS", "v % 300", "true", "true"), ("UNSOLD_3M_CHG", "v % 120 - 10", "v % 9 != 0", "true"), ("UNSOLD_PER_1K_HH", "v % 5", "true", "true"),
        ("PRICE_IDX_3M_CHG", "v % 3 - 2", "v % 8 != 0", "true"), ("TRADE_YOY", "v % 150 - 100", "true", "v % 6 != 0"), ("TRADE_COUNT", "n * 20", "true", "true"),
    ]
    metrics = _metrics(_sums(spark, sf_dir, F.date_format("o_orderdate", "yyyyMM")), series)
    found = [rules.evaluate(r, metrics) for r in rules.RULES if r.monthly]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"""
WITH g AS (SELECT o_custkey % 60 AS target, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS as_of, {_V} FROM orders GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN v % 5 <> 0 THEN v % 150 END AS g, CASE WHEN v % 3 = 0 THEN false WHEN v % 4 <> 0 THEN v % 80 >= 50 END AS due FROM g)
SELECT 'R-C06' AS rule_code, target, as_of, CASE WHEN g IS NOT NULL THEN g >= 100 OR due END AS verdict FROM m
""")
def pf_rule(spark, sf_dir):
    """Guarantees, or what falls due within a year, against equity."""
    series = [("PF_GUARANTEE_TO_EQUITY", "v % 150", "v % 5 != 0", "true"), ("PF_DUE_12M_TO_EQUITY", "v % 80", "v % 4 != 0", "v % 3 != 0")]
    return rules.pf_exposure(_metrics(_sums(spark, sf_dir, F.concat(F.year("o_orderdate"), F.lit("Q"), F.quarter("o_orderdate"))), series))


_TODAY = datetime.date(1998, 6, 30)


@query("""
SELECT 'R-C04' AS rule_code, o_custkey AS target, o_orderkey AS as_of, o_orderpriority IN ('1-URGENT', '2-HIGH') AS verdict
FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-05-31' AND DATE '1998-06-30'
""")
def material_filings(spark, sf_dir):
    """Filings of a grave kind in the last thirty days."""
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "DEFAULT").when(F.col("o_orderpriority") == "2-HIGH", "REHAB").otherwise("OTHER")
    f = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("corp_code"), F.col("o_orderkey").alias("rcept_no"), F.to_date("o_orderdate").alias("rcept_dt"), kind.alias("event_type"))
    return rules.material_filings(f, _TODAY)


@query("""
WITH g AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(round(o_totalprice) AS BIGINT) ELSE 0 END AS equity, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey * 37 % 300000 END AS balance,
                  row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS k
           FROM orders WHERE o_orderstatus <> 'F' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1997-06-30' AND DATE '1998-06-30')
SELECT 'R-C05' AS rule_code, o_custkey AS target, o_orderkey AS as_of, CASE WHEN equity > 0 AND balance IS NOT NULL THEN balance >= equity END AS verdict FROM g WHERE k = 1
""")
def guarantee_rule(spark, sf_dir):
    """The latest guarantee of a year whose total balance is at or over equity."""
    f = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("corp_code"), F.col("o_orderkey").alias("rcept_no"), F.to_date("o_orderdate").alias("rcept_dt"), F.when(F.col("o_orderstatus") == "F", "x").alias("superseded_by"),
        F.when(F.col("o_orderkey") % 5 != 0, F.round("o_totalprice").cast("long")).otherwise(0).alias("equity"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") * 37 % 300000).alias("total_balance"),
    )
    return rules.guarantee_balance(f, _TODAY)


_STATE = """
a AS (SELECT 'R' || o_orderkey % 7 AS rule_code, 1 AS rule_version, o_custkey AS target, o_orderkey AS as_of FROM orders),
s AS (SELECT *, CASE as_of % 3 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'ACK' ELSE 'CLOSED' END AS status, CASE WHEN as_of % 3 = 2 THEN 'OLD' END AS close_reason, CASE WHEN as_of % 3 = 2 THEN DATE '2020-01-01' END AS closed_at FROM a WHERE as_of % 2 = 0)
"""
_AT = datetime.date(2021, 1, 1)


def _alerts(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.concat(F.lit("R"), F.col("o_orderkey") % 7).alias("rule_code"), F.lit(1).alias("rule_version"), F.col("o_custkey").alias("target"), F.col("o_orderkey").alias("as_of"))
    third = F.col("as_of") % 3
    closed = third == 2
    s = a.where("as_of % 2 = 0").withColumns({"status": F.when(third == 0, "OPEN").when(third == 1, "ACK").otherwise("CLOSED"), "close_reason": F.when(closed, "OLD"), "closed_at": F.when(closed, F.lit(datetime.date(2020, 1, 1)))})
    return a, s


@query(f"""
WITH {_STATE},
p AS (SELECT *, CASE as_of % 4 WHEN 2 THEN 'CLOSE' WHEN 3 THEN 'STORE_CLOSED' ELSE 'OPEN' END AS action, CASE WHEN as_of % 4 >= 2 THEN 'RESOLVED' END AS why FROM a WHERE as_of % 5 < 3)
SELECT rule_code, rule_version, target, as_of,
  CASE WHEN action = 'OPEN' THEN CASE WHEN status = 'ACK' THEN 'ACK' ELSE 'OPEN' END WHEN action IS NOT NULL THEN 'CLOSED' ELSE status END AS status,
  CASE WHEN action = 'OPEN' THEN NULL WHEN action IS NOT NULL AND status IS DISTINCT FROM 'CLOSED' THEN why ELSE close_reason END AS close_reason,
  CASE WHEN action = 'OPEN' THEN NULL WHEN action IS NOT NULL AND status IS DISTINCT FROM 'CLOSED' THEN DATE '2021-01-01' ELSE closed_at END AS closed_at,
  CASE WHEN action = 'OPEN' AND status IS NULL THEN 'NEW' WHEN action = 'OPEN' AND status = 'CLOSED' THEN 'REOPENED' END AS kind
FROM s FULL JOIN p USING (rule_code, rule_version, target, as_of)
""")
def alert_snapshot(spark, sf_dir):
    """The next snapshot of alerts: what opens, reopens, stays acknowledged and closes."""
    a, s = _alerts(spark, sf_dir)
    step = F.col("as_of") % 4
    p = a.where("as_of % 5 < 3").withColumns({"action": F.when(step == 2, "CLOSE").when(step == 3, "STORE_CLOSED").otherwise("OPEN"), "close_reason": F.when(step >= 2, "RESOLVED")})
    return lifecycle.apply(s, p, _AT)


@query(f"""
WITH {_STATE},
r(rule_code, target_type) AS (VALUES ('R0', 'COMPANY'), ('R1', 'COMPANY'), ('R2', 'REGION'), ('R3', 'REGION'), ('R4', 'SITE')),
w AS (SELECT s.*, CASE WHEN status = 'CLOSED' THEN NULL WHEN target_type IS NULL THEN 'RULE_DISABLED' WHEN target_type = 'COMPANY' AND target % 3 = 0 OR target_type = 'REGION' AND target % 2 = 1 THEN 'OUT_OF_SCOPE' END AS why FROM s LEFT JOIN r USING (rule_code))
SELECT rule_code, rule_version, target, as_of, CASE WHEN why IS NULL THEN status ELSE 'CLOSED' END AS status, coalesce(why, close_reason) AS close_reason, CASE WHEN why IS NULL THEN closed_at ELSE DATE '2021-01-01' END AS closed_at FROM w
""")
def alerts_in_scope(spark, sf_dir):
    """Alerts of disabled rules and of targets no longer looked at close; a type whose list was not read stays."""
    _, s = _alerts(spark, sf_dir)
    enabled = spark.createDataFrame([("R0", "COMPANY"), ("R1", "COMPANY"), ("R2", "REGION"), ("R3", "REGION"), ("R4", "SITE")], "rule_code string, target_type string")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target"))
    targets = c.where("target % 3 != 0").select(F.lit("COMPANY").alias("target_type"), "target").union(c.where("target % 2 = 0").select(F.lit("REGION"), "target"))
    return lifecycle.close_out_of_scope(s, enabled, targets, _AT)


@query(f"WITH {_STATE} SELECT * REPLACE (CASE WHEN as_of % 10 = 0 AND status <> 'CLOSED' THEN 'ACK' ELSE status END AS status) FROM s")
def alert_acknowledged(spark, sf_dir):
    """Chosen alerts acknowledged unless they are closed."""
    a, s = _alerts(spark, sf_dir)
    return lifecycle.transition(s, a.where("as_of % 10 = 0"), "ACK")
