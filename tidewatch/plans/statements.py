"""Statements, metrics and rules of shares on the test tables: nations as companies, order priorities as accounts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions import periods
from tidewatch.operators import rules, statements
from tidewatch.plans import query, table

#: Priority -> statement, line and name of the account that its orders make up.
_ACCOUNTS = {
    "1-URGENT": ("IS", 1, "매출액"), "2-HIGH": ("IS", 2, "이자비용"), "3-MEDIUM": ("BS", 3, "단기차입금"),
    "4-NOT SPECIFIED": ("BS", 4, "2. 유동성장기부채"), "5-LOW": ("BS", 5, "유동성사채"),
}


def _quarters(spark, sf_dir):
    """(corp_code, y, q, p, v): amounts in won of a nation's orders by quarter and priority."""
    c = F.col
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), c("o_custkey") == c("c_custkey"))
    won = F.round(c("o_totalprice")).cast("long")
    return o.groupBy(c("c_nationkey").alias("corp_code"), F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"), c("o_orderpriority").alias("p")).agg(F.sum(won).alias("v"))


_QUARTERS = """
WITH v AS (SELECT c_nationkey AS corp_code, year(o_orderdate) AS y, quarter(o_orderdate) AS q, o_orderpriority AS p, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
"""


def _raw(spark, sf_dir):
    """Raw lines: the year to date of income, balances as they stand, and an older receipt of each report with other amounts."""
    c = F.col
    year = Window.partitionBy("corp_code", "y", "p").orderBy("q")
    v = _quarters(spark, sf_dir).withColumn("ytd", F.sum("v").over(year))
    entry = F.create_map(*[x for p, (sj, n, name) in _ACCOUNTS.items() for x in (F.lit(p), F.struct(F.lit(sj).alias("sj"), F.lit(n).alias("n"), F.lit(name).alias("name")))])[c("p")]
    receipts = F.explode(F.array(F.struct(F.lit("1").alias("no"), F.lit(3).alias("k")), F.struct(F.lit("2").alias("no"), F.lit(1).alias("k"))))
    r = v.withColumn("a", entry).withColumn("r", receipts)
    quarter = F.concat(c("y").cast("string"), F.lit("Q"), c("q").cast("string"))
    money = lambda x: (x * c("r.k")).cast("decimal(24,0)")
    return r.select(
        "corp_code", c("y").cast("string").alias("bsns_year"), periods.report_code(quarter).alias("reprt_code"), F.lit("CFS").alias("fs_div"), c("r.no").alias("rcept_no"), c("a.sj").alias("sj_div"), c("a.n").alias("line_no"),
        F.when(c("p") == "5-LOW", "bonds").alias("account_id"), c("a.name").alias("account_nm"), money(c("v")).alias("thstrm_amount"), F.when(c("a.sj") == "IS", money(c("ytd"))).alias("thstrm_add_amount"),
    )


def _dictionaries(spark):
    accounts = [("SHORT_BORROWINGS", "BS", "POINT", "SUM", 1), ("BONDS", "BS", "POINT", "SUM", 2), ("REVENUE", "IS", "FLOW", "FIRST", 3), ("INTEREST_EXPENSE", "IS", "FLOW", "FIRST", 4)]
    found = [
        (1, "SHORT_BORROWINGS", None, "NAME_EXACT", "단기차입금", 10, False, None), (2, "SHORT_BORROWINGS", None, "NAME_EXACT", "유동성장기부채", 20, False, None), (3, "BONDS", None, "ACCOUNT_ID", "bonds", 5, False, None),
        (4, "BONDS", None, "NAME_REGEX", "(유동성)?사채", 10, False, None), (5, "REVENUE", None, "NAME_EXACT", "매출액", 10, False, None), (6, "INTEREST_EXPENSE", None, "NAME_REGEX", "이자.*", 10, False, None),
    ]
    return spark.createDataFrame(accounts, "std_code string, sj_div string, flow_type string, agg string, sort_order int"), spark.createDataFrame(found, "map_id int, std_code string, sj_div string, match_type string, pattern string, priority int, abs_value boolean, section string")


@query(_QUARTERS + """,
flow AS (SELECT corp_code, y, q, CASE p WHEN '1-URGENT' THEN 'REVENUE' ELSE 'INTEREST_EXPENSE' END AS std, sum(v) OVER (PARTITION BY corp_code, y, p ORDER BY q) AS a FROM v WHERE p < '3'),
quarters AS (SELECT n.corp_code, n.y, n.q, n.std, n.a - coalesce(b.a, 0) AS a FROM flow n LEFT JOIN flow b ON b.corp_code = n.corp_code AND b.y = n.y AND b.std = n.std AND b.q = n.q - 1 WHERE n.q = 1 OR b.q IS NOT NULL),
point AS (SELECT corp_code, y, q, CASE p WHEN '5-LOW' THEN 'BONDS' ELSE 'SHORT_BORROWINGS' END AS std, sum(v) AS a FROM v WHERE p >= '3' GROUP BY ALL)
SELECT corp_code, y || 'Q' || q AS period_key, std AS std_code, basis, CAST(a AS BIGINT) AS amount FROM (SELECT *, 'CUM' AS basis FROM flow UNION ALL SELECT *, 'QTR' FROM quarters UNION ALL SELECT *, 'POINT' FROM point)
""")
def standard_accounts(spark, sf_dir):
    """Standard accounts of raw lines: the latest receipt, rules by id, name and expression, sums, and quarters of years to date."""
    out = statements.standardize(_raw(spark, sf_dir), *_dictionaries(spark))
    return out.select("corp_code", "period_key", "std_code", "basis", F.col("amount").cast("long").alias("amount"))


def _wide(spark, sf_dir):
    """Facts of each nation and quarter; equity may be negative and interest may be missing."""
    by = lambda p: F.max(F.when(F.col("p") == p, F.col("v")))
    w = _quarters(spark, sf_dir).groupBy("corp_code", "y", "q").agg(*[by(p).alias(name) for p, name in zip(_ACCOUNTS, "abcde", strict=True)])
    c = F.col
    return w.select(
        c("corp_code"), F.concat(c("y").cast("string"), F.lit("Q"), c("q").cast("string")).alias("period_key"), (c("c") + c("d")).alias("liabilities"), (c("e") - c("c")).alias("equity"), (c("d") + c("e")).alias("assets"),
        c("a").alias("current_assets"), (c("c") * (c("corp_code") % 5)).alias("current_liabilities"), c("c").alias("short"), F.when(c("corp_code") % 3 != 0, c("d")).alias("long"), c("e").alias("bonds"),
        c("a").alias("revenue"), (c("a") - c("b")).alias("ocf"), c("b").alias("q_income"), (c("d") - c("e")).alias("q_interest"), (c("a") - c("b")).alias("q_ocf"),
    )


_WIDE = _QUARTERS + """,
w AS (SELECT corp_code, y, q, max(v) FILTER (p = '1-URGENT') AS a, max(v) FILTER (p = '2-HIGH') AS b, max(v) FILTER (p = '3-MEDIUM') AS c, max(v) FILTER (p = '4-NOT SPECIFIED') AS d, max(v) FILTER (p = '5-LOW') AS e FROM v GROUP BY ALL)
"""


@query(_WIDE + """,
f AS (SELECT corp_code, y, q, c + d AS liabilities, e - c AS equity, d + e AS assets, a AS current_assets, c * (corp_code % 5) AS current_liabilities, coalesce(c, CASE WHEN e IS NOT NULL OR (corp_code % 3 <> 0 AND d IS NOT NULL) THEN 0 END) + coalesce(CASE WHEN corp_code % 3 <> 0 THEN d END, 0) + coalesce(e, 0) AS debts, a AS revenue, a - b AS ocf, b AS income, d - e AS interest FROM w),
r AS (SELECT corp_code, y, q, k.code, k.t, k.u, k.factor, k.negative FROM f, LATERAL (VALUES ('DEBT_RATIO', liabilities, equity, 100, 'NEG_EQUITY'), ('CURRENT_RATIO', current_assets, current_liabilities, 100, 'INCONSISTENT'), ('BORROWING_DEP', debts, assets, 100, NULL),
  ('INTEREST_COVERAGE', income, interest, 1, 'INCONSISTENT'), ('OCF_MARGIN', ocf, revenue, 100, 'INCONSISTENT')) AS k(code, t, u, factor, negative)),
s AS (SELECT *, CASE WHEN t IS NULL OR u IS NULL THEN 'MISSING' WHEN u = 0 THEN 'ZERO_DENOM' WHEN u < 0 AND negative IS NOT NULL THEN negative ELSE 'OK' END AS status FROM r),
m AS (SELECT corp_code, y, q, code, CASE WHEN status = 'OK' THEN round(t::DOUBLE * factor / u, 4) END AS value, status FROM s),
d AS (SELECT n.corp_code, n.y, n.q, n.code || '_YOY' AS code, round(n.value - b.value, 4) AS value FROM m n LEFT JOIN m b ON b.corp_code = n.corp_code AND b.q = n.q AND b.y = n.y - 1 AND b.code = n.code WHERE n.code IN ('DEBT_RATIO', 'BORROWING_DEP')),
g AS (SELECT n.corp_code, n.y, n.q, n.revenue AS now, b.revenue AS ago FROM f n LEFT JOIN f b ON b.corp_code = n.corp_code AND b.q = n.q AND b.y = n.y - 1)
SELECT corp_code, y || 'Q' || q AS period_key, code AS metric_code, value, status FROM m
UNION ALL SELECT corp_code, y || 'Q' || q, code, value, CASE WHEN value IS NULL THEN 'MISSING' ELSE 'OK' END FROM d
UNION ALL SELECT corp_code, y || 'Q' || q, 'REVENUE_YOY', CASE WHEN ago <> 0 THEN round((now - ago) * 100.0::DOUBLE / abs(ago), 4) END, CASE WHEN now IS NULL OR ago IS NULL THEN 'MISSING' WHEN ago = 0 THEN 'ZERO_DENOM' ELSE 'OK' END FROM g
UNION ALL SELECT corp_code, y || 'Q' || q, 'OCF_QTR', ocf::DOUBLE, CASE WHEN ocf IS NULL THEN 'MISSING' ELSE 'OK' END FROM f
""")
def nation_metrics(spark, sf_dir):
    """Nine metrics of each nation and quarter, each with its status; changes compare with the same quarter of the year before."""
    m = statements.company_metrics(_wide(spark, sf_dir))
    return m.withColumn("value", F.col("value").cast("double"))


@query("""
WITH o AS (SELECT o_custkey AS c, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS p, o_orderkey AS k, CAST(round(o_totalprice) AS BIGINT) AS v FROM orders),
r AS (SELECT c, p, v, CASE WHEN k % 2 = 0 THEN v // 3 END AS bridge, CASE WHEN k % 3 <> 0 THEN v // 2 END AS due FROM o QUALIFY row_number() OVER (PARTITION BY c, p ORDER BY k DESC) = 1),
e AS (SELECT r.*, CAST(round(c_acctbal) AS BIGINT) AS equity FROM r LEFT JOIN customer ON c_custkey = c AND c_custkey % 7 <> 0),
m AS (SELECT c, p, k.code, k.t, k.u, k.negative FROM e, LATERAL (VALUES ('PF_GUARANTEE_TO_EQUITY', v, equity, true), ('PF_DUE_12M_TO_EQUITY', due, equity, true), ('PF_BRIDGE_SHARE', bridge, v, false)) AS k(code, t, u, negative)),
s AS (SELECT *, CASE WHEN t IS NULL OR u IS NULL THEN 'MISSING' WHEN u = 0 THEN 'ZERO_DENOM' WHEN u < 0 AND negative THEN 'NEG_EQUITY' ELSE 'OK' END AS status FROM m)
SELECT c AS corp_code, p AS period_key, code AS metric_code, CASE WHEN status = 'OK' THEN round(t * 100.0::DOUBLE / u, 4) END AS value, status FROM s
""")
def pf_metric_table(spark, sf_dir):
    """Project-finance metrics of the latest report of each customer and quarter, against equity that may be negative or unknown."""
    c = F.col
    o = table(spark, sf_dir, "orders").select(c("o_custkey").alias("corp_code"), F.concat(F.year("o_orderdate"), F.lit("Q"), F.quarter("o_orderdate")).alias("period_key"), c("o_orderkey").alias("rcept_no"), F.round("o_totalprice").cast("long").alias("guarantee"))
    reports = o.withColumns({"bridge_guarantee": F.when(c("rcept_no") % 2 == 0, F.floor(c("guarantee") / 3)), "due_within_12m": F.when(c("rcept_no") % 3 != 0, F.floor(c("guarantee") / 2))})
    equity = table(spark, sf_dir, "customer").where("c_custkey % 7 != 0").select(c("c_custkey").alias("corp_code"), F.round("c_acctbal").cast("long").alias("equity"))
    m = statements.pf_metrics(reports, o.select("corp_code", "period_key").distinct().join(equity, "corp_code"))
    return m.withColumn("value", c("value").cast("double"))


@query("""
WITH o AS (SELECT o_custkey AS target, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 25 END AS r, CAST(round(o_totalprice) AS BIGINT) AS a FROM orders WHERE o_orderdate >= DATE '1998-01-01'),
u AS (SELECT n_nationkey AS r, n_nationkey AS value FROM nation WHERE n_nationkey % 4 <> 0),
j AS (SELECT o.*, value FROM o LEFT JOIN u USING (r) WHERE r IS NOT NULL),
s AS (SELECT k.code, target, sum(a) FILTER (k.keep OR value IS NOT NULL) AS total, coalesce(sum(a) FILTER (value >= 12), 0) AS risky, count(*) FILTER (value >= 12) AS n FROM j, (VALUES ('R-X01', true), ('R-X02', false)) AS k(code, keep) GROUP BY ALL)
SELECT code AS rule_code, target, '1998Q1' AS as_of, CASE WHEN total > 0 THEN (risky * 20000 + total) // (total * 2) >= 6000 AND n >= 2 END AS verdict FROM s
""")
def region_share_rules(spark, sf_dir):
    """The two rules of shares: contracts count where nothing is known of their region, presales do not."""
    c = F.col
    facts = table(spark, sf_dir, "orders").where("o_orderdate >= '1998-01-01'").select(c("o_custkey").alias("entity"), F.when(c("o_orderkey") % 13 != 0, c("o_orderkey") % 25).alias("region"), F.round("o_totalprice").cast("long").alias("amount"))
    n = table(spark, sf_dir, "nation").where("n_nationkey % 4 != 0").select(c("n_nationkey").cast("long").alias("region"), c("n_nationkey").alias("value"))
    # older values, and later ones that are not OK, do not count
    unsold = n.select("region", F.lit("199801").alias("period"), "value", F.lit("OK").alias("status")).unionByName(n.select("region", F.lit("199712").alias("period"), F.lit(99).alias("value"), F.lit("OK").alias("status")))
    unsold = unsold.unionByName(n.select("region", F.lit("199802").alias("period"), F.lit(None).cast("int").alias("value"), F.lit("MISSING").alias("status")))
    of = lambda code: rules.region_share(code, facts, unsold, "1998Q1", {"threshold": 12, "share": 60})
    return of("R-X01").unionByName(of("R-X02"))
