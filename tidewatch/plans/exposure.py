"""Project-finance sections written from orders, and what is read out of them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import exposure, pf_exposure
from tidewatch.plans import query, table

_DUE = ["3개월 이내", "3개월 초과 6개월 이내", "6개월 초과 12개월 이내", "1년 초과 2년 이내", "2년 초과 3년 이내", "3년 초과"]
#: Last month of the year whose orders are due in each bucket.
_MONTHS = [3, 6, 9, 10, 11, 12]
_HEADS = {"F": "① 단독사업", "O": "② 컨소시엄 참여사업(전체분)", "P": "③ 컨소시엄 참여사업(회사분)"}


def _row(*cells):
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c if not isinstance(c, str) else F.lit(c), F.lit("</td>")) for c in cells], F.lit("</tr>"))


def sections(orders):
    """(o_custkey, html) of a section for each customer: a summary for each status of orders, a site for each order that is not of low priority."""
    c = F.col
    million = F.round("o_totalprice").cast("long")
    first = [0, *_MONTHS[:-1]]
    o = orders.select(
        "o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", million.alias("g"), F.month("o_orderdate").alias("m"),
        F.when(c("o_orderpriority").isin("1-URGENT", "2-HIGH"), "정비사업").otherwise("기타사업").alias("category"), F.when(c("o_orderkey") % 2 == 0, "본PF").otherwise("브릿지론").alias("kind"),
    )
    shown = lambda x: F.coalesce(F.format_number(x, 0), F.lit("-"))
    due = [F.sum(F.when((c("m") > a) & (c("m") <= b), c("g"))).alias(f"d{b}") for a, b in zip(first, _MONTHS, strict=True)]
    lines = o.groupBy("o_custkey", "o_orderstatus", "category", "kind").agg((F.sum("g") + F.count("*")).alias("limit"), F.sum("g").alias("g"), *due, F.count("*").alias("prior"))
    amounts = ["limit", "g", "g", *[f"d{b}" for b in _MONTHS], "prior"]
    lines = lines.withColumn("line", _row(c("category"), c("kind"), *[shown(c(x)) for x in amounts]))
    sums = {x: F.sum(x).alias(x) for x in dict.fromkeys(amounts)}
    tables = lines.groupBy("o_custkey", "o_orderstatus").agg(F.array_join(F.array_sort(F.collect_list("line")), "").alias("lines"), *sums.values())
    head = "<tr><th rowspan='2'>구분</th><th rowspan='2'>종류</th><th rowspan='2'>보증한도</th><th rowspan='2'>보증금액</th><th colspan='8'>대출잔액</th></tr><tr><th>당기</th>" + "".join(f"<th>{d}</th>" for d in _DUE) + "<th>전기</th></tr>"
    total = F.when(c("o_custkey") % 2 == 0, _row("합계", "합계", *[shown(c(x)) for x in amounts])).otherwise("")
    title = F.create_map(*[F.lit(x) for pair in _HEADS.items() for x in pair])[c("o_orderstatus")]
    tables = tables.select("o_custkey", F.struct(c("o_orderstatus").alias("place"), F.concat(F.lit("<p>"), title, F.lit(f"</p><p>(단위: 백만원)</p><table>{head}"), "lines", total, F.lit("</table>")).alias("html")).alias("x"))
    listed = o.where("o_orderstatus != 'O' AND o_orderpriority != '5-LOW'").withColumn("line", _row(F.concat(F.lit("서울시 "), c("o_orderkey").cast("string"), F.lit("구")), c("kind"), "연대보증", F.format_number("g", 0), F.concat(F.lit("채무자"), c("o_orderkey").cast("string")), F.format_number("g", 0)))
    site_head = "<tr><th>사업지역</th><th>PF 종류</th><th>신용보강</th><th>보증금액</th><th>채무자</th><th>대출잔액</th></tr>"
    site = listed.groupBy("o_custkey", "category").agg(F.array_join(F.array_sort(F.collect_list("line")), "").alias("lines"))
    site = site.select("o_custkey", F.struct(F.concat(F.lit("S"), "category").alias("place"), F.concat(F.lit("<p>세부 내역 "), "category", F.lit(f"</p><table>{site_head}"), "lines", F.lit("</table>")).alias("html")).alias("x"))
    said = o.where("o_orderstatus != 'O'").groupBy("o_custkey").agg(F.sum(F.when((c("o_custkey") % 3 != 0) | (c("o_orderstatus") == "F"), c("g"))).alias("g")).where("g IS NOT NULL")
    text = F.concat(F.lit("<p>당사는 PF와 관련하여 총 "), F.format_number("g", 0), F.lit("백만원의 신용보강을 제공하고 있습니다.</p>"))
    said = said.select("o_custkey", F.struct(F.lit("").alias("place"), text.alias("html")).alias("x"))
    parts = said.unionByName(tables).unionByName(site)
    return parts.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["html"]), "").alias("html"))


_ORDERS = """
WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus AS s, o_orderpriority AS p, CAST(round(o_totalprice) AS BIGINT) AS g, month(o_orderdate) AS m FROM orders),
mine AS (SELECT o_custkey, CAST(sum(g) AS BIGINT) AS g, CAST(sum(g) + count(*) AS BIGINT) AS l, count(*) AS n, CAST(sum(g) FILTER (o_orderkey % 2 = 1) AS BIGINT) AS bridge,
  CAST(sum(g) FILTER (m <= 3) AS BIGINT) AS m3, CAST(sum(g) FILTER (m BETWEEN 4 AND 6) AS BIGINT) AS m6, CAST(sum(g) FILTER (m BETWEEN 7 AND 9) AS BIGINT) AS m12, CAST(sum(g) FILTER (m = 10) AS BIGINT) AS y2, CAST(sum(g) FILTER (m = 11) AS BIGINT) AS y3, CAST(sum(g) FILTER (m = 12) AS BIGINT) AS over3,
  CAST(sum(g) FILTER (p <> '5-LOW') AS BIGINT) AS sites, count(*) FILTER (p <> '5-LOW') AS n_sites, CAST(sum(g) FILTER (o_custkey % 3 <> 0 OR s = 'F') AS BIGINT) AS stated
  FROM o WHERE s <> 'O' GROUP BY 1)
"""


@query(_ORDERS + """
SELECT k.o_custkey, 'PARSED' AS status, l * 1000000 AS limit_won, g * 1000000 AS guarantee, g * 1000000 AS balance, n * 1000000 AS prior, bridge * 1000000 AS bridge_guarantee,
  m3 * 1000000 AS m3, m6 * 1000000 AS m6, m12 * 1000000 AS m12, y2 * 1000000 AS y2, y3 * 1000000 AS y3, over3 * 1000000 AS over3,
  CASE WHEN g IS NOT NULL THEN (coalesce(m3, 0) + coalesce(m6, 0) + coalesce(m12, 0)) * 1000000 END AS due_within_12m,
  coalesce(n_sites, 0) AS n_sites, sites * 1000000 AS sites_guarantee, abs(sites - g) * 100 <= g AS reconciled, stated * 1000000 AS stated_total, abs(g - stated) * 100 <= stated AS stated_match,
  CASE WHEN g IS NULL THEN 'DUE_UNREAD' END AS note
FROM (SELECT DISTINCT o_custkey FROM o) k LEFT JOIN mine USING (o_custkey)
""")  # fmt: skip
def pf_reports(spark, sf_dir):
    """Each customer's exposure, its due buckets and both reconciliations, read from a section of filing that its orders make."""
    found = pf_exposure.lines(sections(table(spark, sf_dir, "orders")), "o_custkey", "html")
    r = pf_exposure.reports(found, "o_custkey").withColumnRenamed("limit", "limit_won")
    money = ["limit_won", "guarantee", "balance", "prior", "bridge_guarantee", *pf_exposure.BUCKETS, "due_within_12m", "sites_guarantee", "stated_total"]
    return r.withColumns({x: F.col(x).cast("long") for x in money}).select("o_custkey", "status", *money, "n_sites", "reconciled", "stated_match", "note")


@query("""
SELECT o_custkey, 'seoul' AS place, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'R' ELSE 'O' END AS category, CASE WHEN o_orderkey % 2 = 0 THEN 'main' ELSE 'bridge' END AS kind,
  count(*) AS n, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS guarantee, CAST(min(o_orderkey) AS VARCHAR) AS first_debtor
FROM orders WHERE o_orderstatus <> 'O' AND o_orderpriority <> '5-LOW' GROUP BY ALL
""")
def pf_sites(spark, sf_dir):
    """Sites read from the same sections, counted by customer, category and kind."""
    c = F.col
    s = pf_exposure.lines(sections(table(spark, sf_dir, "orders")), "o_custkey", "html").where("role = 'SITE'")
    place = F.when(c("region").startswith("서울시"), "seoul")
    category = F.when(c("category") == "정비사업", "R").otherwise("O")
    kind = F.when(c("pf_type") == "본PF", "main").otherwise("bridge")
    debtor = F.regexp_extract("debtor", "[0-9]+", 0).cast("long")
    return s.groupBy("o_custkey", place.alias("place"), category.alias("category"), kind.alias("kind")).agg(F.count("*").alias("n"), (F.sum("guarantee") / 1_000_000).cast("long").alias("guarantee"), F.min(debtor).cast("string").alias("first_debtor"))


@query("""
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_orderpriority AS p, CAST(o_orderdate AS DATE) AS d, CAST(round(o_totalprice) AS BIGINT) AS v FROM orders),
unsold AS (SELECT n_nationkey AS r, n_nationkey AS value FROM nation WHERE n_nationkey % 4 <> 0),
j AS (SELECT o.*, CASE WHEN k % 7 <> 0 THEN k % 25 END AS r, value FROM o LEFT JOIN unsold ON k % 7 <> 0 AND unsold.r = k % 25 WHERE d >= DATE '1997-01-01'),
contracts AS (SELECT c, count(*) AS n, sum(v) AS total, sum(v) FILTER (r IS NOT NULL) AS mapped, sum(v) FILTER (value >= 12) AS risky, count(*) FILTER (value >= 12) AS n_risky FROM j WHERE s = 'F' AND k % 11 <> 0 GROUP BY 1),
g AS (SELECT c, v, d, k % 3 AS equity, row_number() OVER (PARTITION BY c ORDER BY d DESC, k::VARCHAR DESC) AS place, sum(v) FILTER (k % 2 = 0) OVER (PARTITION BY c) AS pf FROM j WHERE s = 'O' AND k % 5 <> 0),
alerts AS (SELECT c, count(*) AS n FROM o WHERE p = '1-URGENT' AND s <> 'F' GROUP BY 1),
pf AS (SELECT c, year(d) || 'Q' || quarter(d) AS q, max(v) AS v, max(k) AS k FROM o WHERE s = 'P' GROUP BY c, year(d), quarter(d) QUALIFY row_number() OVER (PARTITION BY c ORDER BY year(d) || 'Q' || quarter(d) DESC) = 1),
presales AS (SELECT c, count(*) AS n, sum(k % 500) AS units, sum(k % 500) FILTER (value IS NOT NULL) AS judged, sum(k % 500) FILTER (value >= 12) AS risky, sum(k % 50) FILTER (k % 4 = 0) AS remaining FROM j WHERE p = '3-MEDIUM' AND k % 3 <> 0 GROUP BY 1)
SELECT c_custkey AS corp_code, c_name AS corp_name, coalesce(contracts.n, 0) AS n_contracts, CAST(total AS BIGINT) AS total, CAST(mapped AS BIGINT) AS mapped, CAST(contracts.risky AS BIGINT) AS risky,
  CASE WHEN mapped > 0 THEN (coalesce(contracts.risky, 0) * 20000 + mapped) // (mapped * 2) / 100.0 END AS risky_share, coalesce(n_risky, 0) AS n_risky,
  CASE WHEN equity > 0 THEN (g.v * 20000 + equity * 1000) // (equity * 2000) / 100.0 END AS guarantee_ratio, g.d AS guarantee_date, CAST(g.pf AS BIGINT) AS pf_guaranteed, coalesce(alerts.n, 0) AS open_alerts,
  pf.q AS pf_period, CASE WHEN pf.k % 3 <> 0 THEN pf.v END AS pf_to_equity, CASE WHEN pf.k % 2 = 0 THEN pf.v // 2 END AS pf_due_to_equity,
  coalesce(presales.n, 0) AS n_presales, CAST(units AS BIGINT) AS presale_units, CAST(CASE WHEN presales.risky > 0 THEN presales.risky END AS BIGINT) AS presale_risky, CASE WHEN judged > 0 THEN (coalesce(presales.risky, 0) * 20000 + judged) // (judged * 2) / 100.0 END AS presale_risky_share,
  CAST(remaining AS BIGINT) AS remaining_units, CASE WHEN pf.q IS NOT NULL THEN CASE WHEN pf.k % 3 <> 0 THEN 'OK' ELSE 'NEG_EQUITY' END END AS pf_status
FROM customer LEFT JOIN contracts ON contracts.c = c_custkey LEFT JOIN g ON g.c = c_custkey AND place = 1 LEFT JOIN alerts ON alerts.c = c_custkey LEFT JOIN pf ON pf.c = c_custkey LEFT JOIN presales ON presales.c = c_custkey
WHERE c_custkey % 6 <> 0
""")  # fmt: skip
def exposure_summary(spark, sf_dir):
    """All that a company is exposed to in 21 columns, customers as companies and their orders as filings, notices and alerts."""
    c = F.col
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("k"), c("o_custkey").alias("corp_code"), c("o_orderstatus").alias("s"), c("o_orderpriority").alias("p"), c("o_orderdate").cast("date").alias("d"), F.round("o_totalprice").cast("long").alias("v"))
    region = F.when(c("k") % 7 != 0, c("k") % 25).alias("region_cd")
    none = F.lit(None).cast("string")
    companies = table(spark, sf_dir, "customer").select(c("c_custkey").alias("corp_code"), c("c_name").alias("corp_name"), (c("c_custkey") % 6 != 0).alias("is_target"))
    contracts = o.where("s = 'F'").select("corp_code", c("d").alias("rcept_dt"), c("v").alias("amount"), region, F.when(c("k") % 11 == 0, "x").alias("superseded_by"), none.alias("terminated_by"))
    guarantees = o.where("s = 'O'").select("corp_code", c("k").cast("string").alias("rcept_no"), c("d").alias("rcept_dt"), (c("k") % 3 * 1000).alias("equity"), c("v").alias("total_balance"), F.when(c("k") % 2 == 0, c("v")).alias("pf_amount"), F.when(c("k") % 5 == 0, "x").alias("superseded_by"))
    alerts = o.where("p = '1-URGENT'").select(F.lit("COMPANY").alias("target_type"), c("corp_code").alias("target"), F.when(c("s") == "F", "CLOSED").otherwise("OPEN").alias("status"))
    q = o.where("s = 'P'").groupBy("corp_code", F.concat(F.year("d"), F.lit("Q"), F.quarter("d")).alias("period_key")).agg(F.max("v").alias("v"), F.max("k").alias("k"))
    metric = lambda code, value, ok: q.select("corp_code", "period_key", F.lit(code).alias("metric_code"), value.cast("long").alias("value"), F.when(ok, "OK").otherwise("NEG_EQUITY").alias("status"))
    metrics = metric("PF_GUARANTEE_TO_EQUITY", c("v"), c("k") % 3 != 0).unionByName(metric("PF_DUE_12M_TO_EQUITY", F.floor(c("v") / 2), c("k") % 2 == 0))
    n = o.where("p = '3-MEDIUM'")
    presales = n.select(c("k").alias("notice"), c("d").alias("notice_date"), (c("k") % 500).alias("units"), region, none.alias("removed_at"))
    builders = n.select(c("k").alias("notice"), "corp_code", F.when(c("k") % 3 != 0, "MATCHED").otherwise("UNMATCHED").alias("status"))
    remainders = n.where("k % 4 = 0").select(c("k").alias("notice"), c("d").alias("notice_date"), (c("k") % 50).alias("units"), none.alias("removed_at"))
    unsold = table(spark, sf_dir, "nation").where("n_nationkey % 4 != 0").select(c("n_nationkey").cast("long").alias("region_cd"), c("n_nationkey").alias("value"))
    reports = q.select("corp_code", "period_key", c("k").cast("string").alias("rcept_no"))
    found = exposure.summary(companies, contracts, guarantees, alerts, reports, metrics, presales, builders, remainders, unsold, "1997-01-01", 12)
    shares = ("risky_share", "guarantee_ratio", "presale_risky_share")
    return found.withColumns({x: c(x).cast("double") for x in shares})
