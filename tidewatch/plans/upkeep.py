"""Upkeep of dictionaries and universes, evidence, lineage, and how values are shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import formats
from tidewatch.operators import joins, upkeep
from tidewatch.plans import query, table

_AMOUNT = "CAST(o_totalprice AS DECIMAL(18,2))"


@query("""
WITH o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders),
w AS (SELECT *, round(v * 40000 / 100000000)::BIGINT AS e FROM o)
SELECT o_orderkey, CASE WHEN v >= 100 THEN format('{:,}', round(v)::BIGINT) ELSE v::VARCHAR END AS plain,
  CASE WHEN v * 40000 < 100000000 THEN format('{:,}', round(v * 40000 / 10000)::BIGINT) || '만원'
       WHEN e < 10000 THEN format('{:,}', e) || '억원'
       ELSE (e // 10000) || '조' || CASE WHEN e % 10000 = 0 THEN '' ELSE ' ' || format('{:,}', e % 10000) || '억' END || '원' END AS won
FROM w
""")
def money_text(spark, sf_dir):
    """Amounts as people read them."""
    o = table(spark, sf_dir, "orders").withColumn("v", F.expr(_AMOUNT))
    return o.select("o_orderkey", formats.plain(F.col("v")).alias("plain"), formats.won(F.col("v") * 40_000).alias("won"))


@query("SELECT o_orderkey, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter FROM orders")
def quarter_as_of(spark, sf_dir):
    """The calendar quarter of each order."""
    return table(spark, sf_dir, "orders").select("o_orderkey", formats.quarter_of(F.col("o_orderdate")).alias("quarter"))


@query("""
WITH s AS (SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus = 'F') AS f, max(o_totalprice) FILTER (o_orderstatus = 'O') AS o, max(o_totalprice) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1)
SELECT o_custkey, (f IS NOT NULL)::INT + (o IS NOT NULL)::INT + (p IS NOT NULL)::INT AS n_known FROM s
""")
def known_inputs(spark, sf_dir):
    """How many of three inputs each customer has."""
    best = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))).alias(s)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(*[best(s) for s in "FOP"]).select("o_custkey", formats.known("F", "O", "P").alias("n_known"))


@query("SELECT CAST(ts + INTERVAL 9 hour AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1 HAVING day < DATE '2024-01-20'")
def seoul_day_cut(spark, sf_dir):
    """Events by the day that it was in Seoul, up to a day."""
    e = table(spark, sf_dir, "events").withColumn("day", formats.local_day(F.col("ts")))
    return e.where("day < DATE'2024-01-20'").groupBy("day").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("""
WITH t(i, segment, status) AS (VALUES (1, 'BUILDING', 'F'), (2, 'MACHINERY', 'O'), (3, 'BUILDING', 'P'))
SELECT t.i, t.segment, t.status, count(*) AS n FROM t JOIN customer ON c_mktsegment = t.segment JOIN orders ON o_custkey = c_custkey AND o_orderstatus = t.status GROUP BY 1, 2, 3
""")
def zipped_parameters(spark, sf_dir):
    """Parallel parameter arrays as a relation with their places, joined on."""
    one = spark.range(1).select(F.posexplode(F.expr("arrays_zip(array('BUILDING', 'MACHINERY', 'BUILDING'), array('F', 'O', 'P'))")).alias("i", "z"))
    t = one.select((F.col("i") + 1).alias("i"), F.col("z")["0"].alias("segment"), F.col("z")["1"].alias("status"))
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t), (F.col("c_mktsegment") == F.col("segment")) & (F.col("o_orderstatus") == F.col("status")))  # as long as the arrays
    return joined.groupBy("i", "segment", "status").agg(F.count("*").alias("n"))


@query("""
WITH x AS (SELECT c_custkey, c_name, sum(o_totalprice) FILTER (o_orderstatus = 'P') AS exposure FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT c_custkey, exposure IS NULL AS unknown, total FROM (SELECT *, count(*) OVER () AS total FROM x) ORDER BY coalesce(exposure, -1) DESC, c_name, c_custkey LIMIT 50 OFFSET 850
""")
def exposure_page(spark, sf_dir):
    """A page of customers by exposure, unknown ones as -1 at the end, with the number of all."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("exposure"))
    x = table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    got = joins.page_with_total(x, [F.coalesce("exposure", F.lit(-1.0)).desc(), F.col("c_name"), F.col("c_custkey")], page_=17, size=50)
    return got.select("c_custkey", F.col("exposure").isNull().alias("unknown"), "total")


@query("SELECT user_id, event_type, props, min(event_id) AS event_id FROM events GROUP BY 1, 2, 3")
def signature_dedupe(spark, sf_dir):
    """Events that say the same once, the first of each."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "props", "event_id")
    return upkeep.first_of_signature(e, ["user_id", "event_type", "props"], ["event_id"])


_DECISION = "SELECT o_custkey AS corp_code, count(*) >= 3 AS target, 'orders ' || count(*) AS reason FROM orders WHERE year(o_orderdate) = {year} GROUP BY 1"


@query(f"""
WITH a AS ({_DECISION.format(year=1996)}), b AS ({_DECISION.format(year=1997)})
SELECT corp_code, b.target, b.reason, CASE WHEN b.target <> coalesce(a.target, false) THEN CASE WHEN b.target THEN 'IN' ELSE 'OUT' END ELSE 'REASON' END AS change
FROM b LEFT JOIN a USING (corp_code) WHERE b.target <> coalesce(a.target, false) OR (b.target AND b.reason IS DISTINCT FROM a.reason)
""")
def universe_history(spark, sf_dir):
    """What a year's decision about the universe changes against the year before."""
    o = table(spark, sf_dir, "orders")
    decide = lambda y: o.where(F.year("o_orderdate") == y).groupBy(F.col("o_custkey").alias("corp_code")).agg((F.count("*") >= 3).alias("target"), F.concat(F.lit("orders "), F.count("*").cast("string")).alias("reason"))
    return upkeep.universe_changes(decide(1996), decide(1997))


@query("""
WITH r AS (SELECT p_partkey AS id, p_brand, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END AS p_type, CASE WHEN p_size % 5 = 0 THEN 'USER' ELSE 'SEED' END AS origin FROM part),
s AS (SELECT p_partkey AS id, p_brand, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END AS p_type FROM part WHERE p_size > 20)
SELECT * FROM r WHERE origin = 'USER' UNION ALL
SELECT s.*, 'SEED' FROM s WHERE NOT EXISTS (SELECT 1 FROM r WHERE origin = 'USER' AND r.id = s.id AND r.p_brand = s.p_brand AND r.p_type IS NOT DISTINCT FROM s.p_type)
""")
def seed_sync(spark, sf_dir):
    """Rules after a seed file: users' rows stay, seed rows that the file lacks go."""
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("id"), "p_brand", F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("p_type"), "p_size")
    rules = rows.select("id", "p_brand", "p_type", F.when(F.col("p_size") % 5 == 0, "USER").otherwise("SEED").alias("origin"))
    return upkeep.sync_seed(rules, rows.where("p_size > 20").select("id", "p_brand", "p_type"), ["id", "p_brand", "p_type"])


_MAPPING = "SELECT 'S' AS source, s_suppkey AS source_code, s_nationkey AS region_cd, 'NAME' AS method, CAST(NULL AS VARCHAR) AS note FROM supplier"
_CHANGES = "SELECT 'S' AS source, s_suppkey AS source_code, CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey % 5 END AS region_cd, 'by hand' AS note FROM supplier WHERE s_suppkey % 2 = 0"


@query(f"""
WITH m AS ({_MAPPING}), c AS ({_CHANGES})
SELECT m.source, source_code, CASE WHEN c.note IS NULL THEN m.region_cd ELSE c.region_cd END AS region_cd,
  CASE WHEN c.note IS NULL THEN m.method WHEN c.region_cd IS NULL THEN 'UNMAPPED' ELSE 'MANUAL' END AS method, c.note FROM m LEFT JOIN c USING (source_code)
""")
def manual_remap(spark, sf_dir):
    """A mapping after changes by hand."""
    return upkeep.remapped(*_mapping(spark, sf_dir))


@query(f"""
WITH s AS (SELECT 'S' AS source, l_suppkey AS source_code, l_partkey, s_nationkey AS region_cd FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), c AS ({_CHANGES})
SELECT source_code, region_cd, count(*) AS n FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.source_code = s.source_code AND (c.region_cd IS NULL OR c.region_cd <> s.region_cd)) GROUP BY 1, 2
""")
def stats_inside_mapping(spark, sf_dir):
    """Figures of remapped codes that lie outside their new region go."""
    _, changes = _mapping(spark, sf_dir)
    li, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    stats = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.lit("S").alias("source"), F.col("l_suppkey").alias("source_code"), F.col("s_nationkey").alias("region_cd"))
    return upkeep.inside_mapping(stats, changes).groupBy("source_code", "region_cd").agg(F.count("*").alias("n"))


def _mapping(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    key = [F.lit("S").alias("source"), F.col("s_suppkey").alias("source_code")]
    mapping = s.select(*key, F.col("s_nationkey").alias("region_cd"), F.lit("NAME").alias("method"), F.lit(None).cast("string").alias("note"))
    changes = s.where("s_suppkey % 2 = 0").select(*key, F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey") % 5).alias("region_cd"), F.lit("by hand").alias("note"))
    return mapping, changes


@query("SELECT c_nationkey AS lawd_cd, c_mktsegment AS umd_nm, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE (c_custkey % 7)::VARCHAR END AS jibun, max(c_name) AS apt_nm FROM customer GROUP BY 1, 2, 3")
def place_dictionary(spark, sf_dir):
    """Places by district, quarter and lot."""
    c = table(spark, sf_dir, "customer")
    t = c.select(F.col("c_nationkey").alias("lawd_cd"), F.col("c_mktsegment").alias("umd_nm"), F.when(F.col("c_custkey") % 3 != 0, (F.col("c_custkey") % 7).cast("string")).alias("jibun"), F.col("c_name").alias("apt_nm"))
    return upkeep.place_names(t)


@query("""
WITH f AS (SELECT o_custkey AS corp_code, year(o_orderdate) AS period, o_orderdate::DATE AS rcept_dt, lpad(o_orderkey::VARCHAR, 12, '0') AS rcept_no FROM orders),
g AS (SELECT corp_code, period, min(rcept_dt) + 100 AS fetched_at, CASE WHEN corp_code % 5 <> 0 THEN min(rcept_no) END AS rcept_no FROM f GROUP BY 1, 2)
SELECT corp_code, period FROM g WHERE EXISTS (SELECT 1 FROM f WHERE f.corp_code = g.corp_code AND f.period = g.period AND f.rcept_dt >= g.fetched_at AND f.rcept_no > coalesce(g.rcept_no, ''))
""")
def late_corrections(spark, sf_dir):
    """Fetched units that a later filing has corrected since."""
    o = table(spark, sf_dir, "orders")
    f = o.select(F.col("o_custkey").alias("corp_code"), F.year("o_orderdate").cast("long").alias("period"), F.to_date("o_orderdate").alias("rcept_dt"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("rcept_no"))
    g = f.groupBy("corp_code", "period").agg(F.date_add(F.min("rcept_dt"), 100).alias("fetched_at"), F.min("rcept_no").alias("_no"))
    g = g.withColumn("rcept_no", F.when(F.col("corp_code") % 5 != 0, F.col("_no"))).drop("_no")
    return upkeep.refetch(g, f).select("corp_code", "period")


@query("SELECT page_id FROM pages WHERE html IS NOT NULL AND CASE WHEN page_id % 4 = 0 THEN 0 ELSE page_id % 4 END < 3")
def stale_documents(spark, sf_dir):
    """Stored pages that an older parser read."""
    p = table(spark, sf_dir, "pages")
    version = F.when(F.col("page_id") % 4 != 0, F.col("page_id") % 4)
    return upkeep.stale(p.select("page_id", F.col("html").alias("raw"), version.alias("parser_version")), 3).select("page_id")


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, year(o_orderdate) AS y, o_orderpriority AS p FROM orders),
d AS (SELECT o_custkey, y, p, min(o_orderkey) AS k FROM s GROUP BY 1, 2, 3)
SELECT o_custkey, count(*) AS n_sources, string_agg('ORDER|' || y || '|' || CASE WHEN p = '5-LOW' THEN '' ELSE p END, ';' ORDER BY k) AS sources FROM d GROUP BY 1
""")
def evidence_sources(spark, sf_dir):
    """Each customer's evidence names a source once, in order of first mention."""
    o = table(spark, sf_dir, "orders").withColumn("p", F.when(F.col("o_orderpriority") == "5-LOW", "-").otherwise(F.col("o_orderpriority")))
    source = upkeep.source_of("ORDER", F.year("o_orderdate"), F.col("p"), F.lit("-"), F.lit(None).cast("string"))
    each = o.groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", source.alias("s")))), lambda x: x["s"]).alias("all"))
    e = each.select("o_custkey", upkeep.evidence(F.lit("c"), F.lit(None).cast("string"), F.array(), F.col("all"), F.lit("m")).alias("e"))
    text = F.transform("e.sources", lambda s: F.concat(s["type"], F.lit("|"), s["period"].cast("string"), F.lit("|"), F.coalesce(s["rceptNo"], F.lit(""))))
    return e.select("o_custkey", F.size("e.sources").cast("long").alias("n_sources"), F.array_join(text, ";").alias("sources"))


@query("""
SELECT o_orderkey AS alert_id, c_custkey AS target_key, c_name AS stock_code FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_custkey % 3 <> 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_orderstatus <> 'P' AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND o_orderkey % 11 NOT IN (0, 1)
""")
def eligible_alerts(spark, sf_dir):
    """Alerts that an event study may use."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    alerts = o.select(
        F.col("o_orderkey").alias("alert_id"), F.col("o_custkey").alias("target_key"), F.when(F.col("o_orderstatus") == "P", "REGION").otherwise("COMPANY").alias("target_type"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "R-X01").when(F.col("o_orderpriority") == "2-HIGH", "R-X02").otherwise("R-C01").alias("rule_code"),
        F.when(F.col("o_orderkey") % 11 == 0, "RESOLVED").when(F.col("o_orderkey") % 11 == 1, "RULE_CHANGED").alias("close_reason"),
    )
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "Y").when(F.col("c_mktsegment") == "MACHINERY", "K").otherwise("E")
    companies = c.select(F.col("c_custkey").alias("corp_code"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("stock_code"), kind.alias("corp_cls"))
    return upkeep.eligible(alerts, companies).select("alert_id", "target_key", "stock_code")


@query("""
WITH p AS (SELECT l_orderkey AS o_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s, count(*) AS n FROM lineitem WHERE l_linenumber > 1 OR l_orderkey % 3 <> 0 GROUP BY 1),
v AS (SELECT l_orderkey AS o_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS v FROM lineitem GROUP BY 1)
SELECT v.o_orderkey, coalesce(n, 0) AS n_lines, coalesce(v = s, false) AS reproduced FROM v LEFT JOIN p USING (o_orderkey)
""")
def lineage_reproduced(spark, sf_dir):
    """Whether the lines that a value is traced to give it again."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    stored = li.groupBy("o_orderkey").agg(F.sum("amount").alias("value"))
    return upkeep.reproduced(stored, li.where("l_linenumber > 1 OR o_orderkey % 3 != 0"), ["o_orderkey"]).select("o_orderkey", "n_lines", "reproduced")


@query("""
SELECT block, k, n FROM (
  SELECT 'status' AS block, o_orderstatus AS k, count(*) AS n FROM orders GROUP BY 2
  UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2
  UNION ALL SELECT 'segment', c_mktsegment, count(*) FROM customer GROUP BY 2
  UNION ALL SELECT 'year', year(o_orderdate)::VARCHAR, count(*) FROM orders GROUP BY 2
  UNION ALL SELECT 'totals', 'orders', count(*) FROM orders UNION ALL SELECT 'totals', 'customers', count(*) FROM customer)
""")
def dashboard_summary(spark, sf_dir):
    """The blocks of a summary in one result; those over orders come from one pass by grouping sets."""
    o = table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate").cast("string"))
    o.createOrReplaceTempView("_summary_orders")
    sets = spark.sql("""
        SELECT CASE grouping_id(o_orderstatus, o_orderpriority, y) WHEN 3 THEN 'status' WHEN 5 THEN 'priority' WHEN 6 THEN 'year' ELSE 'totals' END AS block,
               CASE grouping_id(o_orderstatus, o_orderpriority, y) WHEN 3 THEN o_orderstatus WHEN 5 THEN o_orderpriority WHEN 6 THEN y ELSE 'orders' END AS k, count(*) AS n
        FROM _summary_orders GROUP BY o_orderstatus, o_orderpriority, y GROUPING SETS ((o_orderstatus), (o_orderpriority), (y), ())""")
    c = table(spark, sf_dir, "customer")
    segments = c.rollup("c_mktsegment").agg(F.grouping("c_mktsegment").alias("g"), F.count("*").alias("n"))
    segments = segments.select(F.when(F.col("g") == 1, "totals").otherwise("segment").alias("block"), F.when(F.col("g") == 1, "customers").otherwise(F.col("c_mktsegment")).alias("k"), "n")
    return sets.union(segments)
