"""Aggregates: filtered, exact medians, gated and rolled-up sums, melts, ordered lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import periods, stats
from tidewatch.operators import grids
from tidewatch.plans import query, table


def _orders(spark, sf):
    """Orders with the customer's nation and the month as an ordinal."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    m = F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1
    return o.join(c, o.o_custkey == c.c_custkey).withColumn("month_no", m)


def _nation_months(spark, sf):
    return _orders(spark, sf).groupBy("c_nationkey", "month_no").agg(F.count("*").alias("n"))


@query("""
SELECT s_nationkey, strftime(l_shipdate, '%Y%m') AS ship_month,
       count(*) FILTER (WHERE l_returnflag <> 'R') AS n_kept,
       count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned,
       quantile_cont(l_extendedprice / l_quantity, 0.5) FILTER (WHERE l_returnflag <> 'R') AS unit_price_median
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
GROUP BY 1, 2
""")
def monthly_unit_price_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median unit price by supplier nation and month, returned lines left out."""
    line = table(spark, sf_dir, "lineitem")
    supplier = table(spark, sf_dir, "supplier")
    kept = F.col("l_returnflag") != "R"
    month = F.date_format("l_shipdate", "yyyyMM").alias("ship_month")
    t = line.join(supplier, line.l_suppkey == supplier.s_suppkey).select("s_nationkey", month, kept.alias("kept"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    keys = ["s_nationkey", "ship_month"]
    counts = t.groupBy(*keys).agg(F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_returned"))
    return counts.join(grids.exact_median(t.where("kept"), keys, "price", 1.0, "unit_price_median"), keys, "left")


@query("""
SELECT o_orderpriority, o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS key_sum,
       min(o_orderdate) AS first_date, max(o_orderdate) AS last_date
FROM orders GROUP BY 1, 2
""")
def grouped_counts(spark, sf_dir):
    """Plain grouping: count, sum, min and max."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("key_sum"), F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"))


@query("""
WITH m AS (
  SELECT s_nationkey, strftime(l_shipdate, '%Y%m') AS ship_month,
         count(*) FILTER (WHERE l_returnflag <> 'R') AS n_kept, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
SELECT s_nationkey, ship_month, u.stat, u.value
FROM m, LATERAL (VALUES ('KEPT', n_kept), ('RETURNED', n_returned)) AS u(stat, value)
""")
def unpivot_month_series(spark, sf_dir):
    """Two measures of a month melted to (series, key, period, value) from one scan."""
    line, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    m = line.join(s, line.l_suppkey == s.s_suppkey).groupBy("s_nationkey", F.date_format("l_shipdate", "yyyyMM").alias("ship_month"))
    m = m.agg(F.count_if(F.col("l_returnflag") != "R").alias("KEPT"), F.count_if(F.col("l_returnflag") == "R").alias("RETURNED"))
    return m.unpivot(["s_nationkey", "ship_month"], ["KEPT", "RETURNED"], "stat", "value")


_MONTHS = """
o AS (SELECT c_nationkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS month_no, count(*) AS n
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
e AS (SELECT min(month_no) AS a, max(month_no) AS b FROM o)
"""


@query(f"""
WITH {_MONTHS},
g AS (SELECT n_nationkey AS c_nationkey, CAST(unnest(range(a, b + 1)) AS INTEGER) AS month_no FROM nation, e),
f AS (SELECT g.c_nationkey, g.month_no, coalesce(n, 0) AS n, month_no % 17 <> 0 AS fetched FROM g LEFT JOIN o USING (c_nationkey, month_no))
SELECT c_nationkey, month_no, n, CASE WHEN (SELECT count(*) FROM f x WHERE x.c_nationkey = f.c_nationkey AND x.fetched
              AND x.month_no BETWEEN f.month_no - 11 AND f.month_no) = 12
       THEN (SELECT CAST(sum(n) AS BIGINT) FROM f x WHERE x.c_nationkey = f.c_nationkey AND x.month_no BETWEEN f.month_no - 11 AND f.month_no) END AS n_12m
FROM f
""")
def ledger_gated_rolling_12m(spark, sf_dir):
    """12-month sums over a zero-filled grid, only where the ledger has all 12 months (every 17th is not fetched)."""
    o = _nation_months(spark, sf_dir)
    ends = o.agg(F.min("month_no").alias("a"), F.max("month_no").alias("b"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    # one row with the ends, and a dimension of fixed size
    g = grids.grid(nations.crossJoin(ends), F.col("a"), F.col("b")).drop("a", "b")
    f = grids.zero_filled(g, o, ["c_nationkey", "month_no"], ["n"]).withColumn("fetched", F.col("month_no") % 17 != 0)
    return grids.rolling(f, ["c_nationkey"], "month_no", "n", -11, 0, "n_12m", "fetched").drop("fetched")


@query(f"""
WITH {_MONTHS}
SELECT c_nationkey, month_no, (SELECT CAST(sum(x.n) AS BIGINT) FROM o x WHERE x.c_nationkey = o.c_nationkey
       AND x.month_no BETWEEN o.month_no + 1 AND o.month_no + 12) AS n_ahead
FROM o
""")
def leading_12m_sum(spark, sf_dir):
    """Sum over the 12 months ahead of each month."""
    return grids.rolling(_nation_months(spark, sf_dir), ["c_nationkey"], "month_no", "n", 1, 12, "n_ahead").drop("n")


@query("""
WITH o AS (SELECT c_nationkey, c_mktsegment, strftime(o_orderdate, '%Y%m%d') AS day, count(*) AS n
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
p AS (SELECT 'COUNT' AS stat, 'SUM' AS agg, c_nationkey, n_regionkey, day, CAST(sum(n) AS DOUBLE) AS value
      FROM o JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL
      UNION ALL
      SELECT 'SEGMENTS', 'MEAN', c_nationkey, n_regionkey, day, CAST(count(*) AS DOUBLE) FROM o JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT stat, agg, 'N' || c_nationkey AS region, day AS period, value FROM p
UNION ALL
SELECT stat, agg, 'R' || n_regionkey, day, CASE WHEN agg = 'SUM' THEN sum(value) ELSE avg(value) END
FROM p GROUP BY stat, agg, n_regionkey, day HAVING agg = 'MEAN' OR count(*) = 5
""")
def rollup_all_children(spark, sf_dir):
    """Nations' daily series rolled up to regions: sums only where all five nations have a value, means of those there."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    o = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_nationkey", F.date_format("o_orderdate", "yyyyMMdd").alias("period"), "c_mktsegment").agg(F.count("*").alias("n"))
    o = o.groupBy(F.concat(F.lit("N"), "c_nationkey").alias("region"), "period").agg(F.sum("n").cast("double").alias("COUNT"), F.count("*").cast("double").alias("SEGMENTS"))
    p = o.unpivot(["region", "period"], ["COUNT", "SEGMENTS"], "stat", "value").withColumn("agg", F.when(F.col("stat") == "COUNT", "SUM").otherwise("MEAN"))
    n = table(spark, sf_dir, "nation")
    regions = n.select(F.concat(F.lit("N"), "n_nationkey").alias("region"), F.concat(F.lit("R"), "n_regionkey").alias("parent"))
    return grids.roll_up(p, regions)


@query("""
WITH o AS (SELECT DISTINCT n_regionkey, n_nationkey, strftime(o_orderdate, '%Y%m%d') AS day
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
need AS (SELECT n_regionkey, count(*) AS k FROM nation GROUP BY 1)
SELECT o.n_regionkey, day FROM o JOIN need USING (n_regionkey) GROUP BY 1, 2, k HAVING count(*) = k
""")
def completeness_gate(spark, sf_dir):
    """Region-days on which every nation of the region has an order."""
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey")
    got = _orders(spark, sf_dir).select(F.col("c_nationkey").alias("n_nationkey"), F.date_format("o_orderdate", "yyyyMMdd").alias("day")).distinct()
    return grids.complete_groups(n, got, ["n_regionkey"], "n_nationkey", ["day"])


@query("""
SELECT c_nationkey, string_agg(o_orderkey, ',' ORDER BY o_orderdate DESC, o_orderkey) AS keys
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1
""")
def string_agg_ordered(spark, sf_dir):
    """Keys of each nation's urgent orders as one text, newest first."""
    o = _orders(spark, sf_dir).where("o_orderpriority = '1-URGENT'")
    return o.groupBy("c_nationkey").agg(F.expr("listagg(o_orderkey, ',') WITHIN GROUP (ORDER BY o_orderdate DESC, o_orderkey)").alias("keys"))


@query("""
SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS priorities,
       array_to_string(list(o_orderstatus ORDER BY o_orderdate, o_orderkey), '|') AS statuses
FROM orders GROUP BY 1
""")
def array_agg_distinct(spark, sf_dir):
    """Each customer's priorities as a sorted set, and statuses in order of the orders."""
    o = table(spark, sf_dir, "orders")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"])
    return o.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), "|").alias("priorities"), F.array_join(ordered, "|").alias("statuses"))


@query("""
SELECT c_nationkey, count(DISTINCT (o_orderpriority, o_orderstatus)) AS n_pairs, count(DISTINCT o_custkey) AS n_customers
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
""")
def tuple_count_distinct(spark, sf_dir):
    """Distinct pairs and distinct customers of each nation."""
    return _orders(spark, sf_dir).groupBy("c_nationkey").agg(F.countDistinct("o_orderpriority", "o_orderstatus").alias("n_pairs"), F.countDistinct("o_custkey").alias("n_customers"))


@query("""
WITH kinds AS (SELECT DISTINCT event_type FROM events), users AS (SELECT DISTINCT user_id FROM events),
seen AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 150)
SELECT k.event_type, count(*) AS n_users, count(s.user_id) AS n_mapped, CAST(floor(count(s.user_id) * 1000.0 / count(*) + 0.5) / 10 AS DOUBLE) AS rate
FROM kinds k CROSS JOIN users u LEFT JOIN seen s ON s.user_id = u.user_id AND s.event_type = k.event_type GROUP BY 1
""")
def mapping_rate_report(spark, sf_dir):
    """Share of users that have each kind of large event. The grid is counted, never built: its rows are all users for each kind."""
    e = table(spark, sf_dir, "events")
    seen = e.where("value > 150").groupBy("event_type").agg(F.countDistinct("user_id").alias("n_mapped"))
    users = e.agg(F.countDistinct("user_id").alias("n_users"))
    found = e.select("event_type").distinct().crossJoin(users).join(seen, "event_type", "left").fillna(0, ["n_mapped"])
    return found.withColumn("rate", F.floor(F.col("n_mapped") * 1000.0 / F.col("n_users") + 0.5) / 10)


@query("""
WITH m AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT c_mktsegment, CAST(floor(quantile_cont(n, 0.5)) AS BIGINT) AS median_n, count(*) AS customers
FROM m JOIN customer ON o_custkey = c_custkey GROUP BY 1
""")
def integer_median(spark, sf_dir):
    """Median number of orders by segment, cut to an integer."""
    m = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer")
    n = m.join(c, m.o_custkey == c.c_custkey)
    middle = grids.exact_median(n, ["c_mktsegment"], "n", 1.0).select("c_mktsegment", F.floor("median").cast("long").alias("median_n"))
    return n.groupBy("c_mktsegment").agg(F.count("*").alias("customers")).join(middle, "c_mktsegment")


@query(f"""
WITH {_MONTHS},
d AS (SELECT a.c_nationkey, CAST(a.n - b.n AS DOUBLE) AS d FROM o a JOIN o b ON a.c_nationkey = b.c_nationkey AND b.month_no = a.month_no - 1)
SELECT c_nationkey, count(*) AS n, round(avg(d), 6) AS mean_change, CASE WHEN count(*) >= 2 AND var_samp(d) > 0 THEN round(avg(d) / sqrt(var_samp(d) / count(*)), 6) END AS t,
       round(avg(CASE WHEN d < 0 THEN 1.0 ELSE 0.0 END), 6) AS negative_share
FROM d GROUP BY 1
""")
def zscore_tstat(spark, sf_dir):
    """Mean monthly change of each nation with its t statistic and the share of falls."""
    from tidewatch.operators import ordered

    d = ordered.shifted(_nation_months(spark, sf_dir), ["c_nationkey"], "month_no", "n", 1, "before").where("before is not null")
    d = d.withColumn("d", (F.col("n") - F.col("before")).cast("double"))
    return d.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean_change"), F.round(stats.t_stat(F.col("d")), 6).alias("t"), F.round(F.avg(F.when(F.col("d") < 0, 1.0).otherwise(0.0)), 6).alias("negative_share"))


@query("""
WITH m AS (SELECT o_custkey, o_orderstatus, max(CAST(o_totalprice AS DECIMAL(18, 2))) AS top, max(strftime(o_orderdate, '%Y%m')) AS month FROM orders GROUP BY 1, 2)
SELECT o_custkey, CAST(max(top) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS f_top, CAST(max(top) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE) AS o_top,
       max(month) FILTER (WHERE o_orderstatus = 'P') AS p_month
FROM m GROUP BY 1
""")
def pivot_latest_metrics(spark, sf_dir):
    """Status-wise figures of each customer side by side, from one grouping in place of three self-joins."""
    o = table(spark, sf_dir, "orders").withColumn("v", F.col("o_totalprice").cast("decimal(18,2)"))
    of = lambda s, x: F.max(F.when(F.col("o_orderstatus") == s, x))
    return o.groupBy("o_custkey").agg(of("F", F.col("v")).cast("double").alias("f_top"), of("O", F.col("v")).cast("double").alias("o_top"), of("P", F.date_format("o_orderdate", "yyyyMM")).alias("p_month"))


@query("""
SELECT u.k AS label, count(*) AS n FROM orders, LATERAL (VALUES (1, o_orderpriority), (2, o_orderstatus)) AS u(i, k) GROUP BY 1
""")
def values_histogram(spark, sf_dir):
    """Counts of two columns' values together, melted in one scan."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.explode(F.array("o_orderpriority", "o_orderstatus")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("""
WITH g AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 month)) AS DATE) AS m)
SELECT strftime(m, '%Y%m') AS month, count(o_orderkey) AS n
FROM g LEFT JOIN orders ON o_orderdate >= m AND o_orderdate < m + INTERVAL 1 month GROUP BY 1
""")
def month_axis_counts(spark, sf_dir):
    """Orders on a generated month axis, months without orders included."""
    o = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyyMM").alias("month")).agg(F.count("*").alias("n"))
    return grids.zero_filled(grids.months(spark, "199501", "200112"), o, ["month"], ["n"])


_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"


@query(f"""
WITH v AS (SELECT o_orderkey, c_nationkey, {_CENTS} AS cents FROM orders JOIN customer ON o_custkey = c_custkey),
r AS (SELECT c_nationkey, cents, row_number() OVER w - 1 AS rank, count(*) OVER (PARTITION BY c_nationkey) AS n FROM v WINDOW w AS (PARTITION BY c_nationkey ORDER BY cents)),
b AS (SELECT c_nationkey, list_sort(list_distinct(list(cents))) AS breaks FROM r, (SELECT unnest(range(1, 7)) AS i) WHERE rank = CAST(floor(i::DOUBLE / 7 * (n - 1)) AS BIGINT) GROUP BY 1)
SELECT o_orderkey, CAST(len(list_filter(breaks, lambda x: v.cents > x)) + 6 - len(breaks) AS INTEGER) AS class FROM v JOIN b ON v.c_nationkey = b.c_nationkey
""")
def seven_classes(spark, sf_dir):
    """The class of each order's amount among its nation's, seven of equal frequency, as maps are coloured."""
    c = F.col
    v = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), c("o_custkey") == c("c_custkey")).select("o_orderkey", "c_nationkey", F.round(c("o_totalprice") * 100).cast("long").alias("cents"))
    return grids.quantile_classes(v, ["c_nationkey"], "cents", 100_000.0).select("o_orderkey", c("class").cast("int").alias("class"))


@query(f"""
WITH v AS (SELECT c_custkey, c_mktsegment, c_acctbal AS v, max(abs(c_acctbal)) OVER (PARTITION BY c_mktsegment) / 3 AS s FROM customer)
SELECT c_custkey, CAST((v > -2 * s)::INT + (v > -s)::INT + (v > -s / 6)::INT + (v > s / 6)::INT + (v > s)::INT + (v > 2 * s)::INT AS INTEGER) AS class FROM v
""")
def seven_signed_classes(spark, sf_dir):
    """The class of each customer's balance around 0, by its segment's greatest."""
    return grids.signed_classes(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal").select("c_custkey", F.col("class").cast("int").alias("class"))
