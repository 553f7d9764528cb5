"""Joins: semi, anti, lateral, range, OR, unique candidate, optional predicates, paging and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import grids, joins, ordered
from tidewatch.plans import query, table
from tidewatch.plans.aggregates import _orders


@query("""
SELECT c_custkey, c_name, l.o_orderkey AS last_order FROM customer
LEFT JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k
           FROM orders WHERE o_orderstatus = 'P') l ON o_custkey = c_custkey AND k = 1
""")
def latest_left_lateral(spark, sf_dir):
    """Every customer with the latest of its orders of status P, if any: aggregated before the join."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return c.join(o, c.c_custkey == o.o_custkey, "left").drop("o_custkey")


@query("""
SELECT c_custkey, y FROM customer, range(1995, 2002) t(y)
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = y)
""")
def anti_pending_grid(spark, sf_dir):
    """Customer-years without an order: the expected grid less the ledger."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    g = grids.grid(c, F.lit(1995).cast("long"), F.lit(2001).cast("long"), "y")
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").cast("long").alias("y"))
    return joins.pending(g, done, ["c_custkey", "y"])


@query("""
SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders f WHERE f.o_custkey = c_custkey AND f.o_orderstatus = 'F'
  AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o.o_orderstatus = 'O' AND o.o_orderdate > f.o_orderdate))
""")
def nested_not_exists(spark, sf_dir):
    """Customers all of whose F orders are followed by an O order; for that the last of each is enough."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("f"), F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate"))).alias("o"))
    bad = o.where("f is not null AND (o is null OR o <= f)").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(bad, "c_custkey", "left_anti")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_exists(spark, sf_dir):
    """Customers with an urgent order."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    c = table(spark, sf_dir, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_mktsegment")


@query("""
SELECT o.o_orderkey, max(c.o_orderkey) AS corrected_by FROM orders o JOIN orders c
  ON c.o_custkey = o.o_custkey AND c.o_orderkey > o.o_orderkey AND c.o_orderdate BETWEEN o.o_orderdate AND o.o_orderdate + INTERVAL 30 day
 AND (c.o_orderpriority = o.o_orderpriority OR c.o_orderstatus = o.o_orderstatus) GROUP BY 1
""")
def range_self_join_correction(spark, sf_dir):
    """The last order that corrects another: same customer, within 30 days, same priority or status."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    same = (F.col("l_o_orderpriority") == F.col("r_o_orderpriority")) | (F.col("l_o_orderstatus") == F.col("r_o_orderstatus"))
    pairs = joins.within_days(o, o, ["o_custkey"], "o_orderdate", 30, (F.col("r_o_orderkey") > F.col("l_o_orderkey")) & same)
    return pairs.groupBy(F.col("l_o_orderkey").alias("o_orderkey")).agg(F.max("r_o_orderkey").alias("corrected_by"))


@query("""
SELECT DISTINCT a.o_orderkey AS l_o_orderkey, b.o_orderkey AS r_o_orderkey FROM orders a JOIN orders b
  ON ((a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority)
   OR (a.o_custkey = b.o_custkey AND year(a.o_orderdate) * 12 + month(a.o_orderdate) = year(b.o_orderdate) * 12 + month(b.o_orderdate)))
WHERE a.o_orderkey < b.o_orderkey
""")
def or_join_union(spark, sf_dir):
    """Pairs of a customer's orders with equal priority or equal month, by one equi-join each."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m"))
    return joins.either(o, o, [["o_custkey", "o_orderpriority"], ["o_custkey", "m"]], ["o_orderkey"], F.col("l_o_orderkey") < F.col("r_o_orderkey"))


@query("""
WITH one AS (SELECT p_brand, p_size, min(p_partkey) AS k FROM part WHERE p_retailprice > 1500 GROUP BY 1, 2 HAVING count(*) = 1)
SELECT p_partkey, k AS match FROM part LEFT JOIN one USING (p_brand, p_size)
""")
def unique_candidate_link(spark, sf_dir):
    """Each part with the one dear part of its brand and size, null where there is none or a choice."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return joins.unique_candidate(p, p.where("p_retailprice > 1500"), ["p_brand", "p_size"], "p_partkey", "match").select("p_partkey", "match")


#: Owner, wanted statuses (null: all), wanted segment (null: all), least price.
_SUBSCRIPTIONS = [("a", None, None, 440000.0), ("b", ["F", "P"], "BUILDING", 300000.0), ("c", ["O"], None, 430000.0)]


@query("""
WITH s(owner, statuses, segment, least) AS (VALUES ('a', NULL, NULL, 440000.0), ('b', ['F', 'P'], 'BUILDING', 300000.0), ('c', ['O'], NULL, 430000.0))
SELECT owner, o_orderkey FROM s JOIN (orders JOIN customer ON o_custkey = c_custkey)
  ON o_totalprice >= least AND (statuses IS NULL OR list_contains(statuses, o_orderstatus)) AND (segment IS NULL OR segment = c_mktsegment)
""")
def theta_subscriptions(spark, sf_dir):
    """Orders that subscriptions ask for, by optional predicates; there are as many subscriptions as people enter."""
    s = spark.createDataFrame(_SUBSCRIPTIONS, "owner string, statuses array<string>, segment string, least double")
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    o = o.join(c, o.o_custkey == c.c_custkey)
    on = (F.col("o_totalprice") >= F.col("least")) & (F.col("statuses").isNull() | F.array_contains("statuses", F.col("o_orderstatus"))) & (F.col("segment").isNull() | (F.col("segment") == F.col("c_mktsegment")))
    return o.join(F.broadcast(s), on).select("owner", "o_orderkey")


@query("""
SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus IN ('F', 'O') AND c_mktsegment = 'BUILDING' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40
""")
def filter_paging(spark, sf_dir):
    """A page of a filtered, ordered list, a filter that is not given left out."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    o = joins.optional(o.join(c, o.o_custkey == c.c_custkey), o_orderstatus=["F", "O"], c_mktsegment="BUILDING", o_orderpriority=None)
    return joins.page(o.select("o_orderkey", "o_totalprice", "o_orderstatus"), [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")], page=2)


@query("""
SELECT o_orderkey, o_orderpriority FROM orders
ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END DESC, o_totalprice DESC, o_orderkey LIMIT 24
""")
def custom_order_topk(spark, sf_dir):
    """The first 24 orders by the rank of their priority."""
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(1)
    return table(spark, sf_dir, "orders").orderBy(rank.desc(), F.desc("o_totalprice"), "o_orderkey").limit(24).select("o_orderkey", "o_orderpriority")


@query(r"""
SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%re%' ESCAPE '\' ORDER BY (p_name ILIKE 're%' ESCAPE '\') DESC, length(p_name), p_name, p_partkey LIMIT 6
""")
def search_rank(spark, sf_dir):
    """The best six names that contain a text, those that start with it first."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    hit = p.where(F.col("p_name").ilike("%re%"))
    return hit.orderBy(F.col("p_name").ilike("re%").desc(), F.length("p_name"), "p_name", "p_partkey").limit(6)


@query("""
WITH wanted AS (SELECT DISTINCT p_brand, hint FROM part, (VALUES ('^(small|large) '), ('bolt$'), ('^none$')) h(hint)),
found AS (SELECT w.p_brand, hint, p_name, max(p_partkey) AS p_partkey FROM wanted w JOIN part p ON p.p_brand = w.p_brand WHERE regexp_matches(p_name, hint) GROUP BY ALL)
SELECT p_brand, hint, p_name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, hint ORDER BY p_name) AS k FROM found) WHERE k <= 6
""")
def name_candidates(spark, sf_dir):
    """Up to six names for each brand and pattern, each with its latest part: what an unmapped account might be called."""
    p = table(spark, sf_dir, "part")
    hints = spark.createDataFrame([("^(small|large) ",), ("bolt$",), ("^none$",)], "hint string")
    return joins.candidates(p.select("p_brand").distinct().crossJoin(F.broadcast(hints)), p, ["p_brand"], "p_name", "hint", "p_partkey")


@query("""
WITH o AS (SELECT o_custkey, count(*) AS n_orders, max(o_orderdate) AS last_order FROM orders GROUP BY 1),
f AS (SELECT o_custkey, count(*) AS n_final FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
l AS (SELECT o_custkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1)
SELECT c_custkey, n_name, coalesce(n_orders, 0) AS n_orders, last_order, coalesce(n_final, 0) AS n_final, coalesce(quantity, 0) AS returned,
       CASE WHEN n_orders > 0 THEN round(coalesce(n_final, 0) * 100.0 / n_orders, 6) END AS final_share
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN f ON f.o_custkey = c_custkey LEFT JOIN l ON l.o_custkey = c_custkey
""")
def exposure_table(spark, sf_dir):
    """One row for each customer from branches that are grouped before they are joined."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    per = o.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.max("o_orderdate").alias("last_order"), F.count_if(F.col("o_orderstatus") == "F").alias("n_final"))
    r = line.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.sum(F.round("l_quantity").cast("long")).alias("q"))
    r = r.join(o.select("o_orderkey", "o_custkey"), r.l_orderkey == o.o_orderkey).groupBy("o_custkey").agg(F.sum("q").alias("returned"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    t = c.join(n, c.c_nationkey == n.n_nationkey).join(per.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left").join(r.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
    t = t.fillna(0, ["n_orders", "n_final", "returned"])
    share = F.when(F.col("n_orders") > 0, F.round(F.col("n_final") * 100.0 / F.col("n_orders"), 6))
    return t.select("c_custkey", "n_name", "n_orders", "last_order", "n_final", "returned", share.alias("final_share"))


@query("""
SELECT o.o_orderkey, coalesce(c.c_name, n.n_name) AS target_name
FROM orders o LEFT JOIN customer c ON o.o_orderkey % 2 = 0 AND c.c_custkey = o.o_custkey
LEFT JOIN nation n ON o.o_orderkey % 2 = 1 AND n.n_nationkey = o.o_custkey % 25
""")
def name_by_type(spark, sf_dir):
    """A target's name looked up in one of two dimensions, by its type."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("C"), "o_custkey")).otherwise(F.concat(F.lit("N"), F.col("o_custkey") % 25)).alias("key"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("key"), F.col("c_name").alias("target_name"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("key"), F.col("n_name").alias("target_name"))
    return o.join(c.unionByName(n), "key", "left").select("o_orderkey", "target_name")


@query("""
SELECT n_name, count(DISTINCT s_suppkey) AS n_suppliers, count(DISTINCT c_custkey) AS n_customers, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1
""")
def scalar_subqueries(spark, sf_dir):
    """Counts and lists that would be correlated subqueries, grouped first."""
    n, s, c = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    s = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_suppliers"))
    c = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_customers"), F.array_join(F.sort_array(F.collect_set("c_mktsegment")), ",").alias("segments"))
    t = n.join(s, "n_nationkey", "left").join(c, "n_nationkey", "left").fillna(0, ["n_suppliers", "n_customers"])
    return t.select("n_name", "n_suppliers", "n_customers", "segments")


@query("""
SELECT s_suppkey, strftime(o_orderdate, '%Y') AS y, count(DISTINCT o_orderkey) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0 AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 60 day GROUP BY 1, 2
""")
def dated_star_join(spark, sf_dir):
    """Facts joined on keys with a window of dates as the residue."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey")
    t = l.join(s, l.l_suppkey == s.s_suppkey).join(o, (l.l_orderkey == o.o_orderkey) & l.l_shipdate.between(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")))
    return t.groupBy("s_suppkey", F.date_format("o_orderdate", "yyyy").alias("y")).agg(F.countDistinct("o_orderkey").alias("n"))
