"""Ordered series: latest rows, shifts by key, runs, islands, as-of joins, de-cumulation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions import status
from tidewatch.operators import ordered
from tidewatch.plans import query, table
from tidewatch.plans.aggregates import _nation_months, _orders

_MONTHS = """
o AS (SELECT c_nationkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS month_no, count(*) AS n
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
"""


@query("""
SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
""")
def latest_per_customer(spark, sf_dir):
    """Each customer's latest order."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return ordered.latest_per(o, ["o_custkey"], F.col("o_orderdate").desc(), F.col("o_orderkey").desc())


@query("""
SELECT o_orderkey, nullif(first_value(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC), o_orderkey) AS superseded_by
FROM orders
""")
def first_value_supersede(spark, sf_dir):
    """The later order of the same customer and priority that replaces each order."""
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.nullif(F.first("o_orderkey").over(w), F.col("o_orderkey")).alias("superseded_by"))


@query("""
SELECT n_nationkey, o_orderkey, CAST(rk AS INTEGER) AS place FROM (
  SELECT c_nationkey AS n_nationkey, o_orderkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC, o_orderkey) AS rk
  FROM orders JOIN customer ON o_custkey = c_custkey) WHERE rk <= 3
""")
def topk_per_group(spark, sf_dir):
    """The three largest orders of each nation."""
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = _orders(spark, sf_dir).withColumn("place", F.row_number().over(w)).where("place <= 3")
    return o.select(F.col("c_nationkey").alias("n_nationkey"), "o_orderkey", "place")


@query("""
WITH q AS (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS q FROM orders)
SELECT o_custkey, q FROM q QUALIFY dense_rank() OVER (PARTITION BY o_custkey ORDER BY q DESC) <= 8
""")
def last_n_periods(spark, sf_dir):
    """The last eight quarters in which each customer ordered."""
    q = table(spark, sf_dir, "orders").select("o_custkey", (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).alias("q")).distinct()
    return ordered.last_n(q, ["o_custkey"], "q", 8)


@query(f"""
WITH {_MONTHS},
z AS (SELECT c_nationkey, month_no, CASE WHEN month_no % 19 = 0 THEN 0 ELSE n END AS n FROM o WHERE month_no % 23 <> 0)
SELECT a.c_nationkey, a.month_no, a.n,
       CASE WHEN b.n IS NULL THEN 'MISSING' WHEN b.n = 0 AND a.n <> 0 THEN 'ZERO_DENOM' ELSE 'OK' END AS status,
       CASE WHEN b.n = 0 AND a.n = 0 THEN 0.0 WHEN b.n <> 0 THEN round((a.n - b.n) * 100.0 / b.n, 4) END AS change
FROM z a LEFT JOIN z b ON a.c_nationkey = b.c_nationkey AND b.month_no = a.month_no - 12
""")
def yoy_change_status(spark, sf_dir):
    """Change against the month 12 before, by key: gaps are MISSING and zeroes are told apart."""
    z = _nation_months(spark, sf_dir).where("month_no % 23 != 0").withColumn("n", F.expr("if(month_no % 19 = 0, 0, n)"))
    z = ordered.shifted(z, ["c_nationkey"], "month_no", "n", 12, "before").withColumn("m", status.pct_change(F.col("n"), F.col("before")))
    return z.select("c_nationkey", "month_no", "n", F.col("m.status").alias("status"), F.col("m.value").cast("double").alias("change"))


@query("""
SELECT strftime(l_shipdate, '%Y%m%d') AS day, CASE WHEN count(*) FILTER (WHERE l_linestatus = 'F') = 0 THEN 'ZERO_DENOM' ELSE 'OK' END AS status,
       round(count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F') * 100.0 / nullif(count(*) FILTER (WHERE l_linestatus = 'F'), 0), 4) AS rate
FROM lineitem GROUP BY 1
""")
def cancel_rate_guarded(spark, sf_dir):
    """Share of returned lines among each day's final ones, ZERO_DENOM on days without any."""
    d = table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyyMMdd").alias("day"))
    final = F.col("l_linestatus") == "F"
    d = d.agg(F.count_if(final & (F.col("l_returnflag") == "R")).alias("a"), F.count_if(final).alias("b"))
    d = d.withColumn("m", status.ratio(F.col("a"), F.col("b")))
    return d.select("day", F.col("m.status").alias("status"), F.col("m.value").cast("double").alias("rate"))


@query(f"""
WITH {_MONTHS},
v AS (SELECT a.c_nationkey, a.month_no, CASE WHEN a.month_no % 11 = 0 THEN NULL ELSE a.n < b.n END AS fell
      FROM o a JOIN o b ON a.c_nationkey = b.c_nationkey AND b.month_no = a.month_no - 1)
SELECT c_nationkey, month_no, CASE
  WHEN (SELECT bool_or(NOT x.fell) FROM v x WHERE x.c_nationkey = v.c_nationkey AND x.month_no BETWEEN v.month_no - 2 AND v.month_no) THEN false
  WHEN (SELECT count(*) FROM v x WHERE x.fell AND x.c_nationkey = v.c_nationkey AND x.month_no BETWEEN v.month_no - 2 AND v.month_no) = 3 THEN true END AS run
FROM v
""")
def run_test_k(spark, sf_dir):
    """Whether a nation's orders fell three months running: true, false or unknown."""
    v = ordered.shifted(_nation_months(spark, sf_dir), ["c_nationkey"], "month_no", "n", 1, "before").where("before is not null")
    v = v.withColumn("fell", F.when(F.col("month_no") % 11 != 0, F.col("n") < F.col("before")))
    return ordered.run_test(v, ["c_nationkey"], "month_no", "fell", 3).select("c_nationkey", "month_no", "run")


@query(f"""
WITH {_MONTHS},
v AS (SELECT a.c_nationkey, a.month_no, CASE WHEN a.month_no % 11 > 3 THEN a.n < b.n END AS fell
      FROM o a JOIN o b ON a.c_nationkey = b.c_nationkey AND b.month_no = a.month_no - 1)
SELECT c_nationkey, max(month_no) FILTER (WHERE fell IS NOT NULL) AS last_decided, max_by(fell, month_no) FILTER (WHERE fell IS NOT NULL) AS verdict FROM v GROUP BY 1
""")
def last_decided_period(spark, sf_dir):
    """The last month whose verdict is known, and the verdict."""
    v = ordered.shifted(_nation_months(spark, sf_dir), ["c_nationkey"], "month_no", "n", 1, "before").where("before is not null")
    v = v.withColumn("fell", F.when(F.col("month_no") % 11 > 3, F.col("n") < F.col("before"))).where("fell is not null")
    return v.groupBy("c_nationkey").agg(F.max("month_no").alias("last_decided"), F.max_by("fell", "month_no").alias("verdict"))


@query("""
SELECT o_orderkey, (CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice > 200000 END AND (CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority < '3' END
       OR CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus = 'O' END)) AS verdict FROM orders
""")
def kleene_rule(spark, sf_dir):
    """Three-valued AND and OR of conditions that are unknown for some orders."""
    a = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") > 200000)
    b = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority") < "3")
    c = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus") == "O")
    return table(spark, sf_dir, "orders").select("o_orderkey", (a & (b | c)).alias("verdict"))


@query("""
WITH q AS (SELECT o_custkey, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS q, CAST(sum(o_orderkey) AS BIGINT) AS v FROM orders GROUP BY 1, 2),
c AS (SELECT o_custkey, q, sum(v) OVER (PARTITION BY o_custkey, q // 4 ORDER BY q) AS cum FROM q)
SELECT a.o_custkey, a.q, CAST(a.cum - coalesce(b.cum, 0) AS BIGINT) AS quarter_value
FROM c a LEFT JOIN c b ON a.o_custkey = b.o_custkey AND b.q = a.q - 1 AND a.q % 4 <> 0
WHERE a.q % 4 = 0 OR b.cum IS NOT NULL
""")
def decumulate_quarters(spark, sf_dir):
    """Quarter values from totals that accumulate over a year; no row where the quarter before is absent."""
    from tidewatch.operators import statements

    q = table(spark, sf_dir, "orders").groupBy("o_custkey", (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).alias("q")).agg(F.sum("o_orderkey").alias("v"))
    w = Window.partitionBy("o_custkey", F.floor(F.col("q") / 4)).orderBy("q")
    c = q.withColumn("cum", F.sum("v").over(w))
    return statements.decumulate(c, ["o_custkey"], "q", "cum", "quarter_value").select("o_custkey", "q", "quarter_value")


@query("""
SELECT event_id, (SELECT max_by(m.event_type, m.ts) FROM events m WHERE m.user_id = e.user_id AND m.ts < e.ts AND m.event_type IN ('signup', 'error')) AS section
FROM events e
""")
def running_section(spark, sf_dir):
    """The last signup or error before each event of a user."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    marker = F.when(F.col("event_type").isin("signup", "error"), F.col("event_type"))
    return ordered.running_marker(e, ["user_id"], ["ts"], marker, "section").select("event_id", "section")


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 6 hour OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new
           FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM e)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM i GROUP BY user_id, island
""")
def episodes_gap(spark, sf_dir):
    """Errors of a user at most six hours apart as one episode."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", "ts")
    return ordered.islands(e, ["user_id"], "ts", "6 HOURS").groupBy("user_id", "island").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n")).drop("island")


@query("""
WITH s AS (SELECT user_id, ts, ts AS signup_ts, value AS signup_value FROM events WHERE event_type = 'signup')
SELECT e.event_id, s.signup_ts, s.signup_value FROM events e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.ts >= s.ts
""")
def asof_floor(spark, sf_dir):
    """Each event with the latest signup of its user up to then."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    s = e.where("event_type = 'signup'").select("user_id", "ts", F.col("ts").alias("signup_ts"), F.col("value").alias("signup_value"))
    return ordered.asof_floor(e.select("event_id", "user_id", "ts"), s, ["user_id"], "ts", ["signup_ts", "signup_value"]).select("event_id", "signup_ts", "signup_value")


@query("""
SELECT e.event_id, min(n.ts) AS next_ts, min_by(n.event_type, n.ts) AS next_type
FROM events e LEFT JOIN events n ON n.user_id = e.user_id AND n.ts > e.ts WHERE e.event_type = 'error' GROUP BY 1
""")
def asof_next(spark, sf_dir):
    """Each error with the first event of its user after it."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    n = e.select("user_id", "ts", F.col("ts").alias("next_ts"), F.col("event_type").alias("next_type"))
    return ordered.asof_next(e.where("event_type = 'error'").select("event_id", "user_id", "ts"), n, ["user_id"], "ts", ["next_ts", "next_type"]).select("event_id", "next_ts", "next_type")


_BARS = """
d AS (SELECT p_brand, CAST(l_shipdate AS DATE) AS day, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) AS price
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
b AS (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY day) - 1 AS INTEGER) AS idx FROM d)
"""


def _bars(spark, sf_dir):
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    d = l.join(p, l.l_partkey == p.p_partkey).groupBy("p_brand", F.col("l_shipdate").cast("date").alias("day"))
    d = d.agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double") / F.count("*")).alias("price"))
    return d.withColumn("idx", F.row_number().over(Window.partitionBy("p_brand").orderBy("day")) - 1)


@query(f"""
WITH {_BARS},
r AS (SELECT a.p_brand, a.day, x.day AS out_day, x.price / a.price - 1 AS ret FROM b a JOIN b x ON x.p_brand = a.p_brand AND x.idx = a.idx + 20),
t AS (SELECT day, out_day, count(*) AS n, sum(ret) AS s FROM r GROUP BY 1, 2)
SELECT p_brand, r.day, round(ret, 6) AS ret, n - 1 AS peers, round(CASE WHEN n > 1 THEN ret - (s - ret) / (n - 1) END, 6) AS excess
FROM r JOIN t ON r.day = t.day AND r.out_day = t.out_day
""")
def bar_returns_excess(spark, sf_dir):
    """Return over 20 bars less the mean of the others with the same entry and exit day; peers are summed, not paired."""
    w = Window.partitionBy("p_brand").orderBy("idx").rangeBetween(20, 20)
    r = _bars(spark, sf_dir).withColumn("out_day", F.first("day").over(w)).withColumn("out", F.first("price").over(w)).where("out is not null")
    r = r.withColumn("ret", F.col("out") / F.col("price") - 1)
    t = r.groupBy("day", "out_day").agg(F.count("*").alias("n"), F.sum("ret").alias("s"))
    r = r.join(t, ["day", "out_day"])
    excess = F.when(F.col("n") > 1, F.col("ret") - (F.col("s") - F.col("ret")) / (F.col("n") - 1))
    return r.select("p_brand", "day", F.round("ret", 6).alias("ret"), (F.col("n") - 1).alias("peers"), F.round(excess, 6).alias("excess"))


@query(f"""
WITH {_BARS}
SELECT a.p_brand, a.day, coalesce(bool_or(abs(x.price - a.price) / a.price > 0.9), false) AS broken
FROM b a LEFT JOIN b x ON x.p_brand = a.p_brand AND x.idx BETWEEN a.idx + 1 AND a.idx + 5 GROUP BY 1, 2
""")
def share_break(spark, sf_dir):
    """Whether a brand's level moves by more than 90 % within the next five bars."""
    return ordered.any_break(_bars(spark, sf_dir), ["p_brand"], "idx", "price", 5, 0.9).select("p_brand", "day", "broken")


@query(f"""
WITH {_BARS}, n AS (SELECT p_brand, count(*) AS n FROM b GROUP BY 1)
SELECT p_brand, a.idx, round(x.price / a.price - 1, 6) AS ret FROM b a JOIN b x USING (p_brand) WHERE a.idx % 20 = 0 AND x.idx = a.idx + 20
""")
def tiled_baseline(spark, sf_dir):
    """Returns over every 20th bar: a baseline without overlaps."""
    w = Window.partitionBy("p_brand").orderBy("idx").rangeBetween(20, 20)
    b = _bars(spark, sf_dir).withColumn("out", F.first("price").over(w)).where("idx % 20 = 0 AND out is not null")
    return b.select("p_brand", "idx", F.round(F.col("out") / F.col("price") - 1, 6).alias("ret"))


@query("""
WITH RECURSIVE b AS (SELECT user_id, event_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS entry, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events WHERE event_type = 'error'),
g AS (SELECT user_id, event_id, k, true AS used, entry + 24 AS free FROM b WHERE k = 1
      UNION ALL
      SELECT b.user_id, b.event_id, b.k, b.entry >= g.free, CASE WHEN b.entry >= g.free THEN b.entry + 24 ELSE g.free END FROM g JOIN b ON b.user_id = g.user_id AND b.k = g.k + 1)
SELECT event_id, used FROM g
""")
def greedy_overlap(spark, sf_dir):
    """Errors of a user that count when each that counts shuts out the next 24 hours."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", "event_id", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("entry"), F.date_format("ts", "yyyyMMddHHmmss.SSSSSS").alias("at"))
    return ordered.greedy_non_overlap(e, ["user_id"], "entry", 24, ["at"]).select("event_id", "used")
