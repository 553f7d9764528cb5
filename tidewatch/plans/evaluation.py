"""Evaluation on the test tables: episodes, precision with intervals, base rates, event studies."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tidewatch.functions import stats
from tidewatch.operators import evaluate
from tidewatch.plans import query, table
from tidewatch.plans.series import _BARS, _bars

#: The first day of orders, the last that is observed, and the horizon in months.
_FROM, _TO, _H = datetime.date(1995, 1, 1), datetime.date(2001, 6, 30), 12


def _signals(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return o.select(F.substring("o_orderpriority", 1, 1).alias("rule_code"), F.col("o_custkey").alias("corp_code"), F.to_date("o_orderdate").alias("date"))


def _events(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P' AND o_orderdate >= '1996-01-01'").select(F.col("o_custkey").alias("corp_code"), F.to_date("o_orderdate").alias("date"))


_EPISODES = """
s0 AS (SELECT o_orderpriority[1] AS rule_code, o_custkey AS corp_code, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderstatus = 'O'),
s AS (SELECT DISTINCT * FROM (SELECT * FROM s0 UNION ALL SELECT 'ANY', corp_code, date FROM s0)),
g AS (SELECT *, CASE WHEN date <= lag(date) OVER (PARTITION BY rule_code, corp_code ORDER BY date) + 200 THEN 0 ELSE 1 END AS new FROM s),
i AS (SELECT *, sum(new) OVER (PARTITION BY rule_code, corp_code ORDER BY date) AS island FROM g),
p AS (SELECT rule_code, corp_code, min(date) AS start, max(date) AS last, count(*) AS n FROM i GROUP BY rule_code, corp_code, island),
ev AS (SELECT o_custkey AS corp_code, min(CAST(o_orderdate AS DATE)) AS event_date FROM orders WHERE o_orderstatus = 'P' AND o_orderdate >= '1996-01-01' GROUP BY 1),
j AS (SELECT p.*, event_date, CASE WHEN event_date <= start THEN 'AFTER_EVENT' WHEN event_date <= last + INTERVAL 12 month THEN 'HIT'
             WHEN last + INTERVAL 12 month > DATE '2001-06-30' THEN 'PENDING' ELSE 'MISS' END AS outcome FROM p LEFT JOIN ev USING (corp_code))
"""


@query(f"WITH {_EPISODES} SELECT rule_code, corp_code, start, last, n, outcome, CASE WHEN outcome = 'HIT' THEN date_diff('day', start, event_date) END AS lead FROM j")
def episode_judge(spark, sf_dir):
    """Episodes of signals judged against each company's first event."""
    e = evaluate.judged(evaluate.episodes(_signals(spark, sf_dir)), _events(spark, sf_dir), _H, _TO)
    return e.select("rule_code", "corp_code", "start", "last", "n", "outcome", F.col("lead").cast("long").alias("lead"))


@query(f"""
WITH {_EPISODES},
c AS (SELECT rule_code, count(*) FILTER (WHERE outcome = 'HIT') AS x, count(*) FILTER (WHERE outcome IN ('HIT', 'MISS')) AS n, CAST(floor(quantile_cont(CASE WHEN outcome = 'HIT' THEN date_diff('day', start, event_date) END, 0.5)) AS BIGINT) AS median_lead FROM j GROUP BY 1)
SELECT rule_code, x AS hits, n AS tried, median_lead,
       round(greatest(0, (x / n + 3.841458881296 / (2 * n) - 1.959964 * sqrt(x / n * (1 - x / n) / n + 3.841458881296 / (4 * n * n))) / (1 + 3.841458881296 / n)), 6) AS low,
       round(least(1, (x / n + 3.841458881296 / (2 * n) + 1.959964 * sqrt(x / n * (1 - x / n) / n + 3.841458881296 / (4 * n * n))) / (1 + 3.841458881296 / n)), 6) AS high
FROM c WHERE n > 0
""")
def wilson_interval(spark, sf_dir):
    """Precision of each rule with its interval, and the median lead of its hits."""
    e = evaluate.judged(evaluate.episodes(_signals(spark, sf_dir)), _events(spark, sf_dir), _H, _TO)
    c = e.groupBy("rule_code").agg(F.count_if(F.col("outcome") == "HIT").alias("hits"), F.count_if(F.col("outcome").isin("HIT", "MISS")).alias("tried"), stats.int_median(F.col("lead")).alias("median_lead")).where("tried > 0")
    ci = stats.wilson(F.col("hits"), F.col("tried"))
    return c.select("rule_code", "hits", "tried", "median_lead", F.round(ci["low"], 6).alias("low"), F.round(ci["high"], 6).alias("high"))


@query("""
WITH ev AS (SELECT o_custkey AS corp_code, min(CAST(o_orderdate AS DATE)) AS event_date FROM orders WHERE o_orderstatus = 'P' AND o_orderdate >= '1996-01-01' GROUP BY 1),
d AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-06-30', INTERVAL 3 month)) AS DATE) AS dt),
g AS (SELECT dt, event_date FROM customer CROSS JOIN d LEFT JOIN ev ON corp_code = c_custkey WHERE dt + INTERVAL 12 month <= DATE '2001-06-30' AND (event_date IS NULL OR event_date > dt))
SELECT count(*) AS samples, count(*) FILTER (WHERE event_date <= dt + INTERVAL 12 month) AS hits, round(count(*) FILTER (WHERE event_date <= dt + INTERVAL 12 month) / count(*), 9) AS rate FROM g
""")
def base_rate_grid(spark, sf_dir):
    """How often an event follows within a year, over all companies and quarters."""
    corps = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("corp_code"))
    return evaluate.base_rate(corps, _events(spark, sf_dir), _FROM, _TO, _H).withColumn("rate", F.round("rate", 9))


_CATCHES = """
b AS (SELECT i.rule_code, corp_code, date, event_date FROM i JOIN ev USING (corp_code) WHERE date < event_date),
k AS (SELECT *, CASE WHEN date <= lag(date) OVER (PARTITION BY rule_code, corp_code ORDER BY date) + 200 THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT * FROM b)),
m AS (SELECT *, sum(new) OVER (PARTITION BY rule_code, corp_code ORDER BY date) AS isle FROM k),
l AS (SELECT rule_code, corp_code, isle, min(date) AS first_signal, max(date) AS last_signal FROM m GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY rule_code, corp_code ORDER BY isle DESC) = 1),
r AS (SELECT rule_code, min(date) AS observed_from FROM s GROUP BY 1),
h AS (SELECT r.rule_code, ev.corp_code, event_date, date_diff('day', observed_from, event_date) >= 90 AS evaluable, coalesce(last_signal >= event_date - INTERVAL 12 month, false) AS caught,
             CASE WHEN last_signal >= event_date - INTERVAL 12 month THEN first_signal END AS first_signal
      FROM r CROSS JOIN ev LEFT JOIN l ON l.rule_code = r.rule_code AND l.corp_code = ev.corp_code)
"""
_BASE = """
d AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-06-30', INTERVAL 3 month)) AS DATE) AS dt),
q AS (SELECT dt, event_date FROM customer CROSS JOIN d LEFT JOIN ev ON corp_code = c_custkey WHERE dt + INTERVAL 12 month <= DATE '2001-06-30' AND (event_date IS NULL OR event_date > dt)),
base AS (SELECT count(*) FILTER (WHERE event_date <= dt + INTERVAL 12 month) / count(*) AS rate FROM q)
"""


def _wilson(x: str, n: str) -> tuple[str, str]:
    """SQL of both ends of the interval."""
    centre, half = f"{x} / {n} + 3.841458881296 / (2 * {n})", f"1.959964 * sqrt({x} / {n} * (1 - {x} / {n}) / {n} + 3.841458881296 / (4 * {n} * {n}))"
    return tuple(f"CASE WHEN {n} > 0 THEN round({edge}, 6) END" for edge in (f"greatest(0, ({centre} - {half}) / (1 + 3.841458881296 / {n}))", f"least(1, ({centre} + {half}) / (1 + 3.841458881296 / {n}))"))


@query(f"WITH {_EPISODES}, {_CATCHES} SELECT * FROM h")
def event_catches(spark, sf_dir):
    """Which events each rule warned of in the year before, and since when."""
    s = _signals(spark, sf_dir)
    starts = s.unionByName(s.withColumn("rule_code", F.lit(evaluate.ANY))).groupBy("rule_code").agg(F.min("date").alias("observed_from"))
    return evaluate.caught(s, _events(spark, sf_dir), starts, _H)


def _scores(spark, sf_dir):
    s, e = _signals(spark, sf_dir), _events(spark, sf_dir)
    starts = s.unionByName(s.withColumn("rule_code", F.lit(evaluate.ANY))).groupBy("rule_code").agg(F.min("date").alias("observed_from"))
    corps = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("corp_code"))
    return evaluate.scores(evaluate.judged(evaluate.episodes(s), e, _H, _TO), evaluate.caught(s, e, starts, _H), evaluate.base_rate(corps, e, _FROM, _TO, _H))


_P, _R = _wilson("hits", "(hits + misses)"), _wilson("n_caught", "events")


@query(f"""
WITH {_EPISODES}, {_CATCHES}, {_BASE},
x AS (SELECT rule_code, count(*) FILTER (outcome = 'HIT') AS hits, count(*) FILTER (outcome = 'MISS') AS misses, count(*) FILTER (outcome = 'PENDING') AS pending, count(*) FILTER (outcome = 'AFTER_EVENT') AS after,
             CAST(floor(quantile_cont(CASE WHEN outcome = 'HIT' THEN date_diff('day', start, event_date) END, 0.5)) AS BIGINT) AS median_lead FROM j GROUP BY 1),
y AS (SELECT rule_code, count(*) AS events, count(*) FILTER (caught) AS n_caught FROM h WHERE evaluable GROUP BY 1),
z AS (SELECT rule_code, coalesce(hits, 0) AS hits, coalesce(misses, 0) AS misses, coalesce(pending, 0) AS pending, coalesce(after, 0) AS after, median_lead,
             coalesce(events, 0) AS events, coalesce(n_caught, 0) AS n_caught FROM x FULL JOIN y USING (rule_code))
SELECT z.*, round(rate, 9) AS rate, CASE WHEN hits + misses > 0 THEN round(hits / (hits + misses), 9) END AS precision, CASE WHEN events > 0 THEN round(n_caught / events, 9) END AS recall,
       {_P[0]} AS precision_low, {_P[1]} AS precision_high, {_R[0]} AS recall_low, {_R[1]} AS recall_high,
       CASE WHEN hits + misses > 0 AND rate > 0 THEN round(hits / (hits + misses) / rate, 6) END AS lift
FROM z CROSS JOIN base
""")
def rule_scores(spark, sf_dir):
    """Precision, recall, lift and lead of every rule."""
    t = _scores(spark, sf_dir)
    ends = [F.round(f"{k}_ci.{end}", 6).alias(f"{k}_{end}") for k in ("precision", "recall") for end in ("low", "high")]
    return t.select(
        "rule_code", "hits", "misses", "pending", "after", "median_lead", "events", "n_caught", F.round("rate", 9).alias("rate"),
        F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), *ends, F.round("lift", 6).alias("lift"),
    )


_STUDY = f"""
WITH RECURSIVE {_BARS.strip().removeprefix("WITH")},
x AS (SELECT a.p_brand, a.day, a.idx, o.day AS exit, o.price / a.price - 1 AS ret FROM b a LEFT JOIN b o ON o.p_brand = a.p_brand AND o.idx = a.idx + 20),
t AS (SELECT day, exit, count(*) AS n, sum(ret) AS s FROM x WHERE exit IS NOT NULL GROUP BY 1, 2),
f AS (SELECT p_brand, min(day) AS first FROM b GROUP BY 1),
e AS (SELECT DISTINCT p_brand AS stock, CAST(l_shipdate AS DATE) AS date FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_discount > 0.09),
a AS (SELECT e.stock, e.date, x.day AS entry, x.idx, x.exit, x.ret FROM e ASOF LEFT JOIN x ON x.p_brand = e.stock AND e.date < x.day),
c AS (SELECT a.*, t.s, CASE WHEN first IS NULL OR first > date THEN 'NO_PRICE' WHEN a.exit IS NULL THEN 'HORIZON_NOT_ELAPSED' END AS early, coalesce(n, 0) - 1 AS others
      FROM a LEFT JOIN f ON f.p_brand = a.stock LEFT JOIN t ON t.day = a.entry AND t.exit = a.exit),
p AS (SELECT *, CASE WHEN early IS NULL THEN others END AS peers, CASE WHEN early IS NULL AND others < 5 THEN 'NO_BENCHMARK' END AS late FROM c),
q AS (SELECT stock, date, idx, row_number() OVER (PARTITION BY stock ORDER BY date) AS k FROM p WHERE early IS NULL AND late IS NULL),
g AS (SELECT stock, date, idx, k, true AS used, idx + 20 AS free FROM q WHERE k = 1
      UNION ALL
      SELECT q.stock, q.date, q.idx, q.k, q.idx >= g.free, CASE WHEN q.idx >= g.free THEN q.idx + 20 ELSE g.free END FROM g JOIN q ON q.stock = g.stock AND q.k = g.k + 1),
w AS (SELECT p.*, max(CASE WHEN used THEN p.idx + 20 END) OVER (PARTITION BY p.stock ORDER BY p.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM p LEFT JOIN g ON g.stock = p.stock AND g.date = p.date),
v AS (SELECT *, coalesce(early, CASE WHEN idx < busy THEN 'OVERLAP' END, late, 'USED') AS status FROM w)
"""


@query(f"""
{_STUDY}
SELECT stock || '|' || date AS id, 'RETURN' AS rule_code, stock, date, status, entry, exit, CASE WHEN status = 'USED' THEN round(ret, 6) END AS ret,
       CASE WHEN status = 'USED' THEN round((s - ret) / peers, 6) END AS bench, CASE WHEN status = 'USED' THEN round(ret - (s - ret) / peers, 6) END AS excess, peers
FROM v
""")
def event_study_20(spark, sf_dir):
    """Brands' prices after dated events against their peers; share changes are tested on small cases."""
    return _study(spark, sf_dir).withColumns({k: F.round(k, 6) for k in ("ret", "bench", "excess")})


def _study(spark, sf_dir):
    b = _bars(spark, sf_dir).select(F.col("p_brand").alias("stock"), "day", "price", F.lit(100.0).alias("shares"))
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    e = l.where("l_returnflag = 'R' AND l_discount > 0.09").join(p, l.l_partkey == p.p_partkey).select(F.col("p_brand").alias("stock"), F.col("l_shipdate").cast("date").alias("date")).distinct()
    e = e.withColumn("id", F.concat_ws("|", "stock", F.col("date").cast("string"))).withColumn("rule_code", F.lit("RETURN"))
    return evaluate.event_study(e, b, 20)


@query(f"""
{_STUDY}, n AS (SELECT ret - (s - ret) / peers AS x FROM v WHERE status = 'USED')
SELECT 'RETURN' AS rule_code, count(*) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(avg(x) / sqrt(var_samp(x) / count(*)), 4) AS t, round(avg((x < 0)::INT), 6) AS negative_share
FROM n HAVING count(*) > 1
""")
def event_study_stats(spark, sf_dir):
    """Mean, median and t statistic of what the events' stocks did beyond their peers."""
    t = evaluate.study_stats(_study(spark, sf_dir))
    return t.withColumns({k: F.round(k, 6) for k in ("mean", "median", "negative_share")} | {"t": F.round("t", 4)})


@query(f"""
WITH {_EPISODES}, {_CATCHES}, {_BASE},
x AS (SELECT rule_code, count(*) FILTER (outcome = 'HIT') AS hits, count(*) FILTER (outcome IN ('HIT', 'MISS')) AS tried FROM j GROUP BY 1)
SELECT rule_code, hits, tried, {_wilson("hits", "tried")[0]} AS low, round(hits / tried / rate, 6) AS lift FROM x CROSS JOIN base WHERE tried > 0 ORDER BY 4 DESC, 5 DESC, 1 LIMIT 1
""")
def best_rule(spark, sf_dir):
    """The rule whose precision is highest at the lower end of its interval: a top-1 report."""
    b = evaluate.best_rule(_scores(spark, sf_dir))
    return b.select("rule_code", "hits", (F.col("hits") + F.col("misses")).alias("tried"), F.round("precision_ci.low", 6).alias("low"), F.round("lift", 6).alias("lift"))
