"""Grading alerts afterwards: episodes against credit events, and event studies against peers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import periods, stats
from tidewatch.operators import grids, ordered

#: Days between signals up to which they are one episode, and days a company has to be observed before its event.
GAP_DAYS, LEAST_OBSERVED = 200, 90
#: Rule under which all signals of a company count together.
ANY = "ANY"


def first_events(events: DataFrame) -> DataFrame:
    """(corp_code, event_date): each company's first credit event."""
    return events.groupBy("corp_code").agg(F.min("date").alias("event_date"))


def episodes(signals: DataFrame) -> DataFrame:
    """(rule_code, corp_code, start, last, n): signals at most GAP_DAYS apart; those of all rules also as ANY."""
    s = signals.select("rule_code", "corp_code", "date")
    s = s.unionByName(s.withColumn("rule_code", F.lit(ANY))).distinct()
    i = ordered.islands(s, ["rule_code", "corp_code"], "date", f"{GAP_DAYS} DAYS")
    return i.groupBy("rule_code", "corp_code", "island").agg(F.min("date").alias("start"), F.max("date").alias("last"), F.count("*").alias("n")).drop("island")


def judged(found: DataFrame, events: DataFrame, months: int, observed_to: date) -> DataFrame:
    """Episodes with outcome (AFTER_EVENT, HIT, PENDING, MISS, in this order) and lead in days."""
    e = found.join(first_events(events), "corp_code", "left")
    deadline = F.add_months("last", months)
    outcome = (
        F.when(F.col("event_date") <= F.col("start"), "AFTER_EVENT").when(F.col("event_date") <= deadline, "HIT")
        .when(deadline > F.lit(observed_to), "PENDING").otherwise("MISS")
    )
    return e.withColumn("outcome", outcome).withColumn("lead", F.when(F.col("outcome") == "HIT", F.date_diff("event_date", "start")))


def caught(signals: DataFrame, events: DataFrame, starts: DataFrame, months: int) -> DataFrame:
    """(rule_code, corp_code, event_date, evaluable, caught, first_signal) of each event and rule.

    ``starts``: rule_code, observed_from. An event counts if the rule was observed long enough before it;
    it is caught by a signal in the months before it, and the warning began where that island did.
    """
    s = signals.select("rule_code", "corp_code", "date")
    s = s.unionByName(s.withColumn("rule_code", F.lit(ANY))).distinct()
    ev = first_events(events)
    grid = starts.crossJoin(ev)  # one row for each rule: a dictionary
    before = s.join(ev, "corp_code").where("date < event_date")
    i = ordered.islands(before, ["rule_code", "corp_code"], "date", f"{GAP_DAYS} DAYS")
    last = i.groupBy("rule_code", "corp_code", "island").agg(F.min("date").alias("first_signal"), F.max("date").alias("_last"))
    last = ordered.latest_per(last, ["rule_code", "corp_code"], F.col("island").desc()).drop("island")
    out = grid.join(last, ["rule_code", "corp_code"], "left")
    hit = F.coalesce(F.col("_last") >= F.add_months("event_date", -months), F.lit(False))
    evaluable = F.date_diff("event_date", "observed_from") >= LEAST_OBSERVED
    return out.select("rule_code", "corp_code", "event_date", evaluable.alias("evaluable"), hit.alias("caught"), F.when(hit, F.col("first_signal")).alias("first_signal"))


def base_rate(corps: DataFrame, events: DataFrame, first: date, last: date, months: int, step: int = 3) -> DataFrame:
    """One row (samples, hits, rate): over a grid of dates, how often an event follows within the horizon.

    Companies whose event is over are left out. The dates follow each other, so one that was cut to a
    shorter month stays cut. Each company's grid is exploded where it is; nothing is joined to it.
    """
    dates = [d for d in periods.iterated_grid(first, last, step) if d <= last]
    c = corps.select("corp_code").distinct().join(first_events(events), "corp_code", "left")
    g = c.withColumn("at", F.explode(F.array(*[F.lit(d) for d in dates])) if dates else F.lit(None).cast("date")).where("at is not null")
    g = g.where(F.add_months("at", months) <= F.lit(last)).where("event_date is null OR event_date > at")
    hit = F.count_if(F.col("event_date") <= F.add_months("at", months))
    return g.agg(F.count("*").alias("samples"), hit.alias("hits")).withColumn("rate", F.when(F.col("samples") > 0, F.col("hits") / F.col("samples")))


def scores(judged_: DataFrame, caught_: DataFrame, base: DataFrame) -> DataFrame:
    """One row for each rule: hits, misses, pending, precision, recall with their intervals, lift, median lead."""
    n = lambda k: F.count_if(F.col("outcome") == k)
    p = judged_.groupBy("rule_code").agg(n("HIT").alias("hits"), n("MISS").alias("misses"), n("PENDING").alias("pending"), n("AFTER_EVENT").alias("after"), stats.int_median(F.col("lead")).alias("median_lead"))
    r = caught_.where("evaluable").groupBy("rule_code").agg(F.count("*").alias("events"), F.count_if("caught").alias("n_caught"))
    t = p.join(r, "rule_code", "full_outer").fillna(0, ["hits", "misses", "pending", "after", "events", "n_caught"]).crossJoin(base.select("rate"))
    tried = F.col("hits") + F.col("misses")
    t = t.withColumn("precision", F.when(tried > 0, F.col("hits") / tried)).withColumn("recall", F.when(F.col("events") > 0, F.col("n_caught") / F.col("events")))
    t = t.withColumn("precision_ci", stats.wilson(F.col("hits"), tried)).withColumn("recall_ci", stats.wilson(F.col("n_caught"), F.col("events")))
    return t.withColumn("lift", F.when(F.col("rate") > 0, F.col("precision") / F.col("rate")))


def event_study(events: DataFrame, bars: DataFrame, h: int, least_peers: int = 5, share_limit: float = 0.02) -> DataFrame:
    """Each event (id, rule_code, stock, date) with status, entry, exit, ret, bench, excess, peers.

    ``bars``: stock, day, price, shares. Entry is the first bar after the event, exit ``h`` bars later. What
    keeps an event out, in this order: NO_PRICE, HORIZON_NOT_ELAPSED, OVERLAP, SHARE_CHANGE, NO_BENCHMARK.
    Peers are all other stocks with bars on both days and no share change between; their returns are summed
    by pair of days, so the work grows with the bars and not with pairs of stocks.
    """
    w = Window.partitionBy("stock").orderBy("day")
    b = bars.withColumn("idx", F.row_number().over(w) - 1)
    ahead = Window.partitionBy("stock").orderBy("idx").rangeBetween(h, h)
    b = b.withColumn("exit", F.first("day").over(ahead)).withColumn("_out", F.first("price").over(ahead)).withColumn("ret", F.col("_out") / F.col("price") - 1)
    b = ordered.any_break(b, ["stock"], "idx", "shares", h, share_limit, "broken")
    sums = b.where("exit is not null AND NOT broken").groupBy("day", "exit").agg(F.count("*").alias("_n"), F.sum("ret").alias("_s"))
    span = b.groupBy("stock").agg(F.min("day").alias("_first"))
    e = events.select("id", "rule_code", "stock", "date").withColumnRenamed("date", "day")
    nxt = b.select("stock", "day", F.col("day").alias("entry"), "idx", "exit", "ret", "broken")
    e = ordered.asof_next(e, nxt, ["stock"], "day", ["entry", "idx", "exit", "ret", "broken"]).join(span, "stock", "left")
    early = F.when(F.col("_first").isNull() | (F.col("_first") > F.col("day")), "NO_PRICE").when(F.col("exit").isNull(), "HORIZON_NOT_ELAPSED")
    e = e.withColumn("_early", early)
    # shares and benchmark are settled first, as only an event that is used keeps others out
    e = e.join(sums.withColumnRenamed("day", "entry"), ["entry", "exit"], "left")
    peers = F.coalesce("_n", F.lit(0)) - F.when(F.col("broken"), 0).otherwise(1)
    e = e.withColumn("peers", F.when(F.col("_early").isNull(), peers))
    late = F.when(F.col("broken"), "SHARE_CHANGE").when(F.col("peers") < least_peers, "NO_BENCHMARK")
    e = e.withColumn("_late", late)
    fine = e.where("_early is null AND _late is null").withColumn("_at", F.date_format("day", "yyyyMMdd"))
    used = ordered.greedy_non_overlap(fine.select("rule_code", "stock", "id", "idx", "_at"), ["rule_code", "stock"], "idx", h, ["_at", "id"]).where("used").select("rule_code", "stock", "id", F.col("idx").alias("_u"))
    # what is not used overlaps if an event that is used entered less than h bars before it
    mark = used.select("rule_code", "stock", "id", F.lit(True).alias("_used"))
    e = e.join(mark, ["rule_code", "stock", "id"], "left")
    order = Window.partitionBy("rule_code", "stock").orderBy("day", "id").rowsBetween(Window.unboundedPreceding, -1)
    free = F.max(F.when(F.col("_used"), F.col("idx") + h)).over(order)
    e = e.withColumn("_overlap", F.coalesce(F.col("idx") < free, F.lit(False)))
    status = F.coalesce("_early", F.when(F.col("_overlap"), "OVERLAP"), "_late", F.lit("USED"))
    bench = F.when(F.col("peers") > 0, (F.col("_s") - F.when(F.col("broken"), 0.0).otherwise(F.col("ret"))) / F.col("peers"))
    e = e.withColumn("status", status).withColumn("bench", F.when(status == "USED", bench))
    return e.select("id", "rule_code", "stock", F.col("day").alias("date"), "status", "entry", "exit", F.when(status == "USED", F.col("ret")).alias("ret"), "bench", (F.when(status == "USED", F.col("ret")) - F.col("bench")).alias("excess"), "peers")


def study_stats(studied: DataFrame) -> DataFrame:
    """One row for each rule: n, mean, median and t statistic of the excess, share of negative ones. No task holds a rule's rows."""
    used = studied.where("status = 'USED'")
    sums = used.groupBy("rule_code").agg(F.count("*").alias("n"), F.avg("excess").alias("mean"), stats.t_stat(F.col("excess")).alias("t"), F.avg((F.col("excess") < 0).cast("double")).alias("negative_share"))
    middle = grids.exact_median(used, ["rule_code"], "excess", 0.01)
    return sums.join(middle, "rule_code", "left").select("rule_code", "n", "mean", "median", "t", "negative_share")


def best_rule(scored: DataFrame) -> DataFrame:
    """The rule of highest lower precision bound, then of highest lift."""
    return scored.orderBy(F.col("precision_ci.low").desc_nulls_last(), F.col("lift").desc_nulls_last(), "rule_code").limit(1)
