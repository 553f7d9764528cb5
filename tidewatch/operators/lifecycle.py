"""Alerts as snapshots: what opens, stays and closes follows from the alerts there are and the findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["rule_code", "target", "as_of"]
#: Subscriptions, a row for each pair of a rule and a target, that every task gets whole.
FEW_SUBSCRIPTIONS = 10_000


def plan(active: DataFrame, findings: DataFrame, outcome: DataFrame) -> DataFrame:
    """rule_code, rule_version, target, as_of, action (OPEN, CLOSE, STORE_CLOSED), close_reason.

    ``active``: rule_code, rule_version, target, as_of; ``findings``: rule_code, target, as_of;
    ``outcome``: rule_code, target, version (now), single_active, decided, latest_as_of, evaluated
    (array). A rule with single_active keeps one open alert for a target, that of the latest period.
    While nothing is decided for such a rule only alerts of older versions close.
    """
    o = outcome.withColumnRenamed("version", "_now")
    fired = findings.select(*KEY, F.lit(True).alias("_fired"))
    latest = findings.join(o.where("single_active"), ["rule_code", "target"]).where("as_of = latest_as_of").select("rule_code", "target", F.col("as_of").alias("_open"))
    both = active.join(fired, KEY, "full_outer").join(o, ["rule_code", "target"]).join(latest, ["rule_code", "target"], "left")
    c = F.col
    was, hit, single = c("rule_version").isNotNull(), F.coalesce("_fired", F.lit(False)), c("single_active")
    undecided = single & ~c("decided")
    evaluated = F.array_contains("evaluated", c("as_of"))
    why = (
        F.when(c("rule_version") != c("_now"), "RULE_CHANGED").when(undecided, None)
        .when(~hit, F.when(single | evaluated, "RESOLVED").otherwise("EXPIRED"))
        .when(single & ~c("as_of").eqNullSafe(c("_open")), F.when(c("_open").isNotNull(), "SUPERSEDED").otherwise("RESOLVED"))
    )
    closes = both.where(was).withColumn("close_reason", why).where("close_reason is not null").select("rule_code", "rule_version", "target", "as_of", F.lit("CLOSE").alias("action"), "close_reason")
    opened = ~single | c("as_of").eqNullSafe(c("_open"))
    upserts = both.where(hit).where(~undecided).select(
        "rule_code", c("_now").alias("rule_version"), "target", "as_of", F.when(opened, "OPEN").otherwise("STORE_CLOSED").alias("action"),
        F.when(~opened, F.when(c("_open").isNotNull(), "SUPERSEDED").otherwise("RESOLVED")).alias("close_reason"),
    )
    # an alert of the present version that its own finding stores as closed is closed once
    closes = closes.join(upserts.where("action = 'STORE_CLOSED'"), ["rule_code", "rule_version", "target", "as_of"], "left_anti")
    return closes.unionByName(upserts.dropDuplicates(["rule_code", "rule_version", "target", "as_of"]))


def apply(state: DataFrame, planned: DataFrame, at) -> DataFrame:
    """The next snapshot: state has rule_code, rule_version, target, as_of, status (OPEN, ACK, CLOSED), close_reason, closed_at.

    An acknowledged alert stays so while it fires; the first reason and time of closing are kept; a
    closed one that fires again is open. The result has kind besides: NEW, REOPENED or null.
    """
    keys = ["rule_code", "rule_version", "target", "as_of"]
    p = planned.select(*keys, "action", F.col("close_reason").alias("_why"))
    both = state.join(p, keys, "full_outer")
    c = F.col
    there = c("status").isNotNull()
    opens, closes = c("action") == "OPEN", c("action").isin("CLOSE", "STORE_CLOSED")
    now = F.when(opens, F.when(c("status") == "ACK", "ACK").otherwise("OPEN")).when(closes, "CLOSED").otherwise(c("status"))
    first = F.when(closes, F.when(there & (c("status") == "CLOSED"), c("close_reason")).otherwise(c("_why"))).when(opens, F.lit(None)).otherwise(c("close_reason"))
    when_ = F.when(closes, F.when(there & (c("status") == "CLOSED"), c("closed_at")).otherwise(F.lit(at))).when(opens, F.lit(None)).otherwise(c("closed_at"))
    kind = F.when(opens & ~there, "NEW").when(opens & (c("status") == "CLOSED"), "REOPENED")
    return both.select(*keys, now.alias("status"), first.alias("close_reason"), when_.alias("closed_at"), kind.alias("kind"))


def close_out_of_scope(state: DataFrame, enabled: DataFrame, targets: DataFrame, at) -> DataFrame:
    """Open alerts of disabled rules or of targets no longer looked at, closed.

    ``enabled``: rule_code, target_type; ``targets``: target_type, target. A type without any target is
    left alone: that its list is empty says that it was not read.
    """
    s = state.join(enabled, "rule_code", "left").join(targets.select("target_type", "target", F.lit(True).alias("_in")).distinct(), ["target_type", "target"], "left")
    s = s.join(targets.select("target_type", F.lit(True).alias("_any")).distinct(), "target_type", "left")
    why = F.when(F.col("target_type").isNull(), "RULE_DISABLED").when(F.col("_in").isNull() & F.col("_any"), "OUT_OF_SCOPE")
    live = F.col("status") != "CLOSED"
    s = s.withColumn("_why", F.when(live, why))
    gone = F.col("_why").isNotNull()
    s = s.withColumn("status", F.when(gone, "CLOSED").otherwise(F.col("status"))).withColumn("close_reason", F.coalesce("_why", "close_reason")).withColumn("closed_at", F.when(gone, F.lit(at)).otherwise(F.col("closed_at")))
    return s.select(state.columns)


def transition(state: DataFrame, chosen: DataFrame, to: str) -> DataFrame:
    """Chosen alerts (by key) set to OPEN or ACK unless they are closed."""
    keys = ["rule_code", "rule_version", "target", "as_of"]
    s = state.join(chosen.select(*keys, F.lit(True).alias("_chosen")).distinct(), keys, "left")
    return s.withColumn("status", F.when(F.col("_chosen") & (F.col("status") != "CLOSED"), F.lit(to)).otherwise(F.col("status"))).select(state.columns)


def fan_out(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One inbox row for each owner and alert: events of alerts that a subscription asks for.

    ``events``: alert_id, kind, rule_code, target_type, target, severity; ``subscriptions``: owner,
    enabled, target_type, rule_codes, min_severity, targets (null: all). A reopened alert is unread again.
    Lists are exploded and "all" is a mark of its own, so that events meet subscriptions on equal keys. Alerts are dealt
    first and stay there where subscriptions are few; of more, those that ask for all targets have a copy for each
    part of the alerts, so that no task gets all events.
    """
    rank = lambda x: F.when(x == "HIGH", 3).when(x == "MEDIUM", 2).otherwise(1)
    c = F.col
    own = lambda x: F.transform(F.array_compact(c(x)), lambda v: F.concat(F.lit("="), v.cast("string")))
    wanted = lambda x: F.when(c(x).isNull(), F.array(F.lit("*"))).otherwise(F.array_distinct(own(x)))
    marks = lambda x: F.explode(F.array_compact(F.array(F.lit("*"), F.concat(F.lit("="), c(x).cast("string")))))
    s = subscriptions.where("enabled").select("owner", c("target_type").alias("_type"), rank(c("min_severity")).alias("_least"), F.explode(wanted("rule_codes")).alias("_rule"), "targets")
    s = s.select("owner", "_type", "_least", "_rule", F.explode(wanted("targets")).alias("_target"))
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = events.select("alert_id", "kind", "target_type", rank(c("severity")).alias("_rank"), "target", "rule_code").repartition(parts, "alert_id")
    e = e.select("alert_id", "kind", "target_type", "_rank", "target", marks("rule_code").alias("_rule"))
    e = e.select("alert_id", "kind", "target_type", "_rank", "_rule", marks("target").alias("_target"))
    if s.limit(FEW_SUBSCRIPTIONS + 1).count() <= FEW_SUBSCRIPTIONS:
        met = e.join(F.broadcast(s), ["_rule", "_target"])
    else:
        every = c("_target") == "*"
        s = s.withColumn("_part", F.explode(F.when(every, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
        e = e.withColumn("_part", F.when(every, F.pmod(F.xxhash64("alert_id"), F.lit(parts))).otherwise(0).cast("int"))
        met = e.hint("merge").join(s, ["_rule", "_target", "_part"])
    met = met.where((c("_type").isNull() | (c("_type") == c("target_type"))) & (c("_rank") >= c("_least")))
    return met.groupBy("owner", "alert_id").agg(F.max((c("kind") == "REOPENED").cast("int")).alias("_r")).select("owner", "alert_id", (c("_r") == 1).alias("revived"))
