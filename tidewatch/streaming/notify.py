"""Notifications: an outbox dealt out to inboxes and deliveries as one repeatable unit, and deliveries that are tried again."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators import lifecycle
from tidewatch.session import ship

#: Attempts after which a delivery is given up, how long one may take, and the waits after each. Fixed values, in seconds.
MOST_ATTEMPTS, LEASE = 6, 120
WAITS = [60, 300, 1800, 7200, 43200]

# -------------------------------------------------------------------- outbox


def dealt(events: DataFrame, subscriptions: DataFrame, webhooks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(owner, alert_id, kind) for inboxes and (webhook_id, alert_id, kind) for deliveries.

    ``subscriptions``: as ``lifecycle.fan_out`` has them, with channel (IN_APP or WEBHOOK) and webhook_id; ``webhooks``: webhook_id, enabled.
    """
    kind = F.when(F.col("revived"), "REOPENED").otherwise("NEW").alias("kind")
    inbox = lifecycle.fan_out(events, subscriptions.where("channel = 'IN_APP'")).select("owner", "alert_id", kind)
    hooks = subscriptions.where("channel = 'WEBHOOK'").join(webhooks.where("enabled").select("webhook_id"), "webhook_id")
    sent = lifecycle.fan_out(events, hooks.withColumn("owner", F.col("webhook_id")))
    return inbox, sent.select(F.col("owner").alias("webhook_id"), "alert_id", kind)


def outbox(feed: DataFrame, path: str, checkpoint: str, tables: Callable[[SparkSession], tuple[DataFrame, DataFrame]], before_done: Callable[[int], None] = lambda n: None):
    """Start a query that deals each batch of events out to ``path/inbox`` and ``path/delivery`` and then marks it in ``path/done``.

    ``tables`` gives subscriptions and webhooks as they are when a batch comes. All three are logs with a part for each batch: nothing that was written
    is written again by later batches, and a batch that is repeated after a failure puts its own parts in place of what it left. Readers
    (``inbox``, ``deliveries``) take marked batches only, so both sinks change together. ``before_done`` is called before a batch is marked.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        subscriptions, webhooks = tables(spark)
        batch.persist()
        try:
            inbox_, delivery = dealt(batch, subscriptions, webhooks)
            inbox_.write.mode("overwrite").parquet(f"{path}/inbox/batch={number}")
            delivery.write.mode("overwrite").parquet(f"{path}/delivery/batch={number}")
            before_done(number)
            batch.agg(F.count("*").alias("events")).write.mode("overwrite").parquet(f"{path}/done/batch={number}")
        finally:
            batch.unpersist()

    return feed.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _log(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """Rows of a log's marked batches."""
    done = spark.read.schema("events long, batch long").parquet(f"{path}/done").select("batch").distinct()
    log = spark.read.schema(f"{schema}, batch long").parquet(f"{path}/{name}")
    return log.join(done, "batch", "left_semi").select(log.columns)


def _last(log: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row that counts: the first one, or the last that reopened it."""
    first = F.min("batch").over(Window.partitionBy(*keys))
    counts = log.withColumn("_first", first).where("batch = _first OR kind = 'REOPENED'")
    rest = [c for c in log.columns if c not in keys]
    return counts.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def inbox(spark: SparkSession, path: str) -> DataFrame:
    """(owner, alert_id, kind, batch) of all inboxes: one row for each owner and alert; a reopened one is there anew."""
    return _last(_log(spark, path, "inbox", "owner string, alert_id long, kind string"), ["owner", "alert_id"])


def deliveries(spark: SparkSession, path: str) -> DataFrame:
    """(webhook_id, alert_id, kind, batch) to be sent, every time that one was asked for."""
    log = _log(spark, path, "delivery", "webhook_id string, alert_id long, kind string")
    return log.withColumn("_first", F.min("batch").over(Window.partitionBy("webhook_id", "alert_id"))).where("batch = _first OR kind = 'REOPENED'").drop("_first")


# --------------------------------------------------------------------- retry

STEP = "delivery string, status string, attempts int, lease long, at long"
_STATE = "status string, attempts int, lease long, due long"


class Retry(StatefulProcessor):
    """What becomes of each delivery: SENDING with a lease, then SENT, or PENDING until its wait is over, or DEAD.

    An answer counts only if it names the lease that is running: one that comes after its lease ended and another was given is REFUSED. Times are
    milliseconds of the rows' own clock, and timers run on it, too.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _STATE)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        given = pd.concat(list(rows)).sort_values(["at", "what"], kind="stable")
        out = []
        for r in given.itertuples():
            now = int(r.at.timestamp() * 1000)
            state = self.held.get() if self.held.exists() else None
            if r.what in ("NEW", "REOPENED"):
                if state is None or (r.what == "REOPENED" and state[0] in ("SENT", "DEAD")):
                    out.append(self._claim(key, 0, now))
            elif state is None or state[0] != "SENDING" or state[2] != r.lease:
                out.append((key[0], "REFUSED", 0 if state is None else state[1], int(r.lease), now))
            else:
                out.append(self._answered(key, r.what, state, now))
        if out:
            yield _steps(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        state = self.held.get() if self.held.exists() else None
        # timers of leases that were answered, and of earlier rounds, mean nothing any more
        if state is not None and ((state[0] == "SENDING" and state[2] == now) or (state[0] == "PENDING" and state[3] == now)):
            yield _steps([self._claim(key, state[1], now)])

    def _claim(self, key, attempts: int, now: int) -> tuple:
        lease = now + LEASE * 1000
        self.held.update(("SENDING", attempts + 1, lease, 0))
        self.handle.registerTimer(lease)
        return key[0], "SENDING", attempts + 1, lease, now

    def _answered(self, key, what: str, state: tuple, now: int) -> tuple:
        status, attempts, due = "SENT" if what == "OK" else "DEAD", state[1], 0
        if what == "RETRY" and attempts < MOST_ATTEMPTS:
            status, due = "PENDING", now + WAITS[min(attempts, len(WAITS)) - 1] * 1000
            self.handle.registerTimer(due)
        self.held.update((status, attempts, 0, due))
        return key[0], status, attempts, state[2], now


def _steps(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["delivery", "status", "attempts", "lease", "at"])


def retried(rows: DataFrame, late: str = "0 seconds") -> DataFrame:
    """STEP rows of a stream (delivery, at, what, lease): NEW and REOPENED ask for a delivery; OK, RETRY (may be tried again) and FAIL answer a lease.

    A delivery asked for while it is on its way is not asked for twice; one that was sent or given up is sent again once it is reopened. Needs
    a state store that holds timers (RocksDB).
    """
    ship(rows.sparkSession)
    timed = rows.select("delivery", F.col("at").cast("timestamp").alias("at"), "what", F.coalesce("lease", F.lit(0).cast("long")).alias("lease")).withWatermark("at", late)
    return timed.groupBy("delivery").transformWithStateInPandas(Retry(), STEP, "append", "eventTime")
