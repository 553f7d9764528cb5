"""The outbox as a repeatable unit, and retries with leases."""

import datetime

import pytest

from tidewatch.streaming import feeds, notify

EVENT = "event_id long, alert_id long, kind string, rule_code string, target_type string, target string, severity string"


def tables(spark):
    s = spark.createDataFrame(
        [("ann", True, None, None, "LOW", None, "IN_APP", None), ("bob", True, "COMPANY", ["R1"], "HIGH", None, "IN_APP", None), ("ann", True, None, ["R1"], "LOW", None, "WEBHOOK", "w1"), ("bob", True, None, None, "LOW", None, "WEBHOOK", "w2")],
        "owner string, enabled boolean, target_type string, rule_codes array<string>, min_severity string, targets array<string>, channel string, webhook_id string",
    )
    return s, spark.createDataFrame([("w1", True), ("w2", False)], "webhook_id string, enabled boolean")


def land(spark, tmp_path, name, *rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")


def test_a_fault_between_the_sinks_leaves_both_as_they_were_and_a_repeat_makes_both_right(spark, tmp_path):
    feed, path, checkpoint = f"{tmp_path}/feed", f"{tmp_path}/out", f"{tmp_path}/cp"
    land(spark, tmp_path, "feed", (1, 10, "NEW", "R1", "COMPANY", "A", "HIGH"), (2, 11, "NEW", "R2", "REGION", "x", "LOW"))
    faults = []

    def fault(number):
        if number == 1 and not faults:
            faults.append(number)
            raise RuntimeError("between the writes and the mark")

    run = lambda: notify.outbox(feeds.stream(spark, feed, EVENT), path, checkpoint, tables, fault).awaitTermination()
    state = lambda: (sorted(map(tuple, notify.inbox(spark, path).collect())), sorted(map(tuple, notify.deliveries(spark, path).collect())))
    run()
    first = ([("ann", 10, "NEW", 0), ("ann", 11, "NEW", 0), ("bob", 10, "NEW", 0)], [("w1", 10, "NEW", 0)])
    assert state() == first
    # alert 10 comes again (no change), 11 is reopened, 12 is new
    land(spark, tmp_path, "feed", (3, 10, "NEW", "R1", "COMPANY", "A", "HIGH"), (4, 11, "REOPENED", "R2", "REGION", "x", "LOW"), (5, 12, "NEW", "R1", "COMPANY", "B", "LOW"))
    with pytest.raises(Exception, match="between the writes"):
        run()
    assert faults == [1] and state() == first
    run()
    assert state() == ([("ann", 10, "NEW", 0), ("ann", 11, "REOPENED", 1), ("ann", 12, "NEW", 1), ("bob", 10, "NEW", 0)], [("w1", 10, "NEW", 0), ("w1", 12, "NEW", 1)])
    run()
    assert len(state()[0]) == 4


T0 = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)
MS = int(T0.timestamp() * 1000)


def steps(spark, tmp_path, *batches):
    """What the retries do of batches of (delivery, second, what, lease)."""
    for n, rows in enumerate(batches):
        given = [(d, T0 + datetime.timedelta(seconds=s), what, lease) for d, s, what, lease in rows]
        spark.createDataFrame(given, "delivery string, at timestamp, what string, lease long").coalesce(1).write.parquet(f"{tmp_path}/in/b={n:03d}")
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        feed = spark.readStream.schema("delivery string, at timestamp, what string, lease long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        q = notify.retried(feed).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    return sorted(((r.at - MS) // 1000, r.delivery, r.status, r.attempts, (r.lease - MS) // 1000) for r in rows)


def test_waits_grow_and_the_sixth_attempt_is_the_last(spark, tmp_path):
    batches, now, want = [[("d", 0, "NEW", None)]], 0, [(0, "d", "SENDING", 1, 120)]
    for attempt in range(1, 7):
        answer = now + 10
        batches.append([("d", answer, "RETRY", MS + (now + 120) * 1000)])
        want.append((answer, "d", "PENDING" if attempt < 6 else "DEAD", attempt, now + 120))
        if attempt < 6:
            now = answer + notify.WAITS[min(attempt, 5) - 1]
            want.append((now, "d", "SENDING", attempt + 1, now + 120))
            # another key lets the time go on: a batch sees how far the one before it came
            batches += [[("clock", now + 1, "OK", 0)], [("clock", now + 2, "OK", 0)]]
    got = [x for x in steps(spark, tmp_path, *batches) if x[1] == "d"]
    assert got == sorted(want)


def test_a_late_answer_is_refused_and_a_reopened_delivery_goes_out_again(spark, tmp_path):
    first, second = MS + 120_000, MS + 240_000
    got = steps(
        spark, tmp_path,
        [("d", 0, "NEW", None), ("d", 1, "NEW", None)],
        [("clock", 121, "OK", 0)], [("clock", 122, "OK", 0)],  # the lease ends: another attempt
        [("d", 130, "OK", first)],  # the answer to the first one comes late
        [("d", 140, "OK", second)],
        [("d", 150, "NEW", None), ("d", 160, "REOPENED", None)],
        [("d", 170, "FAIL", MS + 280_000)],
    )
    assert [x for x in got if x[1] == "d"] == [
        (0, "d", "SENDING", 1, 120), (120, "d", "SENDING", 2, 240), (130, "d", "REFUSED", 2, 120), (140, "d", "SENT", 2, 240), (160, "d", "SENDING", 1, 280), (170, "d", "DEAD", 1, 280),
    ]
