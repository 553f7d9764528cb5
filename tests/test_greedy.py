"""The greedy scan gets islands of a key, not whole keys."""

import random

from tidewatch.operators import ordered


def test_greedy_scan_by_islands(spark):
    rng = random.Random(3)
    rows = [(k, i, None if rng.random() < 0.05 else rng.randint(0, 3000)) for k in ("a", "b") for i in range(200)]
    rows += [("c", i, 7 * i // 2 + 40 * (i // 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, at long, entry long").repartition(3)
    want, free = {}, {}
    for k, i, e in sorted(rows, key=lambda r: r[:2]):
        want[k, i] = e is not None and (k not in free or e >= free[k])
        if want[k, i]:
            free[k] = e + 24
    got = ordered.greedy_non_overlap(df, ["k"], "entry", 24, ["at"])
    assert got.columns == ["k", "at", "entry", "used"]
    assert {(r.k, r["at"]): r.used for r in got.collect()} == want
    assert "_island" in got._jdf.queryExecution().optimizedPlan().toString()


def test_islands_are_scanned_in_one_stream(spark):
    big = 2**53 + 1
    rows = [(None, 1, big, 0), (None, 2, None, 5), (None, 3, big + 2, 30), (7, 1, big, 30), (7, 2, big, 40), (7, 3, None, None), (7, 4, big, 54)]
    df = spark.createDataFrame(rows, "k long, at long, id long, entry long")
    got = ordered.greedy_non_overlap(df, ["k"], "entry", 24, ["at"])
    used = {(None, 1): True, (None, 2): False, (None, 3): True, (7, 1): True, (7, 2): False, (7, 3): False, (7, 4): True}
    assert {tuple(r) for r in got.collect()} == {(*r, used[r[:2]]) for r in rows}
    # a call of Python for each island took milliseconds
    assert "FlatMapGroups" not in got._jdf.queryExecution().optimizedPlan().toString()
