"""Alerts are dealt to tasks before they meet subscriptions, however many these are."""

import pytest

from tidewatch.operators import lifecycle

EVENTS = "alert_id long, kind string, rule_code string, target_type string, target string, severity string"
SUBSCRIPTIONS = "owner string, enabled boolean, target_type string, rule_codes array<string>, min_severity string, targets array<string>"


@pytest.mark.parametrize("few", [10_000, 0])
def test_alerts_are_dealt(spark, monkeypatch, few):
    monkeypatch.setattr(lifecycle, "FEW_SUBSCRIPTIONS", few)
    events = [(i, "REOPENED" if i % 3 == 0 else "NEW", ("R1", "R2", None)[i % 3], "COMPANY", ("a", "b", None, "c")[i % 4], ("HIGH", "MEDIUM", "LOW")[i % 5 % 3]) for i in range(200)]
    events.append((0, "NEW", "R1", "COMPANY", "a", "HIGH"))
    subscriptions = [("all", True, None, None, "LOW", None), ("all", True, None, None, "HIGH", ["a"]), ("r1", True, None, ["R1", "R1", None], "MEDIUM", None), ("bc", True, "COMPANY", None, "LOW", ["b", "c"]), ("r2c", True, None, ["R2"], "LOW", ["c"]), ("off", False, None, None, "LOW", None), ("region", True, "REGION", None, "LOW", None)]
    rank = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}
    want: dict = {}
    for alert, kind, rule, type_, target, severity in events:
        for owner, on, of, rules, least, targets in subscriptions:
            if on and of in (None, type_) and (rules is None or rule is not None and rule in rules) and (targets is None or target in targets) and rank[severity] >= rank[least]:
                want[owner, alert] = want.get((owner, alert), False) or kind == "REOPENED"
    got = lifecycle.fan_out(spark.createDataFrame(events, EVENTS), spark.createDataFrame(subscriptions, SUBSCRIPTIONS))
    rows = got.collect()
    assert len(rows) == len(want) and {(r.owner, r.alert_id): r.revived for r in rows} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [alert_id" in plan and ("_part" in plan) == (few == 0)
