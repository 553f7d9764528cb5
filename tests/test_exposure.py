"""The exposure of companies on a small scenario."""

import datetime
from decimal import Decimal as D

from tidewatch.operators import exposure

DAY = datetime.date
NEW, OLD = DAY(2026, 5, 1), DAY(2025, 1, 1)


def test_a_row_for_each_company(spark):
    t = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    companies = t("corp_code string, corp_name string, is_target boolean", ("A", "가", True), ("B", "나", True), ("C", "다", False), ("D", "라", True))
    contracts = t(
        "corp_code string, rcept_dt date, amount decimal(20,0), region_cd string, superseded_by string, terminated_by string",
        ("A", NEW, D(600), "r1", None, None), ("A", NEW, D(300), "r2", None, None), ("A", NEW, D(100), None, None, None), ("A", NEW, D(50), "r3", None, None), ("A", NEW, D(9999), "r1", "x", None),
        ("A", NEW, D(9999), "r1", None, "x"), ("A", OLD, D(9999), "r1", None, None), ("B", NEW, D(70), None, None, None), ("C", NEW, D(1), "r1", None, None),
    )
    guarantees = t(
        "corp_code string, rcept_no string, rcept_dt date, equity decimal(20,0), total_balance decimal(20,0), pf_amount decimal(20,0), superseded_by string",
        ("A", "1", NEW, D(100), D(50), D(7), None), ("A", "2", NEW, D(300), D(100), None, None), ("A", "3", NEW, D(1), D(1), D(9999), "x"), ("B", "4", NEW, D(-5), D(10), None, None),
    )
    alerts = t("target_type string, target string, status string", ("COMPANY", "A", "OPEN"), ("COMPANY", "A", "ACK"), ("COMPANY", "A", "CLOSED"), ("REGION", "A", "OPEN"))
    reports = t("corp_code string, period_key string, rcept_no string", ("A", "2025Q4", "1"), ("A", "2026Q1", "2"), ("B", "2025Q4", "3"), ("B", "2026Q1", "4"))
    metric = lambda c, p, code, v, s: (c, p, code, None if v is None else D(v), s)
    metrics = t(
        "corp_code string, period_key string, metric_code string, value decimal(20,4), status string",
        metric("A", "2025Q4", "PF_GUARANTEE_TO_EQUITY", 10, "OK"), metric("A", "2026Q1", "PF_GUARANTEE_TO_EQUITY", 20, "OK"), metric("A", "2026Q1", "PF_DUE_12M_TO_EQUITY", 5, "OK"),
        # no older quarter stands in for one with negative equity
        metric("B", "2025Q4", "PF_GUARANTEE_TO_EQUITY", 90, "OK"), metric("B", "2026Q1", "PF_GUARANTEE_TO_EQUITY", None, "NEG_EQUITY"),
    )
    presales = t("notice string, notice_date date, units int, region_cd string, removed_at date", ("n1", NEW, 60, "r1", None), ("n2", NEW, 40, "r2", None), ("n3", NEW, 9, None, None), ("n4", NEW, 99, "r1", NEW), ("n5", OLD, 99, "r1", None), ("n6", NEW, None, "r1", None))
    builders = t("notice string, corp_code string, status string", *[(n, "A", "MATCHED") for n in ("n1", "n1", "n2", "n3", "n4", "n5")], ("n1", "B", "AMBIGUOUS"), ("n6", "D", "MATCHED"))
    remainders = t("notice string, notice_date date, units int, removed_at date", ("n1", NEW, 3, None), ("n1", NEW, 4, None), ("n2", NEW, 99, NEW), ("n3", OLD, 99, None))
    unsold = t("region_cd string, value double", ("r1", 6.0), ("r2", 1.0))
    found = exposure.summary(companies, contracts, guarantees, alerts, reports, metrics, presales, builders, remainders, unsold, DAY(2026, 1, 1), 5.0)
    got = {r.corp_code: tuple(r)[2:] for r in exposure.ranked(found).collect()}
    assert found.columns == exposure.COLUMNS and len(exposure.COLUMNS) == 21
    assert list(got) == ["A", "B", "D"]
    assert got["A"] == (4, 1050, 950, 600, D("63.16"), 1, D("33.33"), NEW, 7, 2, "2026Q1", 20, 5, 3, 109, 60, D("60.00"), 7, "OK")
    assert got["B"] == (1, 70, None, None, None, 0, None, NEW, None, 0, "2026Q1", None, None, 0, None, None, None, None, "NEG_EQUITY")
    assert got["D"] == (0, None, None, None, None, 0, None, None, None, 0, None, None, None, 1, 0, None, None, None, None)
