"""Standard accounts, quarter values and company metrics on small statements."""

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import statements

ACCOUNTS = "std_code string, sj_div string, flow_type string, agg string, sort_order int"
RULES = "map_id int, std_code string, sj_div string, match_type string, pattern string, priority int, abs_value boolean, section string"
LINES = "corp_code string, period_key string, fs_div string, sj_div string, line_no int, account_id string, account_nm string, amount decimal(24,0)"
KEYS = ["corp_code", "period_key", "fs_div"]


@pytest.fixture(scope="module")
def dictionaries(spark):
    accounts = [("SHORT_BORROWINGS", "BS", "POINT", "SUM", 5), ("LONG_BORROWINGS", "BS", "POINT", "SUM", 6), ("BONDS", "BS", "POINT", "SUM", 7), ("REVENUE", "IS", "FLOW", "FIRST", 8), ("INTEREST_EXPENSE", "IS", "FLOW", "FIRST", 11)]
    rules = [
        (1, "SHORT_BORROWINGS", None, "NAME_EXACT", "단기차입금", 10, False, None),
        (2, "SHORT_BORROWINGS", None, "NAME_EXACT", "유동성장기부채", 20, False, None),
        (3, "SHORT_BORROWINGS", None, "ACCOUNT_ID", "current-portion", 5, False, None),
        (4, "SHORT_BORROWINGS", None, "NAME_EXACT", "단기금융부채", 60, False, None),
        (5, "SHORT_BORROWINGS", None, "NAME_EXACT", "차입금", 30, False, "CURRENT"),
        (6, "LONG_BORROWINGS", None, "NAME_EXACT", "장기차입금", 10, False, None),
        (7, "BONDS", None, "NAME_REGEX", "(유동성)?사채|회사채", 10, False, None),
        (8, "REVENUE", "IS", "NAME_EXACT", "매출액", 10, False, None),
        (9, "INTEREST_EXPENSE", "IS", "NAME_EXACT", "이자비용", 10, False, None),
        (10, "INTEREST_EXPENSE", "CF", "NAME_EXACT", "이자의지급", 20, True, None),
    ]
    return spark.createDataFrame(accounts, ACCOUNTS), spark.createDataFrame(rules, RULES)


def values(spark, dictionaries, rows):
    from decimal import Decimal

    lines = spark.createDataFrame([("c", "2025Q1", "CFS", sj, n, i, name, None if a is None else Decimal(a)) for sj, n, i, name, a in rows], LINES)
    out = statements.standard_values(statements.picks(lines, *dictionaries, KEYS), KEYS)
    return {r.std_code: (int(r.amount), r.source, r.basis) for r in out.collect()}


def test_sums_of_names(spark, dictionaries):
    got = values(spark, dictionaries, [("BS", 10, None, "단기차입금", 100), ("BS", 11, None, "2. 유동성장기부채", 30), ("BS", 12, None, "장기차입금", 999)])
    assert got["SHORT_BORROWINGS"] == (130, "단기차입금 + 2. 유동성장기부채", "POINT")
    assert got["LONG_BORROWINGS"][0] == 999


def test_a_line_is_claimed_once_and_repeats_are_left_out(spark, dictionaries):
    rows = [("BS", 1, None, "단기차입금", 1000), ("BS", 2, "current-portion", "유동성사채", 998), ("BS", 3, None, "유동성사채", 1000), ("BS", 4, None, "사채", 1497), ("BS", 5, None, "사채", 1500)]
    got = values(spark, dictionaries, rows)
    assert got["SHORT_BORROWINGS"][0] == 1998
    assert got["BONDS"][0] == 1497


def test_sections(spark, dictionaries):
    rows = [("BS", 1, None, "유동부채", 500), ("BS", 2, None, "차입금", 300), ("BS", 3, None, "비유동부채", 900), ("BS", 4, None, "차입금", 700)]
    assert values(spark, dictionaries, rows)["SHORT_BORROWINGS"][0] == 300


def test_fallback_only_where_nothing_else_matched(spark, dictionaries):
    assert values(spark, dictionaries, [("BS", 1, None, "단기금융부채", 700)])["SHORT_BORROWINGS"][0] == 700
    assert values(spark, dictionaries, [("BS", 1, None, "단기금융부채", 700), ("BS", 2, None, "단기차입금", 100)])["SHORT_BORROWINGS"][0] == 100


def test_income_statement_before_comprehensive_one_and_absolute_flows(spark, dictionaries):
    got = values(spark, dictionaries, [("CIS", 1, None, "매출액", 150), ("IS", 2, None, "매출액", 140), ("CF", 3, None, "이자의 지급", -42), ("BS", 4, None, None, 3), ("BS", 5, None, "단기차입금", None)])
    assert got["REVENUE"] == (140, "매출액", "CUM")
    assert got["INTEREST_EXPENSE"][0] == 42
    assert "SHORT_BORROWINGS" not in got


def test_quarters_need_the_one_before_of_the_same_kind(spark):
    rows = [("a", 0, 100, "CFS"), ("a", 1, 250, "CFS"), ("a", 2, 330, "CFS"), ("a", 3, 500, "CFS"), ("b", 1, 250, "CFS"), ("b", 2, 330, "OFS"), ("b", 4, 90, "CFS")]
    df = spark.createDataFrame(rows, "k string, q int, cum long, fs_div string")
    got = sorted((r.k, r.q, r.v) for r in statements.decumulate(df, ["k"], "q", "cum", "v", "fs_div").collect())
    assert got == [("a", 0, 100), ("a", 1, 150), ("a", 2, 80), ("a", 3, 170), ("b", 4, 90)]


def metrics(spark, rows):
    from decimal import Decimal

    names = ["corp_code", "period_key", *statements.FACTS]
    schema = ", ".join(f"{n} {'string' if i < 2 else 'decimal(24,0)'}" for i, n in enumerate(names))
    df = spark.createDataFrame([tuple(r.get(n) if n in ("corp_code", "period_key") or r.get(n) is None else Decimal(r[n]) for n in names) for r in rows], schema)
    return {(r.period_key, r.metric_code): (None if r.value is None else float(r.value), r.status) for r in statements.company_metrics(df).collect()}


def test_company_metrics(spark):
    now = dict(corp_code="c", period_key="2026Q2", liabilities=400, equity=100, assets=500, short=50, bonds=50, revenue=1000, ocf=-100, q_income=8, q_interest=10, q_ocf=-40)
    got = metrics(spark, [now, dict(corp_code="c", period_key="2025Q2", liabilities=250, equity=100)])
    at = lambda m: got[("2026Q2", m)]
    assert at("DEBT_RATIO") == (400, "OK") and at("DEBT_RATIO_YOY") == (150, "OK")
    assert at("BORROWING_DEP") == (20, "OK") and at("INTEREST_COVERAGE") == (0.8, "OK")
    assert at("OCF_MARGIN") == (-10, "OK") and at("OCF_QTR") == (-40, "OK")
    assert at("REVENUE_YOY") == (None, "MISSING")


def test_statuses(spark):
    got = metrics(spark, [dict(corp_code="c", period_key="2026Q1", liabilities=10, equity=-5, current_assets=5, current_liabilities=0, q_income=5, q_interest=-143)])
    at = lambda m: got[("2026Q1", m)][1]
    assert (at("DEBT_RATIO"), at("CURRENT_RATIO"), at("INTEREST_COVERAGE"), at("OCF_QTR")) == ("NEG_EQUITY", "ZERO_DENOM", "INCONSISTENT", "MISSING")


def test_raw_lines_to_standard_rows(spark, dictionaries):
    schema = "corp_code string, bsns_year string, reprt_code string, fs_div string, rcept_no string, sj_div string, line_no int, account_id string, account_nm string, thstrm_amount decimal(24,0), thstrm_add_amount decimal(24,0)"
    from decimal import Decimal as D

    rows = [
        ("c", "2025", "11013", "CFS", "1", "IS", 1, None, "매출액", D(90), None),
        ("c", "2025", "11013", "CFS", "2", "IS", 1, None, "매출액", D(100), None),
        ("c", "2025", "11012", "CFS", "3", "IS", 1, None, "매출액", D(150), D(250)),
    ]
    out = statements.standardize(spark.createDataFrame(rows, schema), *dictionaries)
    got = {(r.period_key, r.basis): int(r.amount) for r in out.collect()}
    assert got == {("2025Q1", "CUM"): 100, ("2025Q2", "CUM"): 250, ("2025Q1", "QTR"): 100, ("2025Q2", "QTR"): 150}
    empty = statements.standardize(spark.createDataFrame([], schema), *dictionaries)
    assert empty.count() == 0 and statements.facts(out).where(F.col("revenue") == 250).count() == 1


def test_accounts_that_a_user_adds_are_summed_in_their_order(spark, dictionaries):
    """A line that an earlier account claims is not counted by a later one."""
    accounts, rules = dictionaries
    accounts = accounts.unionByName(spark.createDataFrame([("LEASES", "BS", "POINT", "SUM", 9)], ACCOUNTS))
    more = [(20, "LEASES", None, "NAME_REGEX", "(유동)?리스부채", 10, False, None), (21, "LEASES", None, "NAME_EXACT", "장기차입금", 20, False, None)]
    rules = rules.unionByName(spark.createDataFrame(more, RULES))
    rows = [("BS", 1, None, "장기차입금", 70), ("BS", 2, None, "유동리스부채", 3), ("BS", 3, None, "리스부채", 4)]
    got = values(spark, (accounts, rules), rows)
    assert got["LONG_BORROWINGS"][0] == 70 and got["LEASES"] == (7, "유동리스부채 + 리스부채", "POINT")
    first = spark.createDataFrame([("LEASES", "BS", "POINT", "SUM", 1)], ACCOUNTS).unionByName(accounts.where("std_code != 'LEASES'"))
    got = values(spark, (first, rules), rows)
    assert got["LEASES"][0] == 77 and "LONG_BORROWINGS" not in got


def test_rules_are_bounded(spark, dictionaries, monkeypatch):
    monkeypatch.setattr(statements, "MOST_RULES", 0)
    with pytest.raises(ValueError, match="more than 0"):
        values(spark, dictionaries, [("BS", 1, None, "사채", 1)])
