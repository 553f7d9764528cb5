"""Regions, rules, alert lifecycles and evaluation on small cases."""

import datetime
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import names, periods, stats
from tidewatch.operators import evaluate, filings, grids, lifecycle, regions, rules

DAY = datetime.date


def test_trades_of_a_synthetic_city(spark):
    t = spark.createDataFrame([("1", 202601, D(84), 50000, False), ("1", 202601, D(84), 60000, False), ("1", 202601, D(84), 70000, True), ("a", 202601, D(59), 40000, False)], "lawd_cd string, deal_ym int, exclu_use_ar decimal(10,4), deal_amount long, cancelled boolean")
    ledger = spark.createDataFrame([("1", 202601), ("a", 202601), ("b", 202601), ("a", 202602)], "lawd_cd string, deal_ym int")
    r = spark.createDataFrame([("1", None, False), ("t", None, True), ("a", "t", False), ("b", "t", False)], "region_cd string, parent_cd string, synthetic boolean")
    got = {(x.region, x.period, x.stat): float(x.value) for x in regions.trade_series(t, ledger, r).collect()}
    assert got[("1", "202601", "TRADE_COUNT")] == 2 and got[("1", "202601", "CANCEL_COUNT")] == 1
    assert got[("1", "202601", "PRICE_M2_MEDIAN")] == 654.76
    assert got[("t", "202601", "TRADE_COUNT")] == 1 and got[("t", "202601", "PRICE_M2_MEDIAN")] == 677.97
    assert not any(k[1] == "202602" for k in got)  # b was not fetched


def series(spark, rows, households):
    s = spark.createDataFrame([(a, "r", p, D(str(v))) for a, p, v in rows], "stat string, region string, period string, value decimal(24,4)")
    h = spark.createDataFrame([("r", y, D(v)) for y, v in households], "region string, year int, value decimal(24,4)")
    return {(x.period, x.metric_code): (None if x.value is None else float(x.value), x.status) for x in regions.region_metrics(s, h).collect()}


def test_region_metrics(spark):
    got = series(spark, [("UNSOLD", "202604", 100), ("UNSOLD", "202607", 250), ("SALE_IDX", "202604", 101.5), ("SALE_IDX", "202607", 100), ("JEONSE_IDX", "202604", 99), ("JEONSE_IDX", "202607", 100)], [(2024, 50000)])
    at = lambda m: got[("202607", m)]
    assert at("UNSOLD_PER_1K_HH") == (5, "OK") and at("UNSOLD_3M_CHG") == (150, "OK")
    assert at("PRICE_IDX_3M_CHG") == (-1.5, "OK") and at("JEONSE_SALE_GAP") == (2.5, "OK")
    zero = series(spark, [("UNSOLD", "202604", 0), ("UNSOLD", "202607", 0), ("UNSOLD", "202610", 10)], [])
    assert zero[("202607", "UNSOLD_3M_CHG")] == (0, "OK") and zero[("202610", "UNSOLD_3M_CHG")] == (None, "ZERO_DENOM")
    assert zero[("202607", "UNSOLD_PER_1K_HH")] == (None, "MISSING")
    built = series(spark, [("PRESALE_12M", "202601", 600), ("PRESALE_12M", "202602", 0), ("MOVEIN_12M_AHEAD", "202601", 1000)], [(2025, 40000)])
    assert built[("202601", "PRESALE_12M_PER_1K_HH")] == (15, "OK") and built[("202602", "PRESALE_12M_PER_1K_HH")] == (0, "OK")
    assert built[("202601", "MOVEIN_12M_AHEAD_PER_1K_HH")] == (25, "OK") and len(built) == 3


def test_roll_up_keeps_own_series_whole(spark):
    p = spark.createDataFrame([("s", "SUM", "a", "1", 1.0), ("s", "SUM", "b", "1", 2.0), ("s", "SUM", "a", "2", 4.0), ("s", "SUM", "own", "1", 9.0), ("s", "SUM", "c", "2", 5.0), ("s", "SUM", "c", "1", None)], "stat string, agg string, region string, period string, value double")
    r = spark.createDataFrame([("a", "t"), ("b", "t"), ("t", None), ("c", "own"), ("own", None)], "region string, parent string")
    got = {(x.region, x.period): x.value for x in grids.roll_up(p, r).collect()}
    assert got[("t", "1")] == 3 and ("t", "2") not in got
    assert got[("own", "1")] == 9 and ("own", "2") not in got


def metric_rows(spark, rows):
    return spark.createDataFrame([("c", p, m, None if v is None else D(str(v)), s) for p, m, v, s in rows], "target string, period string, metric_code string, value decimal(38,4), status string")


def verdicts(spark, code, rows, **params):
    rule = next(r for r in rules.RULES if r.code == code)
    return rules.evaluate(rule, metric_rows(spark, rows), params or None)


def test_interest_coverage_two_quarters_running(spark):
    rows = [("2025Q3", "INTEREST_COVERAGE", 0.5, "OK"), ("2025Q4", "INTEREST_COVERAGE", 1.2, "OK"), ("2026Q2", "INTEREST_COVERAGE", 0.9, "OK")]
    assert not [r for r in verdicts(spark, "R-C02", rows).collect() if r.verdict]
    rows += [("2026Q1", "INTEREST_COVERAGE", 0.8, "OK")]
    got = {r.as_of: r.verdict for r in verdicts(spark, "R-C02", rows).collect()}
    assert got["2026Q2"] is True and got["2026Q1"] is False  # 2025Q4 was above


def test_unknown_stays_unknown(spark):
    rows = [("2025Q3", "OCF_QTR", -40.7, "OK"), ("2025Q4", "OCF_QTR", -25.8, "OK"), ("2026Q1", "OCF_QTR", None, "ZERO_DENOM"), ("2026Q2", "OCF_QTR", None, "ZERO_DENOM")]
    v = verdicts(spark, "R-C03", rows, k=2)
    s = rules.summary(v).first()
    assert s.latest_as_of == "2025Q4" and s.decided and s.findings == ["2025Q4"]
    none = rules.summary(verdicts(spark, "R-C03", rows[2:], k=2)).first()
    assert not none.decided and none.latest_as_of is None


def test_trades_need_a_base(spark):
    def at(base, yoy):
        return [("202501", "TRADE_COUNT", base, "OK"), ("202601", "TRADE_COUNT", 10, "OK"), ("202601", "TRADE_YOY", yoy, "OK"), ("202601", "UNSOLD_3M_CHG", 20, "OK")]

    assert [r.verdict for r in verdicts(spark, "R-R03", at(100, -55)).collect()] == [True]
    assert [r.verdict for r in verdicts(spark, "R-R03", at(20, -60)).collect()] == [False]


def test_pf_exposure_is_kleene(spark):
    rows = [("2025Q1", "PF_GUARANTEE_TO_EQUITY", 120, "OK"), ("2025Q2", "PF_GUARANTEE_TO_EQUITY", 20, "OK"), ("2025Q3", "PF_GUARANTEE_TO_EQUITY", 20, "OK"), ("2025Q3", "PF_DUE_12M_TO_EQUITY", None, "MISSING"), ("2025Q4", "PF_GUARANTEE_TO_EQUITY", None, "MISSING"), ("2025Q4", "PF_DUE_12M_TO_EQUITY", 90, "OK")]
    got = {r.as_of: r.verdict for r in rules.pf_exposure(metric_rows(spark, rows)).collect()}
    assert got == {"2025Q1": True, "2025Q2": False, "2025Q3": None, "2025Q4": None}


def test_risk_shares(spark):
    f = spark.createDataFrame([("c", "A", 600), ("c", "A", 300), ("c", "B", 400), ("c", None, 9999), ("c", "X", 9999)], "entity string, region string, amount long")
    latest = spark.createDataFrame([("A", 6.0), ("B", 1.0)], "region string, value double")
    presale = regions.risk_share(f, latest, 5, unknown_stays=False).first()
    assert (float(presale.share), presale.excluded, presale.n_risky) == (69.23, 1, 2)
    g = spark.createDataFrame([("c", "A", 300), ("c", "B", 100), ("c", None, 900), ("c", "A", None)], "entity string, region string, amount long")
    contracts = regions.risk_share(g, latest, 5, unknown_stays=True).first()
    assert (contracts.n, contracts.total, contracts.risky, float(contracts.share)) == (2, 400, 300, 75.0)


def run_plan(spark, active, fired, single=True, decided=True, latest=None, evaluated=(), version=2):
    a = spark.createDataFrame([("R", v, "t", x) for v, x in active], "rule_code string, rule_version int, target string, as_of string")
    f = spark.createDataFrame([("R", "t", x) for x in fired], "rule_code string, target string, as_of string")
    o = spark.createDataFrame([("R", "t", version, single, decided, latest, list(evaluated))], "rule_code string, target string, version int, single_active boolean, decided boolean, latest_as_of string, evaluated array<string>")
    return sorted((r.as_of, r.rule_version, r.action, r.close_reason) for r in lifecycle.plan(a, f, o).collect())


def test_lifecycle(spark):
    assert run_plan(spark, [(2, "q1")], [], latest="q2") == [("q1", 2, "CLOSE", "RESOLVED")]
    assert run_plan(spark, [(1, "q1")], [], decided=False) == [("q1", 1, "CLOSE", "RULE_CHANGED")]
    assert run_plan(spark, [(2, "q1")], [], decided=False) == []
    assert run_plan(spark, [(2, "q1")], ["q1", "q2"], latest="q2") == [("q1", 2, "STORE_CLOSED", "SUPERSEDED"), ("q2", 2, "OPEN", None)]
    assert run_plan(spark, [(2, "q1")], ["q1"], latest="q2") == [("q1", 2, "STORE_CLOSED", "RESOLVED")]
    assert run_plan(spark, [(2, "x"), (2, "y")], [], single=False, evaluated=["y"]) == [("x", 2, "CLOSE", "EXPIRED"), ("y", 2, "CLOSE", "RESOLVED")]


def test_state_keeps_acknowledgements_and_first_reasons(spark):
    cols = "rule_code string, rule_version int, target string, as_of string"
    state = spark.createDataFrame([("R", 1, "t", "a", "ACK", None, None), ("R", 1, "t", "b", "CLOSED", "EXPIRED", DAY(2026, 1, 1)), ("R", 1, "t", "c", "CLOSED", "EXPIRED", DAY(2026, 1, 1))], f"{cols}, status string, close_reason string, closed_at date")
    planned = spark.createDataFrame([("R", 1, "t", "a", "OPEN", None), ("R", 1, "t", "b", "OPEN", None), ("R", 1, "t", "c", "STORE_CLOSED", "SUPERSEDED"), ("R", 1, "t", "d", "OPEN", None)], f"{cols}, action string, close_reason string")
    got = {r.as_of: (r.status, r.close_reason, r.kind) for r in lifecycle.apply(state, planned, DAY(2026, 2, 2)).collect()}
    assert got == {"a": ("ACK", None, None), "b": ("OPEN", None, "REOPENED"), "c": ("CLOSED", "EXPIRED", None), "d": ("OPEN", None, "NEW")}


def judge(spark, signals, events, to, months=12):
    s = spark.createDataFrame(signals, "rule_code string, corp_code string, date date")
    e = spark.createDataFrame(events, "corp_code string, date date")
    rows = evaluate.judged(evaluate.episodes(s), e, months, to).where("rule_code != 'ANY'").collect()
    return {r.corp_code: (r.outcome, r.lead) for r in rows}


def test_episodes(spark):
    a = [("R", "A", d) for d in (DAY(2024, 5, 15), DAY(2024, 8, 14), DAY(2024, 11, 14))]
    assert judge(spark, a, [("A", DAY(2025, 2, 24))], DAY(2026, 9, 30)) == {"A": ("HIT", 285)}
    b = [("R", "B", DAY(2022, 5, 16)), ("R", "C", DAY(2026, 5, 15)), ("R", "A", DAY(2025, 5, 15))]
    got = judge(spark, b, [("A", DAY(2025, 2, 24))], DAY(2026, 9, 30))
    assert {k: v[0] for k, v in got.items()} == {"B": "MISS", "C": "PENDING", "A": "AFTER_EVENT"}


def test_base_rate(spark):
    corps = spark.createDataFrame([("A",), ("B",)], "corp_code string")
    events = spark.createDataFrame([("A", DAY(2024, 9, 1))], "corp_code string, date date")
    r = evaluate.base_rate(corps, events, DAY(2024, 1, 1), DAY(2025, 12, 31), 12).first()
    assert (r.samples, r.hits) == (7, 3)


def test_wilson_and_periods(spark):
    r = spark.range(1).select(stats.wilson(F.lit(1), F.lit(1)).alias("w"), periods.known_on(F.lit("20260131000001"), F.array(F.lit("20260301000001"), F.lit("x"))).alias("k"), names.corp_key(F.lit("㈜ Ａ건설")).alias("n")).first()
    assert abs(r.w.low - 0.2065) < 1e-4 and r.w.high == 1.0
    assert r.k == DAY(2026, 3, 1) and r.n == "a건설"
    assert periods.iterated_grid(DAY(2024, 8, 31), DAY(2025, 3, 31), 3) == [DAY(2024, 8, 31), DAY(2024, 11, 30), DAY(2025, 2, 28)]
    assert periods.trade_window(DAY(2026, 3, 5), 6) == {"from": 202502, "to": 202602, "refresh_from": 202512, "complete_to": 202601}


def study(spark, prices, events, h, shares=None):
    first = DAY(2026, 1, 1)
    bars = [(s, first + datetime.timedelta(days=i), float(p), float((shares or {}).get(s, {}).get(i, 100))) for s, ps in prices.items() for i, p in enumerate(ps)]
    b = spark.createDataFrame(bars, "stock string, day date, price double, shares double")
    e = spark.createDataFrame([(i, r, s, first + datetime.timedelta(days=d)) for i, r, s, d in events], "id int, rule_code string, stock string, date date")
    return {r.id: r for r in evaluate.event_study(e, b, h).collect()}


def test_event_study(spark):
    flat = {f"p{k}": [100] * 30 for k in range(6)}
    rising = [100] * 10 + [100 * 1.01 ** (i - 9) for i in range(10, 30)]
    got = study(spark, {"A": rising, **flat}, [(1, "R", "A", 9), (2, "R", "A", 25), (3, "R", "none", 3)], 10)
    assert got[1].status == "USED" and got[1].entry == DAY(2026, 1, 11) and got[1].exit == DAY(2026, 1, 21)
    assert abs(got[1].ret - (1.01**10 - 1)) < 1e-9 and got[1].bench == 0 and got[1].peers == 6
    assert got[2].status == "HORIZON_NOT_ELAPSED" and got[3].status == "NO_PRICE"
    broken = study(spark, {"A": rising, **flat}, [(1, "R", "A", 9)], 10, {"A": {i: 150 for i in range(15, 30)}})
    assert broken[1].status == "SHARE_CHANGE"
    over = study(spark, {"A": rising, **flat}, [(1, "R", "A", 2), (2, "R", "A", 5), (3, "S", "A", 5)], 10)
    assert [over[k].status for k in (1, 2, 3)] == ["USED", "OVERLAP", "USED"]
    assert study(spark, {"A": rising, "p": [1] * 30}, [(1, "R", "A", 2)], 10)[1].status == "NO_BENCHMARK"


def test_consortium(spark):
    rows = spark.createDataFrame([("A(주), B(주), C(주)",), ("X(주) 외 2",), ("Y(주) 등",), (None,)], "raw string").select("raw", names.consortium(F.col("raw")).alias("c")).collect()
    got = {r.raw: r.c for r in rows}
    assert len(got["A(주), B(주), C(주)"].names) == 3 and got["X(주) 외 2"].extra == 2 and got["Y(주) 등"].more


def test_builder_links(spark):
    n = spark.createDataFrame([(1, "old"), (2, "one"), (3, "two"), (4, "none")], "id int, name_key string")
    c = spark.createDataFrame([("c1", "one"), ("c3", "two"), ("c2", "two")], "corp_code string, name_key string")
    a = spark.createDataFrame([("old", "c1"), ("none", "gone")], "name_key string, corp_code string")
    got = {r.id: (r.status, r.method, r.corp_code, r.candidates) for r in regions.link_builders(n, c, a).collect()}
    assert got == {1: ("MATCHED", "ALIAS", "c1", []), 2: ("MATCHED", "EXACT", "c1", []), 3: ("AMBIGUOUS", None, None, ["c2", "c3"]), 4: ("UNMATCHED", None, None, [])}


def test_addresses(spark):
    r = spark.createDataFrame([("11010", "종로구", "서울", 2, None), ("41110", "수원시", "경기", 2, None), ("41111", "수원시 장안구", "경기", 3, "41110"), ("26010", "중구", "부산", 2, None), ("27010", "중구", "대구", 2, None)], "region_cd string, name string, sido_name string, level int, parent_cd string")
    t = spark.createDataFrame([("서울 종로구 1-2",), ("경기도 수원시 장안구",), ("부산",), ("중구 3",), ("베트남 하노이",), ("",), (None,)], "text string")
    got = {x.text: (x.match, x.region_cd) for x in regions.match_addresses(t, r, {"서울": "서울", "경기도": "경기", "부산": "부산"}, ["베트남"]).collect()}
    assert got == {"서울 종로구 1-2": ("SIGUNGU", "11010"), "경기도 수원시 장안구": ("SIGUNGU", "41110"), "부산": ("SIDO", None), "중구 3": ("UNKNOWN", None), "베트남 하노이": ("OVERSEAS", None), "": ("NONE", None), None: ("NONE", None)}


def test_tables_with_spans(spark):
    html = "<table><tr><td rowspan=2>a</td><td colspan=2>b</td></tr><tr><td>c</td><td> d  e </td></tr></table>"
    assert filings.grids(html) == [[["a", "b", "b"], ["a", "c", "d e"]]]
    assert filings.grids('<table><tr><td colspan="9999">x</td></tr></table>') == [None]
    d = spark.createDataFrame([(1, html), (2, None)], "id int, html string")
    assert [(r.row_no, r.cells) for r in filings.tables(d, "id", "html").orderBy("row_no").collect()] == [(0, ["a", "b", "b"]), (1, ["a", "c", "d e"])]
    assert {(r.path, r.value) for r in filings.fields(d, "id", "html").collect()} == {("a/b", "b"), ("a/c", "d e")}


def test_an_alias_of_two_companies_is_a_fault(spark):
    n = spark.createDataFrame([(1, "가나"), (2, "다라")], "id int, name_key string")
    c = spark.createDataFrame([("A", "가나"), ("B", "마바")], "corp_code string, name_key string")
    with pytest.raises(Exception, match="the alias 다라 names B and X"):
        regions.link_builders(n, c, spark.createDataFrame([("다라", "B"), ("다라", "X")], "name_key string, corp_code string")).collect()
    got = {r.id: (r.status, r.corp_code) for r in regions.link_builders(n, c, spark.createDataFrame([("다라", "B"), ("다라", "B"), ("가나", "X")], "name_key string, corp_code string")).collect()}
    assert got == {1: ("MATCHED", "A"), 2: ("MATCHED", "B")}


def test_a_dash_is_no_address_and_dictionaries_are_bounded(spark, monkeypatch):
    t = spark.createDataFrame([("-",), (" - ",), ("- -",), ("어딘가",)], "text string")
    r = spark.createDataFrame([("11110", "종로구", "서울", 2, None)], "region_cd string, name string, sido_name string, level int, parent_cd string")
    assert {x.text: x.match for x in regions.match_addresses(t, r, {}).collect()} == {"-": "NONE", " - ": "NONE", "- -": "UNKNOWN", "어딘가": "UNKNOWN"}
    monkeypatch.setattr(regions, "MOST_REGIONS", 0)
    with pytest.raises(ValueError, match="regions"):
        regions.match_addresses(t, r, {})


def test_classes_of_equal_frequency(spark):
    def plain(values):
        v = sorted(values)
        breaks = sorted({v[int(i / 7 * (len(v) - 1))] for i in range(1, 7)})
        return {x: sum(x > b for b in breaks) + 6 - len(breaks) for x in values}

    draw = random.Random(3)
    groups = {"a": [draw.randrange(50) for _ in range(200)], "b": [1, 1, 1], None: [-3, 8], "d": [5]}
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("a", None), ("a", float("nan")), ("e", None)]
    for width in (0.5, 7.0, 1000.0):
        got = {(r.k, r.v, r["class"]) for r in grids.quantile_classes(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", width).collect() if r.v is not None and r.v == r.v}
        assert got == {(k, float(x), c) for k, xs in groups.items() for x, c in plain(xs).items()}
    none = grids.quantile_classes(spark.createDataFrame(rows, "k string, v double").where("v IS NULL OR isnan(v)"), ["k"], "v", 1.0).collect()
    assert len(none) == 3 and all(r["class"] is None for r in none)
