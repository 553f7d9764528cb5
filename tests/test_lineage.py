"""Walks from alerts to lines, provenance of regions, and values that are worked out again."""

from decimal import Decimal as D

from tidewatch.operators import lineage as ln


def edges_of(rows):
    return {(r.parent, r.child, r.role) for r in rows.collect()}


def table(spark, kind, *rows):
    return spark.createDataFrame([tuple(D(x) if isinstance(x, float) else x for x in r) for r in rows], kind)


STATEMENTS = "corp_code string, period_key string, fs_div string, std_code string, basis string, amount decimal(24,0)"
LINES = "corp_code string, period_key string, fs_div string, std_code string, map_id int, sj_div string, line_no int, value decimal(24,0)"
LEGS = "corp_code string, period_key string, metric_code string, leg string, fs_div string, std_code string, basis string, amount decimal(24,0)"


def company(spark):
    s = table(
        spark, STATEMENTS,
        ("A", "2025Q1", "CFS", "OP", "CUM", 100.0), ("A", "2025Q1", "CFS", "OP", "QTR", 100.0), ("A", "2025Q2", "CFS", "OP", "CUM", 250.0), ("A", "2025Q2", "CFS", "OP", "QTR", 150.0),
        ("A", "2025Q3", "CFS", "OP", "CUM", 330.0), ("A", "2025Q3", "CFS", "OP", "QTR", 80.0), ("A", "2025Q2", "CFS", "DEBT", "POINT", 40.0), ("A", "2025Q4", "CFS", "OP", "QTR", 7.0),
    )
    lines = table(
        spark, LINES,
        ("A", "2025Q1", "CFS", "OP", 1, "IS", 5, 100.0), ("A", "2025Q2", "CFS", "OP", 1, "IS", 5, 200.0), ("A", "2025Q2", "CFS", "OP", 2, "IS", 6, 50.0),
        ("A", "2025Q3", "CFS", "OP", 1, "IS", 5, 331.0), ("A", "2025Q2", "CFS", "DEBT", 3, "BS", 9, 40.0),
    )
    return s, lines


def test_what_statements_are_made_of_gives_them_again(spark):
    s, lines = company(spark)
    got = {(r.period_key, r.std_code, r.basis): (r.expected, r.n_lines, r.derivation, r.reproduced) for r in ln.reproduced(s, lines).collect()}
    assert got == {
        ("2025Q1", "OP", "CUM"): (100, 1, None, True), ("2025Q1", "OP", "QTR"): (100, 0, "2025Q1 CUM", True),
        ("2025Q2", "OP", "CUM"): (250, 2, None, True), ("2025Q2", "OP", "QTR"): (150, 0, "2025Q2 CUM - 2025Q1 CUM", True),
        # the year to date was corrected since: neither it nor the quarter is what its lines say
        ("2025Q3", "OP", "CUM"): (331, 1, None, False), ("2025Q3", "OP", "QTR"): (80, 0, "2025Q3 CUM - 2025Q2 CUM", False),
        ("2025Q2", "DEBT", "POINT"): (40, 1, None, True), ("2025Q4", "OP", "QTR"): (None, 0, "2025Q4 CUM - 2025Q3 CUM", False),
    }


def test_an_alert_leads_to_lines(spark):
    """Alert, change over a year, metric, quarter, two cumulatives, lines."""
    s, lines = company(spark)
    seen = spark.createDataFrame([(7, "R-1", "COMPANY", "A", "2025Q2", None), (7, "R-1", "COMPANY", "A", None, "r9")], "alert_id int, rule_code string, target_type string, target string, period string, rcept_no string")
    rules = spark.createDataFrame([("R-1", "COVER_YOY"), ("R-2", "OTHER")], "rule_code string, metric_code string")
    legs = table(spark, LEGS, ("A", "2025Q2", "COVER", "numerator", "CFS", "OP", "QTR", 150.0), ("A", "2025Q2", "COVER", "denominator", "CFS", "DEBT", None, 40.0), ("A", "2024Q2", "COVER", "numerator", "CFS", "GONE", None, 1.0))
    metrics = spark.createDataFrame([("A", "2025Q2", "COVER_YOY"), ("A", "2025Q2", "COVER")], "corp_code string, period_key string, metric_code string")
    edges = ln.alert_edges(seen, rules).unionByName(ln.metric_edges(legs, s, metrics)).unionByName(ln.statement_edges(s, lines))
    roots = spark.createDataFrame([(7, "ALERT|7"), (8, "ALERT|8"), (9, None)], "root int, node string")
    got = {(r.root, r.depth, r.node, r.role) for r in ln.walk(roots, edges).collect()}
    q, m = "STATEMENT|A|2025Q{}|CFS|OP|{}", "METRIC|COMPANY|A|{}|{}"
    assert got == {
        (7, 0, "ALERT|7", None), (8, 0, "ALERT|8", None), (7, 1, "FILING|r9", "OBSERVED"), (7, 1, m.format("2025Q2", "COVER_YOY"), "OBSERVED"),
        (7, 2, m.format("2025Q2", "COVER"), "NOW"), (7, 2, m.format("2024Q2", "COVER"), "YEAR_AGO"),
        (7, 3, q.format(2, "QTR"), "NUMERATOR"), (7, 3, "STATEMENT|A|2025Q2|CFS|DEBT|POINT", "DENOMINATOR"),
        (7, 4, q.format(2, "CUM"), "THIS_QUARTER"), (7, 4, q.format(1, "CUM"), "QUARTER_BEFORE"), (7, 4, "LINE|A|2025Q2|CFS|BS|9", "RULE 3"),
        (7, 5, "LINE|A|2025Q2|CFS|IS|5", "RULE 1"), (7, 5, "LINE|A|2025Q2|CFS|IS|6", "RULE 2"), (7, 5, "LINE|A|2025Q1|CFS|IS|5", "RULE 1"),
    }


def test_walks_end_in_circles_and_take_the_shortest_way(spark):
    e = spark.createDataFrame([("a", "b", "x"), ("b", "a", "x"), ("b", "c", "x"), ("a", "c", "z"), ("a", "c", "y"), ("c", "d", "x"), (None, "d", "x"), ("d", None, "x")], "parent string, child string, role string")
    roots = spark.createDataFrame([(1, "a"), (2, "c"), (1, "a")], "root int, node string")
    got = {(r.root, r.node, r.depth, r.parent, r.role) for r in ln.walk(roots, e).collect()}
    assert got == {(1, "a", 0, None, None), (1, "b", 1, "a", "x"), (1, "c", 1, "a", "y"), (1, "d", 2, "c", "x"), (2, "c", 0, None, None), (2, "d", 1, "c", "x")}
    assert ln.walk(roots.limit(0), e).count() == 0 and ln.walk(roots, e.limit(0)).count() == 2


def test_the_basis_is_told_from_the_amount(spark):
    s, _ = company(spark)
    legs = table(spark, LEGS, ("A", "2025Q1", "M", "numerator", "CFS", "OP", None, 100.0), ("A", "2025Q1", "M", "denominator", "CFS", "OP", None, 3.0), ("A", "2025Q1", "N", "numerator", "CFS", "OP", "QTR", None))
    assert {(r.metric_code, r.basis) for r in ln.with_basis(legs, s).collect()} == {("M", "CUM"), ("N", "QTR")}


def region(spark):
    stats = spark.createDataFrame(
        [("UNSOLD", "city", "202601", 9.0), ("UNSOLD", "a", "202601", 2.0), ("UNSOLD", "a", "202604", 3.0), ("UNSOLD", "b", "202604", 4.0), ("UNSOLD", "b", "202605", None), ("UNSOLD", "a", "202605", 1.0),
         ("SALE_IDX", "a", "202604", 100.0), ("SALE_IDX", "b", "202604", 102.0), ("HOUSEHOLDS", "a", "2024", 10.0), ("HOUSEHOLDS", "b", "2024", 20.0), ("HOUSEHOLDS", "a", "2027", 99.0)],
        "stat string, region string, period string, value double",
    )
    regions = spark.createDataFrame([("city", None), ("a", "city"), ("b", "city")], "region_cd string, parent_cd string")
    return stats, regions


def test_regions_keep_what_they_were_rolled_up_from(spark):
    stats, regions = region(spark)
    got = {(r.stat, r.region, r.period): (r.role, r.value, [tuple(x) for x in r.sources]) for r in ln.rolled_up(stats, regions, ["SALE_IDX"]).collect()}
    assert got["UNSOLD", "city", "202601"] == ("OWN", 9.0, [("city", 9.0)])
    assert got["UNSOLD", "city", "202604"] == ("CHILD", 7.0, [("a", 3.0), ("b", 4.0)])
    assert got["UNSOLD", "city", "202605"] == ("CHILD", None, [("a", 1.0), ("b", None)])
    assert got["SALE_IDX", "city", "202604"] == ("CHILD", 101.0, [("a", 100.0), ("b", 102.0)])
    assert got["UNSOLD", "a", "202604"] == ("OWN", 3.0, [("a", 3.0)])


def test_region_metrics_lead_to_statistics(spark):
    stats, regions = region(spark)
    metrics = spark.createDataFrame([("city", "202604", "UNSOLD_3M_CHG"), ("city", "202604", "UNSOLD_PER_1K_HH"), ("city", "202604", "UNKNOWN"), ("b", "202601", "UNSOLD_UNITS")], "region string, period string, metric_code string")
    chg, per = "METRIC|REGION|city|202604|UNSOLD_3M_CHG", "METRIC|REGION|city|202604|UNSOLD_PER_1K_HH"
    assert edges_of(ln.region_edges(metrics, stats, regions)) == {
        (chg, "STAT|UNSOLD|a|202604", "CHILD"), (chg, "STAT|UNSOLD|b|202604", "CHILD"), (chg, "STAT|UNSOLD|city|202601", "OWN"),
        (per, "STAT|UNSOLD|a|202604", "CHILD"), (per, "STAT|UNSOLD|b|202604", "CHILD"), (per, "STAT|HOUSEHOLDS|a|2024", "CHILD"), (per, "STAT|HOUSEHOLDS|b|2024", "CHILD"),
    }


def test_filings_and_notices(spark):
    observed = spark.createDataFrame([(1, "c1", None, "202604"), (1, "c2", None, None), (2, None, "n1", "202605"), (2, None, "n2", None)], "alert_id int, rcept_no string, notice_no string, unsold_period string")
    contracts = spark.createDataFrame([("c1", "city"), ("c2", "city"), ("c3", None)], "rcept_no string, region_cd string")
    presales = spark.createDataFrame([("n1", "a", "A"), ("n1", "a", None), ("n2", None, "B")], "notice_no string, region_cd string, corp_code string")
    reports = spark.createDataFrame([("A", "2025Q2", "p1")], "corp_code string, period_key string, rcept_no string")
    got = edges_of(ln.filing_edges(contracts, presales, observed, reports))
    unsold = "METRIC|REGION|{}|{}|UNSOLD_PER_1K_HH"
    assert got == {
        ("FILING|c1", unsold.format("city", "202604"), "WHERE"), ("ALERT|2", "PRESALE|n1", "OBSERVED"), ("ALERT|2", "PRESALE|n2", "OBSERVED"),
        ("PRESALE|n1", unsold.format("a", "202605"), "WHERE"), ("PRESALE|n1", "COMPANY|A", "BUILDER"), ("PRESALE|n2", "COMPANY|B", "BUILDER"),
        *((f"METRIC|COMPANY|A|2025Q2|{m}", "FILING|p1", "REPORT") for m in ("PF_GUARANTEE_TO_EQUITY", "PF_DUE_12M_TO_EQUITY", "PF_BRIDGE_SHARE")),
    }
