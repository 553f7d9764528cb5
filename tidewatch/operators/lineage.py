"""Where an alert's values come from: a typed graph of alerts, metrics, statements, lines, statistics and filings, and walks over it.

A node is a text, its kind and its key joined by bars; an edge is (parent, child, role). Each kind of edge is a join of the tables
that the values were made from, so that the graph needs no record kept beside them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import periods
from tidewatch.session import cut

#: Metrics that are changes over a year end in this; what is before it is the metric that changed.
YEAR = "_YOY"
#: Series that a region's metric is made of, and how many months back; HOUSEHOLDS are of the latest year that is not after the month's.
REGION_INPUTS = {
    "UNSOLD_UNITS": [("UNSOLD", 0)],
    "UNSOLD_3M_CHG": [("UNSOLD", 0), ("UNSOLD", 3)],
    "UNSOLD_PER_1K_HH": [("UNSOLD", 0), ("HOUSEHOLDS", 0)],
    "PRICE_IDX_3M_CHG": [("SALE_IDX", 0), ("SALE_IDX", 3)],
    "JEONSE_IDX_3M_CHG": [("JEONSE_IDX", 0), ("JEONSE_IDX", 3)],
    "TRADE_COUNT": [("TRADE_COUNT", 0)],
    "TRADE_YOY": [("TRADE_COUNT", 0), ("TRADE_COUNT", 12)],
    "CANCEL_RATE": [("TRADE_COUNT", 0), ("CANCEL_COUNT", 0)],
    "PRICE_M2_MEDIAN": [("PRICE_M2_MEDIAN", 0)],
    "PRICE_M2_YOY": [("PRICE_M2_MEDIAN", 0), ("PRICE_M2_MEDIAN", 12)],
    "PRESALE_12M_PER_1K_HH": [("PRESALE_12M", 0), ("HOUSEHOLDS", 0)],
    "MOVEIN_12M_AHEAD_PER_1K_HH": [("MOVEIN_12M_AHEAD", 0), ("HOUSEHOLDS", 0)],
}
HOUSEHOLDS = "HOUSEHOLDS"


def node(kind: str, *parts: Column | str) -> Column:
    """The name of a node; a null part is a dash."""
    return F.concat_ws("|", F.lit(kind), *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("-")) for p in parts])


def _edge(parent: Column, child: Column, role: Column | str) -> list[Column]:
    return [parent.alias("parent"), child.alias("child"), (F.lit(role) if isinstance(role, str) else role).alias("role")]


def alert_edges(observations: DataFrame, rule_metrics: DataFrame) -> DataFrame:
    """Alerts to what their evidence names: metrics of the periods observed, and filings.

    ``observations``: alert_id, rule_code, target_type (COMPANY or REGION), target, period, rcept_no, each of the last two may be null;
    ``rule_metrics``: rule_code, metric_code, a dictionary of tens of rows.
    """
    alert = node("ALERT", "alert_id")
    metrics = observations.where("period IS NOT NULL").join(rule_metrics, "rule_code")
    found = metrics.select(*_edge(alert, node("METRIC", "target_type", "target", "period", "metric_code"), "OBSERVED"))
    return found.unionByName(observations.where("rcept_no IS NOT NULL").select(*_edge(alert, node("FILING", "rcept_no"), "OBSERVED"))).distinct()


def with_basis(legs: DataFrame, statements: DataFrame) -> DataFrame:
    """``legs`` with the basis where it is null: that of the statement of equal amount, POINT before CUM before QTR; legs without one go."""
    keys = ["corp_code", "period_key", "fs_div", "std_code"]
    rank = F.expr("array_position(array('POINT', 'CUM', 'QTR'), basis)")
    like = statements.groupBy(*keys, "amount").agg(F.min_by("basis", rank).alias("_basis"))
    whole = legs.where("basis IS NOT NULL")
    found = legs.where("basis IS NULL").drop("basis").join(like, [*keys, "amount"]).withColumnRenamed("_basis", "basis")
    return whole.unionByName(found.select(whole.columns))


def metric_edges(legs: DataFrame, statements: DataFrame, metrics: DataFrame) -> DataFrame:
    """Company metrics to the statements that they divide, and changes over a year to the metric then and now.

    ``legs``: corp_code, period_key, metric_code, leg, fs_div, std_code, basis (null: to be told from the amount), amount;
    ``statements``: corp_code, period_key, fs_div, std_code, basis, amount; ``metrics``: corp_code, period_key, metric_code.
    """
    metric = lambda period, code: node("METRIC", F.lit("COMPANY"), "corp_code", period, code)
    statement = node("STATEMENT", "corp_code", "period_key", "fs_div", "std_code", "basis")
    found = with_basis(legs, statements).select(*_edge(metric("period_key", "metric_code"), statement, F.upper("leg")))
    base = F.expr(f"substring(metric_code, 1, length(metric_code) - {len(YEAR)})")
    changes = metrics.where(F.col("metric_code").endswith(YEAR))
    when = F.explode(F.array(F.struct(F.lit("NOW").alias("role"), F.col("period_key").alias("period")), F.struct(F.lit("YEAR_AGO").alias("role"), periods.shift_quarter(F.col("period_key"), -4).alias("period"))))
    years = changes.withColumn("_at", when).select(*_edge(metric("period_key", "metric_code"), metric(F.col("_at.period"), base), F.col("_at.role")))
    return found.unionByName(years).distinct()


def statement_edges(statements: DataFrame, lines: DataFrame) -> DataFrame:
    """Quarters to the year-to-date statements that they are differences of, other statements to the lines that they sum up.

    ``lines`` are the picks of standard accounts: corp_code, period_key, fs_div, std_code, map_id, sj_div, line_no.
    """
    of = lambda period, basis: node("STATEMENT", "corp_code", period, "fs_div", "std_code", basis)
    both = F.array(F.struct(F.lit("THIS_QUARTER").alias("role"), F.col("period_key").alias("period")), F.struct(F.lit("QUARTER_BEFORE").alias("role"), periods.shift_quarter(F.col("period_key"), -1).alias("period")))
    needed = F.when(periods.quarter_ordinal(F.col("period_key")) % 4 == 0, F.slice(both, 1, 1)).otherwise(both)
    quarters = statements.where("basis = 'QTR'").withColumn("_at", F.explode(needed)).select(*_edge(of("period_key", "basis"), of(F.col("_at.period"), F.lit("CUM")), F.col("_at.role")))
    line = node("LINE", "corp_code", "period_key", "fs_div", "sj_div", "line_no")
    summed = statements.where("basis != 'QTR'").select("corp_code", "period_key", "fs_div", "std_code", "basis").join(lines, ["corp_code", "period_key", "fs_div", "std_code"])
    return quarters.unionByName(summed.select(*_edge(of("period_key", "basis"), line, F.concat(F.lit("RULE "), F.col("map_id").cast("string")))))


def sources(stats: DataFrame, regions: DataFrame) -> DataFrame:
    """(stat, region, period, role, source, value): the rows behind each region's value of a series.

    A region that has a row of its own for a period has that one alone (OWN), else those of the regions below it (CHILD).
    ``stats``: stat, region, period, value; ``regions``: region_cd, parent_cd.
    """
    up = regions.where("parent_cd IS NOT NULL").select(F.col("region_cd").alias("region"), "parent_cd")
    own = stats.select("stat", "region", "period", F.lit("OWN").alias("role"), F.col("region").alias("source"), "value")
    below = stats.join(up, "region").select("stat", F.col("parent_cd").alias("region"), "period", F.lit("CHILD").alias("role"), F.col("region").alias("source"), "value")
    both = own.unionByName(below)
    has_own = F.max((F.col("role") == "OWN").cast("int")).over(Window.partitionBy("stat", "region", "period")) == 1
    return both.withColumn("_own", has_own).where("role = 'OWN' OR NOT _own").drop("_own")


def rolled_up(stats: DataFrame, regions: DataFrame, means: Sequence[str] = ()) -> DataFrame:
    """(stat, region, period, value, role, sources): each region's value, summed up from its rows or, for the series in ``means``, their mean.

    ``sources`` lists (source, value) in order, so that a value can be worked out again from what is listed. A source without a value makes it unknown.
    """
    rows = sources(stats, regions)
    value = F.when(F.count("*") == F.count("value"), F.when(F.col("stat").isin(list(means)), F.avg("value")).otherwise(F.sum("value")))
    listed = F.array_sort(F.collect_list(F.struct("source", "value")))
    return rows.groupBy("stat", "region", "period", "role").agg(value.alias("value"), listed.alias("sources"))


def region_edges(metrics: DataFrame, stats: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions' metrics to the statistics that they were made of, by way of the regions below where these were rolled up.

    ``metrics``: region, period (month), metric_code; ``stats`` has households by year as its own stat. A
    metric has the inputs of REGION_INPUTS; one whose input has no row has no edge for it.
    """
    inputs = [(m, s, back) for m, parts in REGION_INPUTS.items() for s, back in parts]
    table = F.broadcast(metrics.sparkSession.createDataFrame(inputs, "metric_code string, stat string, back int"))  # some twenty rows
    wanted = metrics.select("region", "period", "metric_code").join(table, "metric_code").withColumn("_month", periods.month_of_ordinal(periods.month_ordinal(F.col("period")) - F.col("back")))
    rows = sources(stats, regions)
    monthly = wanted.where(F.col("stat") != HOUSEHOLDS).withColumn("_period", F.col("_month"))
    # the latest year of a region that is not after the month's: years and months in one order
    years = rows.where(F.col("stat") == HOUSEHOLDS).select("region", F.col("period").alias("_year")).distinct()
    months = wanted.where(F.col("stat") == HOUSEHOLDS)
    stacked = months.withColumn("_y", F.substring("_month", 1, 4)).unionByName(years.withColumn("_y", F.col("_year")), allowMissingColumns=True)
    latest = F.max("_year").over(Window.partitionBy("region").orderBy("_y").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    yearly = stacked.withColumn("_period", latest).where("metric_code IS NOT NULL AND _period IS NOT NULL").select(monthly.columns)
    found = monthly.unionByName(yearly).join(rows.withColumnRenamed("period", "_period").drop("value"), ["stat", "region", "_period"])
    return found.select(*_edge(node("METRIC", F.lit("REGION"), "region", "period", "metric_code"), node("STAT", "stat", "source", "_period"), F.col("role"))).distinct()


def filing_edges(contracts: DataFrame, presales: DataFrame, observed: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """Filings and presale notices to what they were judged by, and metrics of project finance to their report.

    ``observed``: alert_id, rcept_no, notice_no (one of both null), unsold_period (month, may be null). An alert leads to its notice; a contract
    (rcept_no, region_cd) or notice (notice_no, region_cd) leads to the unsold homes of its region in that month, and a notice's
    builder leads on to companies (presales: notice_no, region_cd, corp_code, one row for each builder). ``reports``: corp_code, period_key, rcept_no.
    """
    unsold = node("METRIC", F.lit("REGION"), "region_cd", "unsold_period", F.lit("UNSOLD_PER_1K_HH"))
    months = observed.where("unsold_period IS NOT NULL")
    filing, notice = node("FILING", "rcept_no"), node("PRESALE", "notice_no")
    found = months.join(contracts.where("region_cd IS NOT NULL"), "rcept_no").select(*_edge(filing, unsold, "WHERE"))
    found = found.unionByName(observed.where("notice_no IS NOT NULL").select(*_edge(node("ALERT", "alert_id"), notice, "OBSERVED")))
    found = found.unionByName(months.join(presales.where("region_cd IS NOT NULL"), "notice_no").select(*_edge(notice, unsold, "WHERE")))
    found = found.unionByName(presales.where("corp_code IS NOT NULL").select(*_edge(notice, node("COMPANY", "corp_code"), "BUILDER")))
    if reports is not None:
        codes = F.explode(F.array(*[F.lit(m) for m in ("PF_GUARANTEE_TO_EQUITY", "PF_DUE_12M_TO_EQUITY", "PF_BRIDGE_SHARE")]))
        of = reports.withColumn("metric_code", codes)
        found = found.unionByName(of.select(*_edge(node("METRIC", F.lit("COMPANY"), "corp_code", "period_key", "metric_code"), filing, "REPORT")))
    return found.distinct()


def walk(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, node, depth, parent, role): every node that can be reached from each root (root, node), once, at its least depth.

    Of several edges to a node at that depth the one with the smallest parent and role is told. Each round joins the nodes found last
    with the edges and is checkpointed; nodes seen before are left out, so circles end. Null roots and edges with a null end lead nowhere.
    """
    edges = cut(edges.where("parent IS NOT NULL AND child IS NOT NULL").select("parent", "child", "role").distinct())
    blank = F.lit(None).cast("string")
    last = cut(roots.where("node IS NOT NULL").select("root", "node").distinct().select("root", "node", F.lit(0).alias("depth"), blank.alias("parent"), blank.alias("role")))
    found = last
    depth = 0
    while not last.isEmpty():
        depth += 1
        step = last.select("root", F.col("node").alias("parent")).join(edges, "parent")
        step = step.groupBy("root", F.col("child").alias("node")).agg(F.min(F.struct("parent", "role")).alias("by"))
        new = step.join(found.select("root", "node"), ["root", "node"], "left_anti")
        last = cut(new.select("root", "node", F.lit(depth).alias("depth"), "by.parent", "by.role"))
        found = found.unionByName(last)
    return found


def reproduced(statements: DataFrame, lines: DataFrame) -> DataFrame:
    """``statements`` with expected, n_lines, derivation and reproduced: whether what they were made from gives them again.

    Year-to-date and balance rows are the sums of their lines (value); a quarter is the year to date less that of the quarter
    before, the first of a year that alone, and is reproduced only if both of these are. ``statements``: corp_code, period_key, fs_div, std_code, basis, amount.
    """
    c = F.col
    keys = ["corp_code", "period_key", "fs_div", "std_code"]
    sums = lines.groupBy(*keys).agg(F.sum("value").alias("_sum"), F.count("*").alias("_lines"))
    s = statements.join(sums, keys, "left").withColumn("_q", periods.quarter_ordinal(c("period_key")))
    quarter = c("basis") == "QTR"
    s = s.withColumn("_ok", ~quarter & F.coalesce(c("_sum") == c("amount"), F.lit(False)))
    order = Window.partitionBy("corp_code", "fs_div", "std_code").orderBy("_q")
    cum = F.when(c("basis") == "CUM", F.struct(c("amount").alias("v"), c("_ok").alias("ok")))
    now, before = (F.max(cum).over(order.rangeBetween(-k, -k)) for k in (0, 1))
    s = s.withColumns({"_now": now, "_before": before})
    first = c("_q") % 4 == 0
    expected = F.when(~quarter, c("_sum")).when(first, c("_now.v")).otherwise(c("_now.v") - c("_before.v"))
    parts = c("_now.ok") & (first | c("_before.ok"))
    told = F.when(quarter, F.when(first, F.concat("period_key", F.lit(" CUM"))).otherwise(F.concat("period_key", F.lit(" CUM - "), periods.shift_quarter(c("period_key"), -1), F.lit(" CUM"))))
    s = s.withColumns({"expected": expected, "n_lines": F.when(quarter, 0).otherwise(F.coalesce("_lines", F.lit(0))), "derivation": told})
    right = F.coalesce((c("expected") == c("amount")) & (~quarter | parts), F.lit(False))
    return s.withColumn("reproduced", right).select(*statements.columns, "expected", "n_lines", "derivation", "reproduced")
