"""Financial statements: standard accounts from raw lines, quarter values, facts and company metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import names, periods, status

#: From this priority on a rule is a fallback.
FALLBACK = 50
#: Accounts and rules are dictionaries that people write; one with more rows than this is taken for another table.
MOST_RULES = 10_000


def decumulate(df: DataFrame, keys: Sequence[str], ordinal: str, cum: str, name: str, kind: str | None = None) -> DataFrame:
    """``df`` with ``name``, the value of the quarter alone; ``ordinal`` counts quarters.

    A first quarter is its own value, later ones are the difference to the quarter before; rows for
    which that one is missing, or of another ``kind`` (column), go.
    """
    w = Window.partitionBy(*keys).orderBy(ordinal).rangeBetween(-1, -1)
    before = F.first(F.struct(F.col(cum).alias("v"), (F.col(kind) if kind else F.lit(0)).alias("k"))).over(w)
    out = df.withColumn("_b", before).withColumn("_first", F.col(ordinal) % 4 == 0)
    usable = F.col("_b").isNotNull() & (F.col("_b.k") == (F.col(kind) if kind else F.lit(0)))
    value = F.when(F.col("_first"), F.col(cum)).when(usable, F.col(cum) - F.col("_b.v"))
    return out.withColumn(name, value).where(F.col(name).isNotNull()).drop("_b", "_first")


def sections(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``lines`` with norm (the normalized name) and section (CURRENT, NONCURRENT or null) of balance-sheet lines."""
    lines = lines.withColumn("norm", names.account_name(F.col("account_nm")))
    n = F.col("norm")
    marker = F.when(F.col("sj_div") != "BS", F.lit(None)).when(n == "유동부채", "CURRENT").when(n == "비유동부채", "NONCURRENT")
    marker = marker.when(n.startswith("부채총계") | n.startswith("자본") | n.startswith("자산") | n.endswith("자산"), "NONE")
    w = Window.partitionBy(*keys, "sj_div").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(marker, ignorenulls=True).over(w)
    header = marker.isNotNull()
    return lines.withColumn("section", F.when(~header & (F.col("sj_div") == "BS") & (seen != "NONE"), seen))


def picks(lines: DataFrame, accounts: DataFrame, rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The lines that make up each standard account: keys, std_code, map_id, line_no, sj_div, name, rcept columns as given, amount.

    ``lines``: keys, sj_div, line_no, account_id, account_nm, amount. ``accounts``: std_code, sj_div,
    flow_type, agg (FIRST or SUM), sort_order. ``rules``: map_id, std_code, sj_div (null: the account's),
    match_type (ACCOUNT_ID, NAME_EXACT, NAME_REGEX), pattern, priority, abs_value, section (null: any).
    Values are the sums of these, so explanation and value are one computation. Lines are claimed by the SUM accounts in their
    order, each line by one of them at most. Rules and accounts are dictionaries of tens of rows; ValueError beyond MOST_RULES.
    """
    keys = list(keys)
    lines = sections(lines, keys)
    same = Window.partitionBy(*keys, "sj_div").orderBy("line_no").rangeBetween(-1, -1)
    lines = lines.withColumn("_echo", F.col("norm").eqNullSafe(F.first("norm").over(same)))
    r = rules.withColumnRenamed("sj_div", "rule_sj").withColumnRenamed("section", "rule_section")
    r = r.join(accounts.withColumnRenamed("sj_div", "std_sj"), "std_code").withColumn("want", F.coalesce("rule_sj", "std_sj"))
    l = lines.where("amount is not null")
    place = (F.col("want") == F.col("sj_div")) | ((F.col("want") == "IS") & (F.col("sj_div") == "CIS"))
    fits = place & (F.col("rule_section").isNull() | (F.col("rule_section") == F.col("section")))
    # ids and names meet on equal keys; expressions are tried on each distinct name once, and they are few
    kind = lambda x: r.where(F.col("match_type") == x)
    by_id = l.join(kind("ACCOUNT_ID").drop("norm"), (F.col("account_id") == F.col("pattern")) & fits)
    by_name = l.join(kind("NAME_EXACT").withColumn("_name", names.account_name(F.col("pattern"))), (F.col("norm") == F.col("_name")) & fits).drop("_name")
    regex = r.where("match_type NOT IN ('ACCOUNT_ID', 'NAME_EXACT')")
    n_rules = regex.limit(MOST_RULES + 1).count()
    if n_rules > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    tried = l.select("norm").where("norm IS NOT NULL").distinct().join(F.broadcast(regex), F.expr("norm rlike concat('^(?:', pattern, ')$')")).withColumnRenamed("norm", "_name")
    by_regex = l.join(tried, (F.col("norm") == F.col("_name")) & fits).drop("_name")
    hits = by_id.unionByName(by_name).unionByName(by_regex)
    hits = hits.withColumn("value", F.when(F.col("abs_value"), F.abs("amount")).otherwise(F.col("amount")))
    out_columns = [*keys, "std_code", "map_id", "sj_div", "line_no", "account_nm", "flow_type", "value"]

    order = Window.partitionBy(*keys, "std_code").orderBy("priority", "map_id", (F.col("sj_div") == "CIS").cast("int"), "line_no")
    out = hits.where("agg = 'FIRST'").withColumn("_k", F.row_number().over(order)).where("_k = 1").select(out_columns)

    taken = None
    summed = accounts.where("agg = 'SUM'").orderBy("sort_order", "std_code").select("std_code").limit(MOST_RULES + 1).collect()
    if len(summed) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} accounts")
    for (code,) in summed:
        own = hits.where((F.col("std_code") == code) & (F.col("agg") == "SUM") & ~F.col("_echo"))
        if taken is not None:
            own = own.join(taken, [*keys, "sj_div", "line_no"], "left_anti")
        # each line once, by its first rule; the fallback tier only where the others matched nothing at all
        first = Window.partitionBy(*keys, "sj_div", "line_no").orderBy("priority", "map_id")
        tier = F.min((F.col("priority") >= FALLBACK).cast("int")).over(Window.partitionBy(*keys))
        own = own.withColumn("_tier", tier).where((F.col("priority") >= FALLBACK).cast("int") == F.col("_tier"))
        own = own.withColumn("_k", F.row_number().over(first)).where("_k = 1")
        claimed = own.select(*keys, "sj_div", "line_no")
        taken = claimed if taken is None else taken.unionByName(claimed)
        out = out.unionByName(own.select(out_columns))
    return out


def standard_values(picked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, std_code, basis (POINT or CUM), amount, source (names in order) from ``picks``."""
    ordered = F.array_sort(F.collect_list(F.struct("map_id", "line_no", "account_nm")))
    out = picked.groupBy(*keys, "std_code", "flow_type").agg(F.sum("value").alias("amount"), F.array_join(F.array_distinct(F.transform(ordered, lambda x: x["account_nm"])), " + ").alias("source"))
    return out.withColumn("basis", F.when(F.col("flow_type") == "POINT", "POINT").otherwise("CUM")).drop("flow_type")


def amounts(raw: DataFrame) -> DataFrame:
    """``raw`` with amount: balance sheets as they stand, income statements year to date, cash flows as given."""
    income = F.col("sj_div").isin("IS", "CIS")
    return raw.withColumn("amount", F.when(income, F.coalesce("thstrm_add_amount", "thstrm_amount")).otherwise(F.col("thstrm_amount")))


def current(raw: DataFrame) -> DataFrame:
    """Lines of the latest receipt of each company, year, report and kind of statement."""
    w = Window.partitionBy("corp_code", "bsns_year", "reprt_code", "fs_div")
    return raw.withColumn("_last", F.max("rcept_no").over(w)).where("rcept_no = _last").drop("_last")


def standardize(raw: DataFrame, accounts: DataFrame, rules: DataFrame) -> DataFrame:
    """corp_code, period_key, fs_div, std_code, basis (POINT, CUM, QTR), amount, source from raw statement lines."""
    keys = ["corp_code", "period_key", "fs_div"]
    lines = amounts(current(raw)).withColumn("period_key", periods.quarter_key(F.col("bsns_year"), F.col("reprt_code")))
    values = standard_values(picks(lines, accounts, rules, keys), keys)
    cum = values.where("basis = 'CUM'").withColumn("_q", periods.quarter_ordinal(F.col("period_key")))
    return values.unionByName(quarters(cum).select(values.columns))


def quarters(cum: DataFrame) -> DataFrame:
    """The QTR rows of cumulative ones with quarter ordinals ``_q``: consolidated where the period has them, else separate."""
    cum = prefer_consolidated(cum, ["corp_code", "std_code", "period_key"])
    q = decumulate(cum, ["corp_code", "std_code"], "_q", "amount", "_v", "fs_div")
    return q.withColumn("amount", F.col("_v")).withColumn("basis", F.lit("QTR"))


def prefer_consolidated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the consolidated statement where a key has one, else of the separate one."""
    has = F.max((F.col("fs_div") == "CFS").cast("int")).over(Window.partitionBy(*keys)) == 1
    return df.withColumn("_cfs", has).where((F.col("fs_div") == "CFS") | ~F.col("_cfs")).drop("_cfs")


#: Column of a period's facts -> basis and standard account.
FACTS = {
    "liabilities": ("POINT", "TOTAL_LIABILITIES"), "equity": ("POINT", "TOTAL_EQUITY"), "assets": ("POINT", "TOTAL_ASSETS"),
    "current_assets": ("POINT", "CURRENT_ASSETS"), "current_liabilities": ("POINT", "CURRENT_LIABILITIES"),
    "short": ("POINT", "SHORT_BORROWINGS"), "long": ("POINT", "LONG_BORROWINGS"), "bonds": ("POINT", "BONDS"),
    "revenue": ("CUM", "REVENUE"), "ocf": ("CUM", "OPERATING_CASH_FLOW"),
    "q_income": ("QTR", "OPERATING_INCOME"), "q_interest": ("QTR", "INTEREST_EXPENSE"), "q_ocf": ("QTR", "OPERATING_CASH_FLOW"),
}


def facts(std: DataFrame) -> DataFrame:
    """One wide row for each company and period, consolidated figures where the period has any."""
    rows = prefer_consolidated(std, ["corp_code", "period_key"])
    pick = lambda b, c: F.max(F.when((F.col("basis") == b) & (F.col("std_code") == c), F.col("amount")))
    return rows.groupBy("corp_code", "period_key").agg(*[pick(*v).alias(k) for k, v in FACTS.items()])


def company_metrics(wide: DataFrame) -> DataFrame:
    """corp_code, period_key, metric_code, value, status: nine metrics of each company and period.

    Changes over a year compare with the same quarter of the year before, by key. Null is MISSING
    before 0 is ZERO_DENOM before a negative denominator gets its own status.
    """
    c = F.col
    w = wide.withColumn("_q", periods.quarter_ordinal(c("period_key")))
    ago = Window.partitionBy("corp_code").orderBy("_q").rangeBetween(-4, -4)
    debts = F.coalesce("short", F.when(F.coalesce("long", "bonds").isNotNull(), 0)) + F.coalesce("long", F.lit(0)) + F.coalesce("bonds", F.lit(0))
    assets = F.when(c("assets") <= 0, 0).otherwise(c("assets"))
    w = w.withColumn("DEBT_RATIO", status.ratio(c("liabilities"), c("equity"), negative=status.NEGATIVE))
    w = w.withColumn("CURRENT_RATIO", status.ratio(c("current_assets"), c("current_liabilities"), negative=status.INCONSISTENT))
    w = w.withColumn("BORROWING_DEP", status.ratio(debts, assets))
    w = w.withColumn("INTEREST_COVERAGE", status.ratio(c("q_income"), c("q_interest"), 1, status.INCONSISTENT))
    w = w.withColumn("OCF_MARGIN", status.ratio(c("ocf"), c("revenue"), negative=status.INCONSISTENT))
    w = w.withColumn("OCF_QTR", status.valued(c("q_ocf"), F.when(c("q_ocf").isNull(), status.MISSING).otherwise(status.OK)))
    for m in ("DEBT_RATIO", "BORROWING_DEP"):
        w = w.withColumn(f"{m}_YOY", status.difference(status.known(c(m)), status.known(F.first(m).over(ago))))
    w = w.withColumn("REVENUE_YOY", status.growth(c("revenue"), F.first("revenue").over(ago)))
    codes = ["DEBT_RATIO", "DEBT_RATIO_YOY", "CURRENT_RATIO", "BORROWING_DEP", "BORROWING_DEP_YOY", "INTEREST_COVERAGE", "OCF_MARGIN", "OCF_QTR", "REVENUE_YOY"]
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric_code"), c(f"{m}.value").alias("value"), c(f"{m}.status").alias("status")) for m in codes]))
    return w.select("corp_code", "period_key", rows.alias("m")).select("corp_code", "period_key", "m.*")


def pf_metrics(reports: DataFrame, equity: DataFrame) -> DataFrame:
    """corp_code, period_key, metric_code, value, status from the latest report of each company and period.

    ``reports``: corp_code, period_key, rcept_no, guarantee, bridge_guarantee, due_within_12m;
    ``equity``: corp_code, period_key, equity.
    """
    c = F.col
    latest = reports.groupBy("corp_code", "period_key").agg(F.max_by(F.struct("guarantee", "bridge_guarantee", "due_within_12m"), "rcept_no").alias("r")).select("corp_code", "period_key", "r.*")
    w = latest.join(equity, ["corp_code", "period_key"], "left")
    metrics = {
        "PF_GUARANTEE_TO_EQUITY": status.ratio(c("guarantee"), c("equity"), negative=status.NEGATIVE),
        "PF_DUE_12M_TO_EQUITY": status.ratio(c("due_within_12m"), c("equity"), negative=status.NEGATIVE),
        "PF_BRIDGE_SHARE": status.ratio(c("bridge_guarantee"), c("guarantee")),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("metric_code"), v.alias("m")) for k, v in metrics.items()]))
    return w.select("corp_code", "period_key", rows.alias("x")).select("corp_code", "period_key", "x.metric_code", "x.m.*")
