"""What each company is exposed to: contracts, guarantees, project finance, presales and open alerts, a row for each company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import status
from tidewatch.operators import filings, ordered


def _share(part: Column, whole: Column) -> Column:
    """Percent of a whole, to two places; null where the whole is not above 0."""
    exact = "decimal(28,4)"
    return F.when(whole > 0, F.round(F.coalesce(part, F.lit(0)).cast(exact) * 100 / whole.cast(exact), 2).cast("decimal(18,2)"))


def of_contracts(contracts: DataFrame, unsold: DataFrame, since, threshold: float) -> DataFrame:
    """corp_code, n_contracts, total, mapped, risky, risky_share, n_risky of the contracts that are current and not older than ``since``.

    ``contracts``: corp_code, rcept_dt, amount, region_cd, superseded_by, terminated_by; ``unsold``: region_cd, value, the latest of each region. Amounts
    in regions at or over the threshold are risky; the share is one of what has a region.
    """
    now = contracts.where(filings.is_current() & (F.col("rcept_dt") >= F.lit(since))).join(unsold.select("region_cd", F.col("value").alias("_unsold")), "region_cd", "left")
    risky = F.col("_unsold") >= threshold
    out = now.groupBy("corp_code").agg(
        F.count("*").alias("n_contracts"), F.sum("amount").alias("total"), F.sum(F.when(F.col("region_cd").isNotNull(), F.col("amount"))).alias("mapped"),
        F.sum(F.when(risky, F.col("amount"))).alias("risky"), F.count_if(risky).alias("n_risky"),
    )
    return out.withColumn("risky_share", _share(F.col("risky"), F.col("mapped")))


def of_guarantees(guarantees: DataFrame, since) -> DataFrame:
    """corp_code, guarantee_ratio, guarantee_date of the latest guarantee, and pf_guaranteed of all since: superseded ones are left out.

    ``guarantees``: corp_code, rcept_no, rcept_dt, equity, total_balance, pf_amount, superseded_by.
    """
    now = guarantees.where(F.col("superseded_by").isNull() & (F.col("rcept_dt") >= F.lit(since)))
    last = ordered.latest_per(now, ["corp_code"], F.col("rcept_dt").desc(), F.col("rcept_no").desc())
    last = last.select("corp_code", F.when(F.col("equity") > 0, _share(F.col("total_balance"), F.col("equity"))).alias("guarantee_ratio"), F.col("rcept_dt").alias("guarantee_date"))
    return last.join(now.groupBy("corp_code").agg(F.sum("pf_amount").alias("pf_guaranteed")), "corp_code")


def of_project_finance(reports: DataFrame, metrics: DataFrame) -> DataFrame:
    """corp_code, pf_period, pf_status, pf_to_equity, pf_due_to_equity of the quarter of each company's latest report.

    Where that quarter's ratio is not OK its status is told and no value; an older quarter never stands in. ``reports``: corp_code,
    period_key, rcept_no; ``metrics``: corp_code, period_key, metric_code, value, status.
    """
    last = reports.groupBy("corp_code").agg(F.max_by("period_key", F.struct("period_key", "rcept_no")).alias("period_key"))
    ok = F.when(F.col("status") == status.OK, F.col("value"))
    of = lambda code, x, name: F.max(F.when(F.col("metric_code") == code, x)).alias(name)
    main = "PF_GUARANTEE_TO_EQUITY"
    wide = metrics.groupBy("corp_code", "period_key").agg(of(main, F.col("status"), "pf_status"), of(main, ok, "pf_to_equity"), of("PF_DUE_12M_TO_EQUITY", ok, "pf_due_to_equity"))
    return last.join(wide.where("pf_status IS NOT NULL"), ["corp_code", "period_key"]).withColumnRenamed("period_key", "pf_period")


def of_presales(presales: DataFrame, builders: DataFrame, remainders: DataFrame, unsold: DataFrame, since, threshold: float) -> DataFrame:
    """corp_code, n_presales, presale_units, presale_risky, presale_risky_share, remaining_units of the notices that a company builds.

    ``presales``: notice, notice_date, units, region_cd, removed_at; ``builders``: notice, corp_code, status; ``remainders``: notice,
    notice_date, units, removed_at. A company that is named twice counts once; units are not divided between builders. The share is one of
    units in regions with a value; remainders are those of these notices.
    """
    live = lambda d: d.where(F.col("removed_at").isNull() & (F.col("notice_date") >= F.lit(since)))
    mine = builders.where("status = 'MATCHED'").select("notice", "corp_code").distinct()
    n = live(presales).select("notice", F.coalesce("units", F.lit(0)).alias("units"), "region_cd").join(unsold.select("region_cd", F.col("value").alias("_unsold")), "region_cd", "left")
    left = live(remainders).groupBy("notice").agg(F.sum("units").alias("_left"))
    each = mine.join(n, "notice").join(left, "notice", "left")
    units = lambda test: F.sum(F.when(test, F.col("units")))
    out = each.groupBy("corp_code").agg(F.count("*").alias("n_presales"), F.sum("units").alias("presale_units"), units(F.col("_unsold").isNotNull()).alias("_judged"), units(F.col("_unsold") >= threshold).alias("presale_risky"), F.sum("_left").alias("remaining_units"))
    # a notice of no units makes nothing risky
    out = out.withColumn("presale_risky", F.when(F.col("presale_risky") > 0, F.col("presale_risky")))
    return out.withColumn("presale_risky_share", _share(F.col("presale_risky"), F.col("_judged"))).drop("_judged")


COLUMNS = [
    "corp_code", "corp_name", "n_contracts", "total", "mapped", "risky", "risky_share", "n_risky", "guarantee_ratio", "guarantee_date", "pf_guaranteed", "open_alerts",
    "pf_period", "pf_to_equity", "pf_due_to_equity", "n_presales", "presale_units", "presale_risky", "presale_risky_share", "remaining_units", "pf_status",
]


def summary(companies: DataFrame, contracts: DataFrame, guarantees: DataFrame, alerts: DataFrame, reports: DataFrame, metrics: DataFrame, presales: DataFrame, builders: DataFrame, remainders: DataFrame, unsold: DataFrame, since, threshold: float) -> DataFrame:
    """COLUMNS for every target company, whatever of it there is; every branch is grouped by company before it is joined.

    ``companies``: corp_code, corp_name, is_target; ``alerts``: target_type, target, status. Counts are 0 where there is nothing, amounts null.
    """
    live = alerts.where("target_type = 'COMPANY' AND status IN ('OPEN', 'ACK')").groupBy(F.col("target").alias("corp_code")).agg(F.count("*").alias("open_alerts"))
    out = companies.where("is_target").select("corp_code", "corp_name")
    branches = of_contracts(contracts, unsold, since, threshold), of_guarantees(guarantees, since), live, of_project_finance(reports, metrics), of_presales(presales, builders, remainders, unsold, since, threshold)
    for branch in branches:
        out = out.join(branch, "corp_code", "left")
    return out.fillna(0, ["n_contracts", "n_risky", "open_alerts", "n_presales"]).select(COLUMNS)


def ranked(found: DataFrame) -> DataFrame:
    """The summary as it is shown: by share of risky contracts, then by guarantees against equity, then by name."""
    return found.orderBy(F.col("risky_share").desc_nulls_last(), F.col("guarantee_ratio").desc_nulls_last(), "corp_name")
