"""Alert rules: three-valued conditions over metric series, exposures and filings.

Every rule gives evaluations (rule_code, target, as_of, verdict, known_on where it applies), a null
verdict meaning unknown. Findings are the true ones; what was evaluated and decided follows from the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import periods, status
from tidewatch.operators import ordered, regions

#: Quarters and months that are evaluated in daily use; a full history takes no limit.
QUARTERS, MONTHS = 8, 12


@dataclass(frozen=True)
class MetricRule:
    """A condition on a target's metrics in each period of its axis, if asked for ``k`` periods running."""

    code: str
    axis: Sequence[str]
    condition: Callable[[dict], Column]
    params: dict = field(default_factory=dict)
    k: Callable[[dict], int] = lambda p: 1
    monthly: bool = False
    #: Holds in the period itself, beside the run.
    beside: Callable[[dict], Column] | None = None


def _m(code: str) -> Column:
    """A metric's value where known."""
    return F.col(code)


def _trades_fell(p: dict) -> Column:
    few = F.when(_m("TRADE_COUNT_YEAR_AGO") < p["min_base"], False).when(_m("TRADE_COUNT_YEAR_AGO").isNull(), None).otherwise(True)
    return few & (_m("TRADE_YOY") <= p["max_yoy"]) & (_m("UNSOLD_3M_CHG") >= p["min_unsold_chg"])


RULES = [
    MetricRule("R-C01", ["DEBT_RATIO"], lambda p: (_m("DEBT_RATIO") > p["ratio"]) & (_m("DEBT_RATIO_YOY") > p["yoy"]), {"ratio": 300, "yoy": 50}),
    MetricRule("R-C02", ["DEBT_RATIO", "INTEREST_COVERAGE"], lambda p: _m("INTEREST_COVERAGE") < p["below"], {"below": 1, "k": 2}, lambda p: p["k"]),
    MetricRule("R-C03", ["DEBT_RATIO", "OCF_QTR"], lambda p: _m("OCF_QTR") < 0, {"k": 3}, lambda p: p["k"]),
    MetricRule("R-R01", ["UNSOLD_UNITS"], lambda p: (_m("UNSOLD_UNITS") >= p["units"]) & (_m("UNSOLD_3M_CHG") > p["chg"]) & (_m("UNSOLD_PER_1K_HH") > p["per_1k"]), {"units": 100, "chg": 50, "per_1k": 2}, monthly=True),
    MetricRule("R-R02", ["UNSOLD_UNITS", "PRICE_IDX_3M_CHG"], lambda p: _m("PRICE_IDX_3M_CHG") < 0, {"k": 3}, lambda p: p["k"], True, lambda p: _m("UNSOLD_3M_CHG") > 0),
    MetricRule("R-R03", ["TRADE_YOY"], _trades_fell, {"max_yoy": -40, "min_unsold_chg": 10, "min_base": 30}, monthly=True),
]


def evaluate(rule: MetricRule, metrics: DataFrame, params: dict | None = None, last: int | None = None) -> DataFrame:
    """rule_code, target, as_of, verdict for each period of the rule's axis.

    ``metrics``: target, period, metric_code, value, status. The axis is the first of the rule's series
    that a target has at all; ``last`` keeps its latest periods.
    """
    p = {**rule.params, **(params or {})}
    needed = sorted({*rule.axis, "DEBT_RATIO", "DEBT_RATIO_YOY", "INTEREST_COVERAGE", "OCF_QTR"} if not rule.monthly else {*rule.axis, "UNSOLD_UNITS", "UNSOLD_3M_CHG", "UNSOLD_PER_1K_HH", "PRICE_IDX_3M_CHG", "TRADE_YOY", "TRADE_COUNT"})
    value = F.when(F.col("status") == status.OK, F.col("value"))
    wide = metrics.groupBy("target", "period").agg(*[F.max(F.when(F.col("metric_code") == m, value)).alias(m) for m in needed], *[F.max((F.col("metric_code") == m).cast("int")).alias(f"_has_{i}") for i, m in enumerate(rule.axis)])
    ordinal = periods.month_ordinal if rule.monthly else periods.quarter_ordinal
    wide = wide.withColumn("_n", ordinal(F.col("period")))
    if rule.monthly:
        wide = ordered.shifted(wide, ["target"], "_n", "TRADE_COUNT", 12, "TRADE_COUNT_YEAR_AGO")
    wide = wide.withColumn("verdict", rule.condition(p))
    k = rule.k(p)
    if k > 1:
        wide = ordered.run_test(wide, ["target"], "_n", "verdict", k, "verdict")
    if rule.beside is not None:
        wide = wide.withColumn("verdict", F.col("verdict") & rule.beside(p))
    own = Window.partitionBy("target")
    on_axis = None
    for i in reversed(range(len(rule.axis))):
        here = F.col(f"_has_{i}") == 1
        on_axis = here if on_axis is None else F.when(F.max(f"_has_{i}").over(own) == 1, here).otherwise(on_axis)
    out = wide.withColumn("_on", on_axis).where("_on")
    if last is not None:
        out = ordered.last_n(out, ["target"], "period", last)
    return out.select(F.lit(rule.code).alias("rule_code"), "target", F.col("period").alias("as_of"), "verdict")


def material_filings(filings: DataFrame, today, params: dict | None = None) -> DataFrame:
    """R-C04: each filing of a grave kind in the last days, its receipt as the as-of."""
    p = {"days": 30, "types": ["AUDIT_OPINION", "DEFAULT", "SUSPENSION", "REHAB"], **(params or {})}
    recent = filings.where(F.col("rcept_dt").between(F.date_sub(F.lit(today), p["days"]), F.lit(today)))
    return recent.select(F.lit("R-C04").alias("rule_code"), F.col("corp_code").alias("target"), F.col("rcept_no").alias("as_of"), F.col("event_type").isin(p["types"]).alias("verdict"))


def guarantee_balance(guarantees: DataFrame, today, params: dict | None = None) -> DataFrame:
    """R-C05: every guarantee filing of the window in turn, total balance at or over a share of equity."""
    p = {"days": 365, "ratio": 100, **(params or {})}
    g = guarantees.where(F.col("superseded_by").isNull() & F.col("rcept_dt").between(F.date_sub(F.lit(today), p["days"]), F.lit(today)))
    known = F.when((F.col("equity") > 0) & F.col("total_balance").isNotNull(), F.col("total_balance") * 100 >= F.col("equity") * p["ratio"])
    latest = ordered.latest_per(g, ["corp_code"], F.col("rcept_dt").desc(), F.col("rcept_no").desc())
    return latest.select(F.lit("R-C05").alias("rule_code"), F.col("corp_code").alias("target"), F.col("rcept_no").alias("as_of"), known.alias("verdict"))


def pf_exposure(metrics: DataFrame, params: dict | None = None, last: int | None = None) -> DataFrame:
    """R-C06: guarantees or what falls due within a year, against equity; the guarantee has to be known."""
    p = {"guarantee": 100, "due": 50, **(params or {})}
    ok = F.when(F.col("status") == status.OK, F.col("value"))
    is_due = F.col("metric_code") == "PF_DUE_12M_TO_EQUITY"
    wide = metrics.groupBy("target", "period").agg(
        F.max(F.when(F.col("metric_code") == "PF_GUARANTEE_TO_EQUITY", ok)).alias("g"), F.max(F.when(is_due, ok)).alias("d"),
        F.max(is_due.cast("int")).alias("has_due"), F.max((F.col("metric_code") == "PF_GUARANTEE_TO_EQUITY").cast("int")).alias("has_g"),
    )
    due = F.when(F.col("has_due") == 0, False).otherwise(F.col("d") >= p["due"])
    verdict = F.when(F.col("g").isNotNull(), (F.col("g") >= p["guarantee"]) | due)
    out = wide.where("has_g = 1").withColumn("verdict", verdict)
    if last is not None:
        out = ordered.last_n(out, ["target"], "period", last)
    return out.select(F.lit("R-C06").alias("rule_code"), "target", F.col("period").alias("as_of"), "verdict")


def region_share(code: str, facts: DataFrame, unsold: DataFrame, as_of: str, params: dict | None = None) -> DataFrame:
    """R-X01 (contracts) and R-X02 (presales): share of amounts in regions with much unsold, and how many of them.

    ``facts``: entity, region, amount of the window; ``unsold``: region, period, value, status.
    """
    p = {"threshold": 5, "share": 50, "min": 2, **(params or {})}
    latest = unsold.where(F.col("status") == status.OK).groupBy("region").agg(F.max_by("value", "period").alias("value"))
    s = regions.risk_share(facts, latest, p["threshold"], unknown_stays=code == "R-X01")
    verdict = F.when(F.col("total") > 0, (F.col("share") >= p["share"]) & (F.col("n_risky") >= p["min"]))
    return s.select(F.lit(code).alias("rule_code"), F.col("entity").alias("target"), F.lit(as_of).alias("as_of"), verdict.alias("verdict"))


def summary(evaluations: DataFrame) -> DataFrame:
    """rule_code, target, latest_as_of (last decided), decided, findings (sorted), evaluated (sorted)."""
    known = F.col("verdict").isNotNull()
    return evaluations.groupBy("rule_code", "target").agg(
        F.max(F.when(known, F.col("as_of"))).alias("latest_as_of"), F.max(known).alias("decided"),
        F.sort_array(F.collect_list(F.when(F.col("verdict"), F.col("as_of")))).alias("findings"), F.sort_array(F.collect_list(F.when(known, F.col("as_of")))).alias("evaluated"),
    )


def universe(companies: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), classes: Sequence[str] = ("Y", "K"), industries: Sequence[str] = ("41", "421")) -> DataFrame:
    """``companies`` (corp_code, stock_code, corp_cls, induty_code) with target and reason; what is set by hand comes first."""
    industry = F.lit(False)
    for prefix in industries:
        industry = industry | F.coalesce(F.col("induty_code").startswith(prefix), F.lit(False))
    reason = (
        F.when(F.col("corp_code").isin(list(exclude)), "MANUAL_EXCLUDE").when(F.col("corp_code").isin(list(include)), "MANUAL_INCLUDE")
        .when(F.col("stock_code").isNull() | (F.trim("stock_code") == ""), "UNLISTED").when(~F.coalesce(F.col("corp_cls").isin(list(classes)), F.lit(False)), "CLASS")
        .when(~industry, "INDUSTRY").otherwise("MATCH")
    )
    return companies.withColumn("reason", reason).withColumn("target", F.col("reason").isin("MANUAL_INCLUDE", "MATCH"))


def check_params(params: dict, bounds: dict[str, tuple[float, float]]) -> None:
    """ValueError for a parameter that is missing, no number, or out of its bounds."""
    for name, (low, high) in bounds.items():
        value = params.get(name)
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not low <= value <= high:
            raise ValueError(f"{name} has to be a number from {low} to {high}")
