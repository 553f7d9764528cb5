"""Housing-market regions: trade aggregates, region metrics, and matching of names and addresses."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import periods, status
from tidewatch.operators import grids
from tidewatch.session import ship

#: Width of the bins that prices per square metre are counted by before the middle ones are ordered; it changes no result.
PRICE_STEP = 10.0
#: Regions are a dictionary of some hundred rows; one with more rows than this is taken for another table.
MOST_REGIONS = 100_000


def trade_series(trades: DataFrame, ledger: DataFrame, regions: DataFrame) -> DataFrame:
    """(stat, region, period, value): TRADE_COUNT, CANCEL_COUNT and PRICE_M2_MEDIAN of each district and month.

    ``trades``: lawd_cd, deal_ym, exclu_use_ar, deal_amount, cancelled; ``ledger``: lawd_cd, deal_ym of
    what was fetched; ``regions``: region_cd, parent_cd, synthetic. Sub-districts count for their
    synthetic city, and a month is there only if all of them were fetched; one fetched without trades is 0.
    """
    kids = regions.alias("k").join(regions.where("synthetic").select(F.col("region_cd").alias("top")), F.col("k.parent_cd") == F.col("top"), "left")
    unit = kids.where("NOT synthetic").select(F.col("k.region_cd").alias("lawd_cd"), F.coalesce("top", "k.region_cd").alias("region"))
    need = unit.groupBy("region").agg(F.count("*").alias("_need"))
    got = ledger.select("lawd_cd", "deal_ym").distinct().join(unit, "lawd_cd").groupBy("region", "deal_ym").agg(F.count("*").alias("_got"))
    whole = got.join(need, "region").where("_got = _need").select("region", "deal_ym")
    live = ~F.col("cancelled")
    price = F.col("deal_amount") / F.col("exclu_use_ar")
    own = trades.join(unit, "lawd_cd").withColumn("_price", F.when(live, price))
    sums = own.groupBy("region", "deal_ym").agg(F.count_if(live).alias("TRADE_COUNT"), F.count_if(F.col("cancelled")).alias("CANCEL_COUNT"))
    middle = grids.exact_median(own, ["region", "deal_ym"], "_price", PRICE_STEP, "PRICE_M2_MEDIAN").withColumn("PRICE_M2_MEDIAN", F.col("PRICE_M2_MEDIAN").cast("decimal(18,2)"))
    sums = sums.join(middle, ["region", "deal_ym"], "left")
    out = whole.join(sums, ["region", "deal_ym"], "left").fillna(0, ["TRADE_COUNT", "CANCEL_COUNT"])
    wide = out.select("region", F.col("deal_ym").cast("string").alias("period"), *[F.col(c).cast("decimal(24,4)").alias(c) for c in ("TRADE_COUNT", "CANCEL_COUNT", "PRICE_M2_MEDIAN")])
    return wide.unpivot(["region", "period"], ["TRADE_COUNT", "CANCEL_COUNT", "PRICE_M2_MEDIAN"], "stat", "value").where("value is not null")


SERIES = ("UNSOLD", "SALE_IDX", "JEONSE_IDX", "TRADE_COUNT", "CANCEL_COUNT", "PRICE_M2_MEDIAN", "PRESALE_12M", "MOVEIN_12M_AHEAD")


def region_metrics(series: DataFrame, households: DataFrame) -> DataFrame:
    """region, period, metric_code, value, status: thirteen metrics of each region and month.

    ``series``: stat, region, period, value; ``households``: region, year (int), value. Each metric is
    there for the months that its driving series has; shifts go by month, households by the latest year
    that is not after the month's.
    """
    c = F.col
    wide = series.groupBy("region", "period").pivot("stat", list(SERIES)).agg(F.first("value"))
    wide = wide.withColumn("_m", periods.month_ordinal(c("period"))).withColumn("_y", F.substring("period", 1, 4).cast("int"))
    # households: stacked with the months and carried forward, as an as-of join
    h = households.where("value is not null").select("region", (c("year") * 12 - 1).alias("_m"), c("value").alias("_hh"))
    w = Window.partitionBy("region").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    wide = wide.unionByName(h, allowMissingColumns=True).withColumn("hh", F.last("_hh", ignorenulls=True).over(w)).where("period is not null")
    ago = lambda x, n: F.first(x).over(Window.partitionBy("region").orderBy("_m").rangeBetween(-n, -n))
    per_1k = lambda x: status.ratio(c(x), c("hh"), 1000)
    moved = lambda x: status.difference(c(x), ago(x, 3))
    value = lambda x: status.valued(c(x), F.when(c(x).isNull(), status.MISSING).otherwise(status.OK))
    metrics = {
        "UNSOLD_UNITS": ("UNSOLD", value("UNSOLD")),
        "UNSOLD_PER_1K_HH": ("UNSOLD", per_1k("UNSOLD")),
        "UNSOLD_3M_CHG": ("UNSOLD", status.pct_change(c("UNSOLD"), ago("UNSOLD", 3))),
        "PRICE_IDX_3M_CHG": ("SALE_IDX", moved("SALE_IDX")),
        "JEONSE_IDX_3M_CHG": ("SALE_IDX", moved("JEONSE_IDX")),
        "JEONSE_SALE_GAP": ("SALE_IDX", None),
        "TRADE_COUNT": ("TRADE_COUNT", value("TRADE_COUNT")),
        "TRADE_YOY": ("TRADE_COUNT", status.pct_change(c("TRADE_COUNT"), ago("TRADE_COUNT", 12))),
        "CANCEL_RATE": ("TRADE_COUNT", status.ratio(F.coalesce("CANCEL_COUNT", F.lit(0)), c("TRADE_COUNT") + F.coalesce("CANCEL_COUNT", F.lit(0)))),
        "PRICE_M2_MEDIAN": ("PRICE_M2_MEDIAN", value("PRICE_M2_MEDIAN")),
        "PRICE_M2_YOY": ("PRICE_M2_MEDIAN", status.pct_change(c("PRICE_M2_MEDIAN"), ago("PRICE_M2_MEDIAN", 12))),
        "PRESALE_12M_PER_1K_HH": ("PRESALE_12M", per_1k("PRESALE_12M")),
        "MOVEIN_12M_AHEAD_PER_1K_HH": ("MOVEIN_12M_AHEAD", per_1k("MOVEIN_12M_AHEAD")),
    }
    for name, (_, m) in metrics.items():
        wide = wide.withColumn(f"m_{name}", m if m is not None else status.difference(status.known(c("m_JEONSE_IDX_3M_CHG")), status.known(c("m_PRICE_IDX_3M_CHG"))))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("metric_code"), c(f"m_{k}.value").alias("value"), c(f"m_{k}.status").alias("status"), c(d).isNotNull().alias("there")) for k, (d, _) in metrics.items()]))
    return wide.select("region", "period", rows.alias("x")).where("x.there").select("region", "period", "x.metric_code", "x.value", "x.status")


def synthetic_parents(regions: DataFrame) -> DataFrame:
    """Cities made up of level-3 districts: the first four digits of their codes and a 0."""
    top = regions.where("level = 3").groupBy(F.concat(F.substring("region_cd", 1, 4), F.lit("0")).alias("region_cd"), F.split_part(F.col("name"), F.lit(" "), F.lit(1)).alias("name"), "sido_name").agg(F.count("*").alias("n_children"))
    return top.withColumn("level", F.lit(2)).withColumn("synthetic", F.lit(True))


_TOKENS = re.compile(r"[\s,()\[\]·ㆍ/~∼]+")


def match_addresses(texts: DataFrame, regions: DataFrame, provinces: dict[str, str], overseas: Sequence[str] = (), column: str = "text") -> DataFrame:
    """(text, match, region_cd, sido_name) of each distinct text; match is SIGUNGU, SIDO, OVERSEAS, UNKNOWN or NONE.

    ``regions``: region_cd, name, sido_name, level, parent_cd — a dictionary of a few hundred rows that is
    sent to the workers; ``provinces``: spelling -> sido_name. After each province's name a city with its
    district, a city, or the name with an ending is looked for; else the first province counts, else a
    city or county of a name that the country has once, else a word for places abroad.
    """
    ship(texts.sparkSession)
    known: dict[tuple[str, str], str] = {}
    once: dict[str, list[tuple[str, str]]] = {}
    rows = regions.limit(MOST_REGIONS + 1).collect()
    if len(rows) > MOST_REGIONS:
        raise ValueError(f"more than {MOST_REGIONS} regions")
    for r in rows:
        top = r["parent_cd"] if r["level"] == 3 else r["region_cd"]
        known[(r["sido_name"], r["name"].replace(" ", ""))] = top
        if r["level"] == 2:
            once.setdefault(r["name"], []).append((top, r["sido_name"]))

    def place(text: str | None) -> tuple[str, str | None, str | None]:
        tokens = [t for t in _TOKENS.split(text or "") if t]
        if not tokens or (text or "").strip() == "-":
            return "NONE", None, None
        sido = None
        for i, t in enumerate(tokens):
            if t not in provinces:
                continue
            p = provinces[t]
            sido = sido or p
            after = tokens[i + 1 : i + 3]
            tries = ["".join(after)] if len(after) == 2 else []
            tries += [after[0], f"{after[0]}시", f"{after[0]}군"] if after else []
            for name in [*tries, ""]:
                if (p, name) in known:
                    return "SIGUNGU", known[(p, name)], p
        if sido:
            return "SIDO", None, sido
        for t in tokens:
            if t[-1] in "시군구" and t in once:
                if len(once[t]) == 1:
                    return "SIGUNGU", *once[t][0]
                break
        if any(w in (text or "") for w in overseas):
            return "OVERSEAS", None, None
        return "UNKNOWN", None, None

    def run(frames):
        for f in frames:
            found = [place(t) for t in f[column]]
            yield pd.DataFrame({column: f[column], "match": [x[0] for x in found], "region_cd": [x[1] for x in found], "sido_name": [x[2] for x in found]})

    return texts.select(column).distinct().mapInPandas(run, f"`{column}` string, match string, region_cd string, sido_name string")


def link_builders(notices: DataFrame, companies: DataFrame, aliases: DataFrame) -> DataFrame:
    """``notices`` (id, name_key) with status, method, corp_code and candidates.

    An alias of a known company comes first, then the one company of that key; several are AMBIGUOUS. An alias that names two
    companies, known or not, is a fault in the dictionary: the query fails and tells it.
    ``companies``: corp_code, name_key; ``aliases``: name_key, corp_code.
    """
    both = aliases.where("name_key IS NOT NULL AND corp_code IS NOT NULL").groupBy("name_key").agg(F.min("corp_code").alias("_one"), F.max("corp_code").alias("_other"))
    fault = F.raise_error(F.concat(F.lit("the alias "), "name_key", F.lit(" names "), "_one", F.lit(" and "), "_other"))
    a = both.select("name_key", F.when(F.col("_one") == F.col("_other"), F.col("_one")).otherwise(fault).alias("_alias"))
    a = a.join(companies.select(F.col("corp_code").alias("_alias")).distinct(), "_alias", "left_semi")
    k = companies.groupBy("name_key").agg(F.sort_array(F.collect_set("corp_code")).alias("_codes"))
    both = notices.join(a, "name_key", "left").join(k, "name_key", "left")
    n = F.coalesce(F.size("_codes"), F.lit(0))
    has = F.col("_alias").isNotNull()
    return (
        both.withColumn("status", F.when(has | (n == 1), "MATCHED").when(n > 1, "AMBIGUOUS").otherwise("UNMATCHED"))
        .withColumn("method", F.when(has, "ALIAS").when(n == 1, "EXACT"))
        .withColumn("corp_code", F.when(has, F.col("_alias")).when(n == 1, F.get("_codes", F.lit(0))))
        .withColumn("candidates", F.when(~has & (n > 1), F.col("_codes")).otherwise(F.array().cast("array<string>")))
        .drop("_alias", "_codes")
    )


def risk_share(facts: DataFrame, latest: DataFrame, threshold: float, unknown_stays: bool) -> DataFrame:
    """entity, n, total, risky, n_risky, excluded, share (percent): amounts in regions at or over a threshold.

    ``facts``: entity, region, amount; ``latest``: region, value. Rows without a region or amount never
    count. Regions without a value stay in the denominator (contracts) or leave it (presales).
    """
    f = facts.where("region is not null AND amount is not null").join(latest, "region", "left")
    counts = F.lit(True) if unknown_stays else F.col("value").isNotNull()
    risky = F.coalesce(F.col("value") >= threshold, F.lit(False))
    out = f.groupBy("entity").agg(
        F.count_if(counts).alias("n"), F.sum(F.when(counts, F.col("amount"))).alias("total"),
        F.coalesce(F.sum(F.when(risky, F.col("amount"))), F.lit(0)).alias("risky"), F.count_if(risky).alias("n_risky"), F.count_if(~counts).alias("excluded"),
    )
    return out.withColumn("share", F.when(F.col("total") > 0, F.round(F.col("risky").cast("decimal(24,4)") * 100 / F.col("total").cast("decimal(24,4)"), 2)))
