"""Building sites: where an address lies by the places that trades name, and the market around it."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What names of quarters, townships and villages end in; a quarter's number and 가 come after its name. Fixed values.
ENDINGS = ["동", "읍", "면", "리"]
#: What stands between the names of several places. Fixed values.
BETWEEN = ["~", "～", ",", "、", "·", "/", " 및 "]
#: Put behind each name while a text is cut.
_MARK = "\u0001"
#: Longest name of a village and of anything else that is taken for a place. Fixed values.
LONGEST_VILLAGE, LONGEST = 5, 8


def _places(text: Column) -> Column:
    """(name, lot) of the places that a text names, in order; the lot is null where no number follows.

    A name ends where one of its endings is followed by something else than a letter, or by the lot number of a mountain. The
    text is cut behind the ends; a name is the last word of its piece, and a lot what the next piece begins with.
    """
    ends = "|".join(ENDINGS)
    marked = F.regexp_replace(text, f"((?:{ends})(?![0-9]+가)|[0-9]가)(?=$|[^가-힣]|산 ?[0-9])", f"$1{_MARK}")
    pieces = F.split(marked, _MARK)
    name = lambda i: F.regexp_extract(F.get(pieces, i), "([가-힣0-9]+)$", 1)
    lot = lambda i: F.regexp_extract(F.get(pieces, i + 1), r"^\s*(?:산 ?)?[0-9]{1,5}(?:\s*-\s*[0-9]{1,5})?", 0)
    each = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda _, i: F.struct(name(i).alias("name"), F.nullif(lot(i), F.lit("")).alias("lot")))
    return F.filter(each, lambda t: t["name"].rlike("^[가-힣]."))


def _township(name: Column) -> Column:
    return name.endswith("읍") | name.endswith("면")


def locate(sites: DataFrame, places: DataFrame) -> DataFrame:
    """(id, match, lawd_cd, umd, jibun, apt_nm) of each site: JIBUN, UMD, UMD_NO_TRADE, MULTI or NONE.

    ``sites``: id, text, lawd_cds (array, in order of preference); ``places``: lawd_cd, umd_nm, jibun, apt_nm, one row
    for each lot (see ``upkeep.place_names``). A name is met whole, as the last word of a two-word name (the first
    word then has to be in the text where several fit), or as a township of which all villages count. A text that
    names several places is MULTI, unless they are villages of the one township that it begins with.
    """
    token = _places(F.col("text"))
    fits = lambda t: F.length(t["name"]) <= F.when(t["name"].endswith("리"), LONGEST_VILLAGE).otherwise(LONGEST)
    s = sites.select("id", "text", "lawd_cds", F.coalesce(F.filter(token, fits), F.array().cast("array<struct<name:string,lot:string>>")).alias("tokens"))
    s = s.withColumn("names", F.transform("tokens", lambda t: t["name"]))
    above = F.array_distinct(F.filter("names", _township))
    first = F.get("names", F.lit(0))
    under_one = (F.size(above) == 1) & (first == F.get(above, F.lit(0))) & F.forall(F.slice("names", 2, 1000000), lambda n: n.endswith("리"))
    spread = reduce(or_, [F.col("text").contains(mark) for mark in BETWEEN]) & (F.size(F.array_distinct("names")) > 1)
    s = s.withColumn("kind", F.when(F.size("names") == 0, "NONE").when(spread & under_one, "TOWNSHIP").when(spread, "MULTI").otherwise("ONE"))

    # every name against every district of the site, by three equi-joins
    asked = s.where("kind IN ('ONE', 'TOWNSHIP')").select("id", "kind", "names", F.posexplode("tokens").alias("i", "token"), "lawd_cds")
    asked = asked.select("id", "kind", "names", "i", F.col("token.name").alias("name"), F.col("token.lot").alias("lot"), F.posexplode("lawd_cds").alias("j", "lawd_cd"))
    asked = asked.where("kind = 'ONE' OR i = 0")
    known = places.select("lawd_cd", "umd_nm").distinct()
    words = F.split("umd_nm", " ")
    two = known.where("contains(umd_nm, ' ')").select("lawd_cd", "umd_nm", F.element_at(words, -1).alias("last"), F.substring_index("umd_nm", " ", 1).alias("head"), F.expr("left(umd_nm, length(umd_nm) - length(element_at(split(umd_nm, ' '), -1)) - 1)").alias("parent"))
    on = ["id", "i", "j"]
    cols = [*on, "lawd_cd", "name", "lot", "kind"]
    whole = asked.join(known.withColumnRenamed("umd_nm", "name"), ["lawd_cd", "name"], "left_semi").select(*cols, F.lit("whole").alias("way"), F.col("name").alias("found"), F.lit(False).alias("named"))
    tail = asked.join(two.withColumnRenamed("last", "name"), ["lawd_cd", "name"]).select(*cols, F.lit("tail").alias("way"), F.col("umd_nm").alias("found"), F.array_contains("names", F.col("parent")).alias("named"))
    head = asked.where(_township(F.col("name"))).join(two.select("lawd_cd", F.col("head").alias("name")).distinct(), ["lawd_cd", "name"], "left_semi").select(*cols, F.lit("head").alias("way"), F.col("name").alias("found"), F.lit(False).alias("named"))
    of = lambda cond: F.max(F.when(cond, F.col("found")))
    is_tail = F.col("way") == "tail"
    met = whole.unionByName(tail).unionByName(head).groupBy(*cols).agg(
        of(F.col("way") == "whole").alias("whole"), of(is_tail & F.col("named")).alias("one_named"), F.count_if(is_tail & F.col("named")).alias("n_named"),
        of(is_tail).alias("any"), F.count_if(is_tail).alias("n_tail"), of(F.col("way") == "head").alias("head"),
    )
    by_tail = F.when(F.col("n_named") == 1, F.col("one_named")).when((F.col("n_named") == 0) & (F.col("n_tail") == 1), F.col("any"))
    hit = F.when(F.col("kind") == "TOWNSHIP", F.col("head")).otherwise(F.coalesce("whole", by_tail, "head"))
    met = met.select(*cols, hit.alias("hit"), (F.col("whole").isNull() & by_tail.isNull() & (F.col("n_tail") > 1)).alias("unclear"))
    each = met.groupBy("id", "i").agg(F.min_by(F.struct("hit", "lawd_cd", "lot"), F.when(F.col("hit").isNotNull(), F.col("j"))).alias("best"), F.max("unclear").alias("unclear"))
    # as many hits as a text has names
    hits = each.groupBy("id").agg(F.max("unclear").alias("unclear"), F.sort_array(F.collect_list(F.when(F.col("best.hit").isNotNull(), F.struct("i", "best")))).alias("hits"))
    d = s.join(hits, "id", "left").withColumn("found", F.array_distinct(F.transform("hits", lambda h: h["best"]["hit"])))
    d = d.withColumn("over", F.get(F.filter("found", lambda h: F.exists("found", lambda o: o.startswith(F.concat(h, F.lit(" "))))), F.lit(0)))
    d = d.withColumn("left_", F.filter("found", lambda h: F.col("over").isNull() | (h != F.col("over"))))
    best = F.get("hits", F.lit(0))["best"]
    moved = F.coalesce(best["hit"] == F.col("over"), F.lit(False))
    d = d.withColumn("umd", F.when(moved, F.get("left_", F.lit(0))).otherwise(best["hit"])).withColumn("lawd_cd", best["lawd_cd"])
    behind = F.get(F.filter("tokens", lambda t: F.col("umd").endswith(t["name"])), F.lit(0))["lot"]
    d = d.withColumn("lot", F.nullif(F.regexp_replace(F.when(moved, behind).otherwise(best["lot"]), r"\s", ""), F.lit("")))
    n = F.coalesce(F.size("left_"), F.lit(0))
    d = d.withColumn("match", F.when(F.col("kind").isin("NONE", "MULTI"), F.col("kind")).when(n > 1, "MULTI").when(n == 1, "UMD").when(F.coalesce("unclear", F.lit(False)) & (F.col("kind") == "ONE"), "MULTI").otherwise("UMD_NO_TRADE"))
    d = d.select("id", "match", *[F.when(F.col("match") == "UMD", F.col(c)).alias(c) for c in ("lawd_cd", "umd")], F.when((F.col("match") == "UMD") & (F.col("kind") == "ONE"), F.col("lot")).alias("lot"))
    # a township as a whole has no lots
    d = d.join(known.select("lawd_cd", F.col("umd_nm").alias("umd"), F.lit(True).alias("exact")), ["lawd_cd", "umd"], "left").withColumn("lot", F.when(F.col("exact"), F.col("lot")))
    at = places.select("lawd_cd", F.col("umd_nm").alias("umd"), F.col("jibun").alias("lot"), "apt_nm")
    d = d.join(at, ["lawd_cd", "umd", "lot"], "left")
    return d.select("id", F.when(F.col("apt_nm").isNotNull(), "JIBUN").otherwise(F.col("match")).alias("match"), "lawd_cd", "umd", F.col("lot").alias("jibun"), "apt_nm")


def markets(sites: DataFrame, anchors: DataFrame, trades: DataFrame) -> DataFrame:
    """Of each (region_cd, lawd_cd, umd): trades of the twelve months up to the region's last one and of the twelve before.

    ``anchors``: region_cd, ym (YYYYMM as integer); ``trades``: lawd_cd, umd_nm, deal_ym, deal_amount, exclu_use_ar, cancelled.
    A township takes in all its villages: a trade counts for every name that its own begins with, so the join is on equal
    keys. Cancelled trades count only as such. Medians are exact over one place's trades of a year.
    """
    ordinal = lambda c: F.floor(F.col(c) / 100) * 12 + F.col(c) % 100
    k = sites.where("umd is not null").select("region_cd", "lawd_cd", "umd").distinct().join(anchors.select("region_cd", "ym"), "region_cd").withColumn("_to", ordinal("ym"))
    words = F.split("umd_nm", " ")
    names = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))
    t = trades.where("umd_nm is not null").select("lawd_cd", F.explode(names).alias("umd"), ordinal("deal_ym").alias("_at"), (F.col("deal_amount") / F.col("exclu_use_ar")).alias("_m2"), F.coalesce("cancelled", F.lit(False)).alias("_off"))
    j = k.join(t, ["lawd_cd", "umd"]).where("_at BETWEEN _to - 23 AND _to").withColumn("_now", F.col("_at") >= F.col("_to") - 11)
    on, now = ~F.col("_off"), F.col("_now")
    m = j.groupBy("region_cd", "lawd_cd", "umd", "ym").agg(
        F.count_if(on & now).alias("trades_12m"), F.count_if(on & ~now).alias("trades_before"), F.count_if(~on & now).alias("cancels_12m"),
        F.percentile(F.when(on & now, F.col("_m2")), F.lit(0.5)).alias("m2"), F.percentile(F.when(on & ~now, F.col("_m2")), F.lit(0.5)).alias("m2_before"),
    )
    m = m.withColumns({c: F.round(c, 1) for c in ("m2", "m2_before")})
    change = lambda a, b: F.when(F.col(b) != 0, F.round((F.col(a) - F.col(b)) * 100 / F.col(b), 1))
    all_now = F.col("trades_12m") + F.col("cancels_12m")
    return m.withColumns({"trades_change": change("trades_12m", "trades_before"), "m2_change": change("m2", "m2_before"), "cancel_rate": F.when(all_now > 0, F.round(F.col("cancels_12m") * 100 / all_now, 1))})
