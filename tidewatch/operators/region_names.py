"""Regions of a statistic by their names: province, and tokens of a path below it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Reasons of a match without a region. Fixed values.
UNKNOWN_PROVINCE, NOT_FOUND, SEVERAL = "시도 이름을 알 수 없음", "기준 경계에서 이름을 찾지 못함", "같은 이름이 여러 곳"
WHOLE, PROVINCE, AREA = "전국·권역 합계", "시도 합계", "권역·합계 등 집계 지역"


def match_names(codes: DataFrame, regions: DataFrame, provinces: DataFrame, aliases: DataFrame, manual: DataFrame) -> DataFrame:
    """(source, source_code, method, region_cd, note) of each code: NAME, MANUAL, AGGREGATE or UNMAPPED.

    ``codes``: source, source_code, province, tokens (array); ``regions``: region_cd, name, level, province;
    ``provinces``: spelling, province (one spelling may stand for several); ``aliases``: name, alias;
    ``manual``: source, name, region_cd, note, where name is the province and tokens joined by blanks.
    A region set by hand comes first. Codes are matched once each, however many rows use them.
    """
    one = codes.dropDuplicates(["source", "source_code"])
    some = F.filter(F.transform(F.coalesce("tokens", F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: (t != "") & t.isNotNull())
    one = one.withColumn("_below", F.size(some) > 0).withColumn("_t", F.filter(some, lambda t: ~t.isin("계", "소계")))
    one = one.withColumn("_raw", F.try_element_at("_t", F.lit(-1))).withColumn("_up", F.try_element_at("_t", F.lit(-2)))
    renamed = lambda d, c, out: d.join(aliases.select(F.col("name").alias(c), F.col("alias").alias(f"{c}_alias")), c, "left").withColumn(out, F.coalesce(f"{c}_alias", c)).drop(f"{c}_alias")
    one = renamed(renamed(one, "_raw", "_last"), "_up", "_above")
    spelt = provinces.groupBy(F.col("spelling").alias("province")).agg(F.count("*").alias("_known"))
    one = one.join(spelt, "province", "left")

    # candidates of each code, best first, met with the regions of its province
    district = lambda c: F.coalesce(c.rlike("[시군구]$"), F.lit(False))
    names = F.array_compact(F.array(F.when(F.col("_above").endswith("시"), F.concat("_above", F.lit(" "), "_last")), F.col("_last"), F.when(F.col("_raw") != F.col("_last"), F.col("_raw"))))
    inside = provinces.join(regions.withColumnRenamed("province", "_p"), F.col("province") == F.col("_p")).select(F.col("spelling").alias("province"), "region_cd", "name", "level").dropDuplicates(["province", "region_cd"])
    squeeze = lambda c: F.regexp_replace(c, r"\s+", "")
    wanted = one.where(F.col("_raw").isNotNull() & (district(F.col("_raw")) | district(F.col("_last"))))
    hits = wanted.select("source", "source_code", "province", F.posexplode(names).alias("_place", "_n")).withColumn("_k", squeeze(F.col("_n"))).join(inside.withColumn("_k", squeeze(F.col("name"))), ["province", "_k"])
    tail = wanted.select("source", "source_code", "province", F.lit(9).alias("_place"), F.col("_last").alias("_k")).join(
        inside.where("level = 3 AND contains(name, ' ')").withColumn("_k", F.regexp_extract("name", r" (\S+)$", 1)), ["province", "_k"]
    )
    both = hits.select("source", "source_code", "_place", "region_cd", "level").union(tail.select("source", "source_code", "_place", "region_cd", "level"))
    met = both.groupBy("source", "source_code", "_place").agg(F.count("*").alias("_n"), F.max("region_cd").alias("_any"), F.sum((F.col("level") == 2).cast("int")).alias("_n2"), F.max(F.when(F.col("level") == 2, F.col("region_cd"))).alias("_shown"), F.sort_array(F.collect_set("region_cd")).alias("_all"))
    best = met.groupBy("source", "source_code").agg(F.min_by(F.struct("_place", "_n", "_any", "_n2", "_shown", "_all"), "_place").alias("_b"))
    alone = inside.where("level = 2").groupBy("province").agg(F.count("*").alias("_n_shown"), F.max("region_cd").alias("_only"))
    bounds = inside.select("province").distinct().withColumn("_inside", F.lit(True))

    d = one.join(best, ["source", "source_code"], "left").join(alone, "province", "left").join(bounds, "province", "left")
    # a tail that fits several regions is no match, a name that does is one only if a single one is shown
    found = F.when(F.col("_b._n") == 1, F.col("_b._any")).when((F.col("_b._place") < 9) & (F.col("_b._n2") == 1), F.col("_b._shown"))
    note = F.when(F.col("_known").isNull(), F.when(F.col("_below"), F.concat(F.lit(UNKNOWN_PROVINCE + ": "), F.coalesce("province", F.lit("null")))).otherwise(WHOLE))
    note = note.when(F.col("_inside").isNull(), F.concat(F.lit("기준 경계에 시도 없음: "), "province")).when(F.col("_raw").isNull(), PROVINCE)
    note = note.when(~(district(F.col("_raw")) | district(F.col("_last"))), AREA).when((F.col("_b._place") < 9) & (F.col("_b._n") > 1), F.concat(F.lit(SEVERAL + ": "), F.array_join("_b._all", ","))).otherwise(NOT_FOUND)
    region = F.when(F.col("_known").isNotNull() & F.col("_inside").isNotNull(), F.when(F.col("_raw").isNull(), F.when(F.col("_n_shown") == 1, F.col("_only"))).otherwise(found))
    d = d.withColumn("_region", region).withColumn("_note", note)
    d = d.withColumn("_method", F.when(F.col("_region").isNotNull(), "NAME").when(F.col("_note").isin(WHOLE, PROVINCE, AREA), "AGGREGATE").otherwise("UNMAPPED"))
    display = F.concat_ws(" ", "province", some)
    hand = manual.select(F.lower("source").alias("_s"), F.col("name").alias("_name"), F.col("region_cd").alias("_hand"), F.col("note").alias("_why"))
    hand = hand.join(regions.select(F.col("region_cd").alias("_hand"), F.lit(True).alias("_exists")), "_hand", "left")
    d = d.withColumn("_name", display).withColumn("_s", F.lower("source")).join(hand, ["_s", "_name"], "left")
    set_ = F.coalesce(F.col("_exists"), F.lit(False))
    return d.select(
        "source", "source_code",
        F.when(set_, "MANUAL").otherwise(F.col("_method")).alias("method"),
        F.when(set_, F.col("_hand")).otherwise(F.col("_region")).alias("region_cd"),
        F.when(set_, F.col("_why")).when(F.col("_region").isNotNull(), F.lit(None)).when(F.col("_method") == "UNMAPPED", F.coalesce("_why", "_note")).otherwise(F.col("_note")).alias("note"),
    )
