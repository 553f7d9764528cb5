"""Keeping dictionaries, mappings, universes and parsed results up to date, as next states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def universe_changes(old: DataFrame, decided: DataFrame, key: str = "corp_code") -> DataFrame:
    """(key, target, reason, change) of what a new decision changes: IN and OUT are history, REASON only a text.

    ``old`` and ``decided`` have key, target, reason. A reason alone matters only for targets.
    """
    both = decided.join(old.select(key, F.col("target").alias("_was"), F.col("reason").alias("_why")), key, "left")
    flip = F.col("target") != F.coalesce("_was", F.lit(False))
    kind = F.when(flip & F.col("target"), "IN").when(flip, "OUT").when(F.col("target") & ~F.col("reason").eqNullSafe(F.col("_why")), "REASON")
    return both.withColumn("change", kind).where("change IS NOT NULL").select(key, "target", "reason", "change")


def sync_seed(rules: DataFrame, seed: DataFrame, keys: Sequence[str], origin: str = "origin") -> DataFrame:
    """``rules`` after a seed file: its rows are taken, SEED rows that it lacks go, rows of users stay.

    Keys may be null and are compared as equal then. Where a user has a row with a seed's key, the user's stays.
    """
    own = rules.where(F.col(origin) != "SEED")
    same = [own[k].eqNullSafe(seed[k]) for k in keys]
    return own.unionByName(seed.join(own, same, "left_anti").withColumn(origin, F.lit("SEED")).select(rules.columns))


def remapped(mapping: DataFrame, changes: DataFrame, keys: Sequence[str] = ("source", "source_code")) -> DataFrame:
    """``mapping`` with regions set by hand; a change to no region makes the code UNMAPPED. Unknown codes are not added."""
    new = changes.select(*keys, F.lit(True).alias("_set"), F.col("region_cd").alias("_region"), F.col("note").alias("_note"))
    both = mapping.join(new, list(keys), "left")
    taken = F.col("_set").isNotNull()
    both = both.withColumn("method", F.when(taken & F.col("_region").isNull(), "UNMAPPED").when(taken, "MANUAL").otherwise(F.col("method")))
    both = both.withColumn("region_cd", F.when(taken, F.col("_region")).otherwise(F.col("region_cd")))
    return both.withColumn("note", F.when(taken, F.col("_note")).otherwise(F.col("note"))).select(mapping.columns)


def inside_mapping(stats: DataFrame, changes: DataFrame, keys: Sequence[str] = ("source", "source_code")) -> DataFrame:
    """``stats`` less those of remapped codes that lie outside the new region (all of them where there is none)."""
    new = changes.select(*keys, F.lit(True).alias("_set"), F.col("region_cd").alias("_region"))
    outside = F.col("_set").isNotNull() & (F.col("_region").isNull() | (F.col("region_cd") != F.col("_region")))
    return stats.join(new, list(keys), "left").where(~F.coalesce(outside, F.lit(False))).select(stats.columns)


def purged(rows: DataFrame, used: DataFrame, current: DataFrame, source: str = "source") -> DataFrame:
    """``rows``, or none of them once ``current`` names another source than ``used`` did (each has one row)."""
    changed = used.select(F.col(source).alias("_was")).crossJoin(current.select(F.col(source).alias("_now"))).where("_was != _now").select(F.lit(1).alias("_x"))
    return rows.withColumn("_x", F.lit(1)).join(F.broadcast(changed), "_x", "left_anti").drop("_x")  # a row at most


def stale(stored: DataFrame, version: int) -> DataFrame:
    """Stored raw documents that an older parser read, to be parsed anew without fetching."""
    return stored.where(F.col("raw").isNotNull() & (F.coalesce("parser_version", F.lit(0)) < version))


def refetch(fetched: DataFrame, filings: DataFrame) -> DataFrame:
    """Fetched units that a later filing for the same period has corrected since.

    ``fetched``: corp_code, period, fetched_at, rcept_no (null: none known); ``filings``: corp_code, period,
    rcept_dt, rcept_no. Filings of the day of the fetch count, too, if their number is higher. The latest
    filing of a unit by number decides, so each side is aggregated before the join.
    """
    # of each day the highest number; a unit is late if any day from its fetch on has a higher one
    last = filings.groupBy("corp_code", "period", "rcept_dt").agg(F.max("rcept_no").alias("_last"))
    days = last.groupBy("corp_code", "period").agg(F.collect_list(F.struct("rcept_dt", "_last")).alias("_days"))
    after = F.exists("_days", lambda d: (d["rcept_dt"] >= F.to_date("fetched_at")) & (d["_last"] > F.coalesce("rcept_no", F.lit(""))))
    return fetched.join(days, ["corp_code", "period"]).where(after).select(fetched.columns)


def evidence(condition: Column, params: Column, observations: Column, sources: Column, message: Column) -> Column:
    """An alert's evidence as a struct; a source that is named twice is listed once, in order of first mention."""
    return F.struct(condition.alias("condition"), params.alias("params"), message.alias("message"), observations.alias("observations"), F.array_distinct(sources).alias("sources"))


def source_of(kind: str, period: Column, rcept_no: Column, reprt_code: Column, table: Column) -> Column:
    """A source of evidence; ``-`` stands for no number and no code."""
    some = lambda c: F.nullif(c, F.lit("-"))
    return F.struct(F.lit(kind).alias("type"), period.alias("period"), some(rcept_no).alias("rceptNo"), some(reprt_code).alias("reprtCode"), table.alias("table"))


def eligible(alerts: DataFrame, companies: DataFrame) -> DataFrame:
    """Alerts that an event study may use: of listed companies, not of region rules, not closed by a change or as resolved."""
    listed = companies.where("stock_code IS NOT NULL AND corp_cls IN ('Y', 'K')").select(F.col("corp_code").alias("target_key"), "stock_code")
    kept = alerts.where("target_type = 'COMPANY' AND rule_code NOT IN ('R-X01', 'R-X02') AND coalesce(close_reason, '') NOT IN ('RULE_CHANGED', 'RESOLVED')")
    return kept.join(listed, "target_key")


def first_of_signature(rows: DataFrame, signature: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of rows with an equal signature (nulls are equal) the first one by ``order``."""
    rest = [c for c in rows.columns if c not in signature]
    first = rows.groupBy(*signature).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select(*signature, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(rows.columns)


def place_names(trades: DataFrame) -> DataFrame:
    """Dictionary of (lawd_cd, umd_nm, jibun) with the name of the place there; a lot number may be empty."""
    named = trades.where("umd_nm IS NOT NULL AND umd_nm != ''")
    return named.groupBy("lawd_cd", "umd_nm", F.coalesce("jibun", F.lit("")).alias("jibun")).agg(F.max("apt_nm").alias("apt_nm"))


def reproduced(stored: DataFrame, picked: DataFrame, keys: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """Stored values beside the sum of the lines that they were made of, and whether that gives them again."""
    total = picked.groupBy(*keys).agg(F.sum("amount").alias("from_lines"), F.count("*").alias("n_lines"))
    both = stored.join(total, list(keys), "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))
    near = F.abs(F.col("value") - F.col("from_lines")) <= tolerance
    return both.withColumn("reproduced", F.coalesce(near, F.col("value").isNull() & F.col("from_lines").isNull()))
