"""Snapshots in place of updates: each function gives the whole next state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], change: str = "change") -> DataFrame:
    """The state after ``new`` is put over ``old``; ``change`` is INSERTED, UPDATED, SAME or ABSENT (old only)."""
    rest = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*rest).alias("_old"))
    b = new.select(*keys, F.struct(*rest).alias("_new"))
    both = a.join(b, list(keys), "full_outer")
    kind = F.when(F.col("_old").isNull(), "INSERTED").when(F.col("_new").isNull(), "ABSENT").when(F.col("_old").eqNullSafe(F.col("_new")), "SAME").otherwise("UPDATED")
    now = F.coalesce("_new", "_old")
    return both.select(*keys, *[now[c].alias(c) for c in rest], kind.alias(change))


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it does not have (one for each key)."""
    fresh = new.join(old.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys))
    return old.unionByName(fresh.select(old.columns))


def keep_manual(old: DataFrame, new: DataFrame, keys: Sequence[str], method: str = "method", manual: str = "MANUAL") -> DataFrame:
    """As an upsert, but rows that were set by hand stay as they are."""
    fixed = old.where(F.col(method) == manual)
    moved = new.join(fixed.select(*keys), list(keys), "left_anti")
    untouched = old.join(new.select(*keys), list(keys), "left_anti").where(~F.col(method).eqNullSafe(F.lit(manual)))
    return fixed.unionByName(moved.select(old.columns)).unionByName(untouched)


def soft_delete(old: DataFrame, seen: DataFrame, keys: Sequence[str], at, removed: str = "removed_at") -> DataFrame:
    """``old`` with ``removed`` set where a key is no longer seen and cleared where it is seen again."""
    marked = old.join(seen.select(*keys, F.lit(True).alias("_seen")).dropDuplicates(list(keys)), list(keys), "left")
    return marked.withColumn(removed, F.when(F.col("_seen").isNull(), F.coalesce(F.col(removed), F.lit(at)))).select(old.columns)


def changed_payload(old: DataFrame, new: DataFrame, keys: Sequence[str], payload: str) -> DataFrame:
    """Keys whose payload's sha-256 differs from the stored one or that are new."""
    digest = lambda df, name: df.select(*keys, F.sha2(F.col(payload), 256).alias(name))
    both = digest(new, "_new").join(digest(old, "_old"), list(keys), "left")
    return both.where(~F.col("_new").eqNullSafe(F.col("_old"))).select(*keys, F.col("_new").alias("digest"))


def next_version(rules: DataFrame, wanted: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``rules`` with a further version of each rule whose fields differ from those of its latest one."""
    latest = rules.groupBy(key).agg(F.max_by(F.struct("version", *fields), "version").alias("_l"))
    both = wanted.join(latest, key, "left")
    same = F.struct(*fields).eqNullSafe(F.when(F.col("_l").isNotNull(), F.struct(*[F.col(f"_l.{f}").alias(f) for f in fields])))
    fresh = both.where(~same).withColumn("version", F.coalesce(F.col("_l.version"), F.lit(0)) + 1)
    return rules.unionByName(fresh.select(rules.columns))


def replace_units(df: DataFrame, path: str, units: Sequence[str]) -> None:
    """Overwrite the partitions of a Parquet table that ``df`` has rows for, and no others."""
    df.repartition(*units).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*units).parquet(path)
