"""Grids of entities and periods, ledgers that gate sums, and roll-ups that need every child."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import periods

#: Rows up to which a side is taken for small enough to be sent to every executor.
SMALL = 100_000


def months(spark, first: str, last: str, name: str = "month") -> DataFrame:
    """All months YYYYMM from first to last."""
    ends = spark.createDataFrame([(first, last)], "a string, b string")
    return ends.select(F.explode(F.sequence(periods.month_ordinal(F.col("a")), periods.month_ordinal(F.col("b")))).alias("n")).select(periods.month_of_ordinal(F.col("n")).alias(name))


def grid(entities: DataFrame, first: Column, last: Column, name: str = "month_no") -> DataFrame:
    """Each entity with every period ordinal between two of its columns: a local explode, no join."""
    return entities.withColumn(name, F.explode(F.sequence(first, last)))


def zero_filled(grid: DataFrame, facts: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The grid with the facts' values, 0 where there are none."""
    return grid.join(facts, list(keys), "left").fillna(0, subset=list(values))


def rolling(df: DataFrame, keys: Sequence[str], ordinal: str, value: str, first: int, last: int, name: str, gate: str | None = None) -> DataFrame:
    """``name``: the sum over periods from ``first`` to ``last`` relative to each row.

    With ``gate`` (a boolean column: the period is in the ledger) the sum is null unless every period
    of the span is there; a period that was fetched and had nothing counts, one never fetched does not.
    """
    w = Window.partitionBy(*keys).orderBy(ordinal).rangeBetween(first, last)
    total = F.sum(value).over(w)
    if gate is not None:
        total = F.when(F.count(F.when(F.col(gate), 1)).over(w) == last - first + 1, total)
    return df.withColumn(name, total)


def complete_groups(need: DataFrame, got: DataFrame, group: Sequence[str], member: str, period: Sequence[str]) -> DataFrame:
    """(group, period) of which every needed member is among those fetched."""
    n_need = need.groupBy(*group).agg(F.countDistinct(member).alias("_need"))
    n_got = got.join(need.select(*group, member).distinct(), member).groupBy(*group, *period).agg(F.countDistinct(member).alias("_got"))
    return n_got.join(n_need, list(group)).where("_got = _need").select(*group, *period)


def roll_up(points: DataFrame, regions: DataFrame) -> DataFrame:
    """(stat, agg, region, period, value): parents get their children's values.

    ``points``: stat, agg (SUM or MEAN), region, period, value; ``regions``: region, parent (null at the
    top). A parent with a series of its own keeps it whole, for all periods. A SUM is there only for
    periods in which every child has a value, a MEAN is that of the children present.
    """
    own = points.where("value is not null")
    kids = regions.where("parent is not null").select("region", "parent")
    n_kids = kids.groupBy("parent").agg(F.count("*").alias("_kids"))
    sums = own.join(kids, "region").groupBy("stat", "agg", "parent", "period").agg(F.sum("value").alias("s"), F.avg("value").alias("m"), F.count("value").alias("_have"))
    rolled = sums.join(n_kids, "parent").where((F.col("agg") == "MEAN") | (F.col("_have") == F.col("_kids")))
    kind = own.schema["value"].dataType
    rolled = rolled.select("stat", "agg", F.col("parent").alias("region"), "period", F.when(F.col("agg") == "SUM", F.col("s").cast(kind)).otherwise(F.col("m").cast(kind)).alias("value"))
    has_own = own.select("stat", "region").distinct()
    return own.select("stat", "agg", "region", "period", "value").unionByName(rolled.join(has_own, ["stat", "region"], "left_anti"))


def exact_ranks(df: DataFrame, keys: Sequence[str], value: str, width: float, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(keys, names of ``ranks``): of each group the values at some ranks, null ones and NaN left out.

    ``ranks`` gives for each name its rank, from 0, by the group's number of values. Values are counted by bins of ``width``
    first, and only the bins that hold a wanted rank are ordered, all of them at once, so that no task holds a group.
    ``width`` decides how much is ordered, never the result. Keys may be null.
    """
    v = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null AND NOT isnan(_v)").withColumn("_bin", F.floor(F.col("_v") / F.lit(float(width))))
    whole = Window.partitionBy(*keys)
    # a group has as many rows here as bins
    bins = v.groupBy(*keys, "_bin").agg(F.count("*").alias("_n"))
    bins = bins.withColumn("_all", F.sum("_n").over(whole)).withColumn("_before", F.sum("_n").over(whole.orderBy("_bin")) - F.col("_n"))
    wanted = [rank(F.col("_all")) for rank in ranks.values()]
    inside = lambda rank: (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))
    some = bins.where(reduce(or_, map(inside, wanted))).drop("_n")
    met = v.alias("v").join(some.alias("m"), [F.col(f"v.{k}").eqNullSafe(F.col(f"m.{k}")) for k in [*keys, "_bin"]])
    each = met.groupBy(*[F.col(f"v.{k}").alias(k) for k in [*keys, "_bin"]], "_v", "_all", "_before").agg(F.count("*").alias("_n"))
    to = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_bin").orderBy("_v"))
    each = each.withColumn("_to", to).withColumn("_from", F.col("_to") - F.col("_n"))
    at = lambda rank: F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col("_v")))
    return each.groupBy(*keys).agg(*[at(rank).alias(name) for name, rank in zip(ranks, wanted, strict=True)])


def exact_median(df: DataFrame, keys: Sequence[str], value: str, width: float, name: str = "median") -> DataFrame:
    """(keys, ``name``): the exact median of each group's values, null ones and NaN left out, by ``exact_ranks``."""
    found = exact_ranks(df, keys, value, width, {"_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.floor(n / 2)})
    return found.select(*keys, (F.col("_low") * 0.5 + F.col("_high") * 0.5).alias(name))


def quantile_breaks(df: DataFrame, keys: Sequence[str], value: str, width: float, classes: int = 7) -> DataFrame:
    """(keys, breaks): of each group the different values at the ranks floor(i / classes (n - 1)), ascending."""
    ranks = {f"_{i}": (lambda n, i=i: F.floor(F.lit(i / classes) * (n - 1))) for i in range(1, classes)}
    found = exact_ranks(df, keys, value, width, ranks)
    return found.select(*keys, F.array_sort(F.array_distinct(F.array(*ranks))).alias("breaks"))


def quantile_classes(df: DataFrame, keys: Sequence[str], value: str, width: float, classes: int = 7, name: str = "class") -> DataFrame:
    """``df`` with ``name``, each row's class among its group's values, the highest being ``classes`` - 1; null without a value.

    A row's class counts the breaks below it; where breaks fall together, the lower classes stay empty. Keys may be null.
    """
    b = quantile_breaks(df, keys, value, width, classes).alias("b")
    met = df.alias("d").join(b, [F.col(f"d.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left")
    above = F.size(F.filter("b.breaks", lambda x: F.col(f"d.{value}").cast("double") > x))
    known = F.col(f"d.{value}").isNotNull() & ~F.isnan(F.col(f"d.{value}").cast("double"))
    return met.select("d.*", F.when(known, above + classes - 1 - F.size("b.breaks")).alias(name))


def signed_classes(df: DataFrame, keys: Sequence[str], value: str, name: str = "class") -> DataFrame:
    """``df`` with ``name``, 0 to 6 around 0: a third of the group's greatest size is a step, class 3 lies within a sixth of a step; null without a value."""
    size = F.max(F.abs(F.col(value).cast("double"))).over(Window.partitionBy(*keys))
    step = F.when(size > 0, size).otherwise(1.0) / 3
    breaks = [-2 * step, -step, -step / 6, step / 6, step, 2 * step]
    above = reduce(add, [(F.col(value).cast("double") > b).cast("int") for b in breaks])
    return df.withColumn(name, F.when(F.col(value).isNotNull(), above))
