"""Operators over ordered series: latest rows, period shifts, runs, islands and as-of joins."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import ship


def latest_per(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One whole row for each key, the first by ``order``; the order has to be total for a stable answer."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def last_n(df: DataFrame, keys: Sequence[str], period: str, n: int) -> DataFrame:
    """Rows of the last ``n`` distinct periods of each key."""
    place = F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.col(period).desc()))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def shifted(df: DataFrame, keys: Sequence[str], ordinal: str, value: str, n: int, name: str) -> DataFrame:
    """``df`` with ``name``, the value ``n`` periods ago by key (not by row: gaps stay unknown).

    One row for each key and period is taken as given. A range frame of a single period does it in
    the window's one shuffle; a self-join would need two.
    """
    w = Window.partitionBy(*keys).orderBy(ordinal).rangeBetween(-n, -n)
    return df.withColumn(name, F.first(value).over(w))


def run_test(df: DataFrame, keys: Sequence[str], ordinal: str, verdict: str, k: int, name: str = "run") -> DataFrame:
    """``name``: whether the verdict held for the ``k`` consecutive periods up to each row.

    False if any of them is false, unknown (null) if one is absent or unknown, else true.
    """
    w = Window.partitionBy(*keys).orderBy(ordinal).rangeBetween(-(k - 1), 0)
    any_false = F.max(F.when(~F.col(verdict), 1).otherwise(0)).over(w) == 1
    all_true = F.count(F.when(F.col(verdict), 1)).over(w) == k
    return df.withColumn(name, F.when(any_false, False).when(all_true, True))


def run_points(df: DataFrame, keys: Sequence[str], ordinal: str, point: Column, k: int, name: str = "points") -> DataFrame:
    """``name``: the points of the last ``k`` periods up to each row, oldest first."""
    w = Window.partitionBy(*keys).orderBy(ordinal).rangeBetween(-(k - 1), 0)
    return df.withColumn(name, F.collect_list(point).over(w))


def islands(df: DataFrame, keys: Sequence[str], time: str, gap: str, name: str = "island") -> DataFrame:
    """``name``: number of the island of each row; rows further apart than ``gap`` (SQL interval) start a new one."""
    w = Window.partitionBy(*keys).orderBy(time)
    before = F.lag(time).over(w)
    new = F.when(before.isNull() | (F.col(time) > before + F.expr(f"INTERVAL {gap}")), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def running_marker(df: DataFrame, keys: Sequence[str], order: Sequence[str], marker: Column, name: str) -> DataFrame:
    """``name``: the last marker that is not null on an earlier row; a marker that clears is a value of its own."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_m", marker).withColumn(name, F.last("_m", ignorenulls=True).over(w)).drop("_m")


def asof_floor(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], strict: bool = False) -> DataFrame:
    """``left`` with ``values`` of the latest row of ``right`` at or before (``strict``: before) its time.

    Both sides are stacked and sorted once for each key; nothing is paired off, so dense histories cost
    no more than sparse ones. ``right`` has one row for each key and time.
    """
    return _asof(left, right, keys, time, values, strict, back=True)


def asof_next(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], strict: bool = True) -> DataFrame:
    """``left`` with ``values`` of the first row of ``right`` after (or, not ``strict``, at) its time."""
    return _asof(left, right, keys, time, values, strict, back=False)


def _asof(left: DataFrame, right: DataFrame, keys, time, values, strict, back) -> DataFrame:
    carried = [c for c in left.columns if c not in (*keys, time)]
    schema = {f.name: f.dataType for f in left.schema.fields}
    one = left.select(*keys, time, F.struct(*[F.col(c) for c in carried]).alias("_left"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_right"))
    two = right.select(*keys, time, F.lit(None).cast(one.schema["_left"].dataType).alias("_left"), F.struct(*values).alias("_right"))
    # at one time the side that counts for the other is met first, unless it must not count
    first = F.when(F.col("_right").isNotNull() == F.lit(strict), 1).otherwise(0)
    w = Window.partitionBy(*keys)
    if back:
        w = w.orderBy(F.col(time), first)
    else:
        w = w.orderBy(F.col(time).desc(), first)
    seen = F.last("_right", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    both = one.unionByName(two).withColumn("_seen", seen).where("_left is not null")
    out = [F.col(c) if c in (*keys, time) else F.col(f"_left.{c}").cast(schema[c]).alias(c) for c in left.columns]
    return both.select(*out, *[F.col(f"_seen.{v}").alias(v) for v in values])


def greedy_non_overlap(df: DataFrame, keys: Sequence[str], entry: str, span: int, order: Sequence[str], name: str = "used") -> DataFrame:
    """``name``: whether an event counts, taking each key's events in order and leaving out those that
    enter less than ``span`` after the last one that counted. What was left out moves nothing, so the
    scan is sequential within an island of a key: an event that enters ``span`` or more after all before it
    counts in any case, so it starts an island. Islands are dealt and scanned in one stream, a number of state each. ``span`` is not negative."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, `{name}` boolean"

    ship(df.sparkSession)
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    before = F.max(entry).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = df.withColumn("_place", F.row_number().over(w)).withColumn("_new", F.when(F.col(entry) >= before + span, 1).otherwise(0))
    cut = cut.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cut = cut.withColumn("_first", (F.col("_place") == 1) | (F.col("_new") == 1)).drop("_new")
    columns = df.columns

    def scan(batches):
        free = None
        for batch in batches:
            used = []
            for first, e in zip(batch.column("_first").to_pylist(), batch.column(entry).to_pylist(), strict=True):
                free = None if first else free
                ok = e is not None and e == e and (free is None or e >= free)
                free = e + span if ok else free
                used.append(ok)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(used, pa.bool_())], [*columns, name])

    return cut.repartition(*keys, "_island").sortWithinPartitions(*keys, "_island", "_place").mapInArrow(scan, schema)


def any_break(bars: DataFrame, keys: Sequence[str], index: str, level: str, span: int, limit: float, name: str = "broken") -> DataFrame:
    """``name``: whether the level moves by more than ``limit`` of this row's within the next ``span`` rows."""
    w = Window.partitionBy(*keys).orderBy(index).rangeBetween(1, span)
    low, high = F.min(level).over(w), F.max(level).over(w)
    base = F.col(level)
    moved = (F.greatest(F.abs(high - base), F.abs(low - base)) / F.when(base != 0, base)) > limit
    return bars.withColumn(name, F.coalesce(moved, F.lit(False)))
