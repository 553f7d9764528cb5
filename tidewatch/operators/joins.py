"""Joins that plain equality cannot say, written so that Spark can still shuffle on keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def either(left: DataFrame, right: DataFrame, ways: Sequence[Sequence[str]], keys: Sequence[str], residual: Column | None = None) -> DataFrame:
    """Pairs of rows that agree on all columns of one of ``ways``: one equi-join for each way, then distinct.

    An OR over different keys would become a nested loop. ``keys`` are the columns of ``left`` and
    ``right`` (as ``l_…`` and ``r_…`` in the result) that tell rows apart and are returned.
    """
    out = None
    for way in ways:
        a = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns])
        b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
        on = None
        for c in way:
            on = (F.col(f"l_{c}") == F.col(f"r_{c}")) if on is None else on & (F.col(f"l_{c}") == F.col(f"r_{c}"))
        found = a.join(b, on)
        if residual is not None:
            found = found.where(residual)
        found = found.select(*[f"l_{k}" for k in keys], *[f"r_{k}" for k in keys])
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def within_days(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, days: int, residual: Column | None = None) -> DataFrame:
    """Pairs (columns as ``l_…`` and ``r_…``) of equal keys where the right time lies up to ``days`` after the left one.

    Time is cut into cells of ``days``, and a left row looks into its own cell and the next one, so the join's key
    has the cell in it: a key with a long history pairs off only neighbours in time.
    """
    cell = F.floor(F.unix_date(F.to_date(time)) / days)
    a = left.withColumn("cell", F.explode(F.array(cell, cell + 1))).select(*[F.col(c).alias(f"l_{c}") for c in [*left.columns, "cell"]])
    b = right.withColumn("cell", cell).select(*[F.col(c).alias(f"r_{c}") for c in [*right.columns, "cell"]])
    on = F.col("l_cell") == F.col("r_cell")
    for k in keys:
        on = on & (F.col(f"l_{k}") == F.col(f"r_{k}"))
    on = on & F.col(f"r_{time}").between(F.col(f"l_{time}"), F.col(f"l_{time}") + F.expr(f"INTERVAL {days} DAYS"))
    return a.join(b, on if residual is None else on & residual).drop("l_cell", "r_cell")


def pending(expected: DataFrame, ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Units that are expected and not in the ledger."""
    return expected.join(ledger.select(*keys).distinct(), list(keys), "left_anti")


def unique_candidate(left: DataFrame, right: DataFrame, on: Sequence[str], value: str, name: str) -> DataFrame:
    """``left`` with the only candidate of ``right``; null where there is none or more than one.

    The candidates are counted before the join, so a frequent key is one row.
    """
    one = right.groupBy(*on).agg(F.count("*").alias("_n"), F.min(value).alias(name)).where("_n = 1").drop("_n")
    return left.join(one, list(on), "left")


def candidates(wanted: DataFrame, rows: DataFrame, keys: Sequence[str], name: str, hint: str, latest: str, n: int = 6) -> DataFrame:
    """For each row of ``wanted`` the first ``n`` names among the rows with its keys that its pattern finds.

    Of rows with one name the latest counts. Wanted rows have to be distinct; those without a candidate are
    left out. Names are made distinct before the join, so it grows with the names and not with the rows.
    """
    known = rows.groupBy(*keys, name).agg(F.max(latest).alias(latest))
    found = wanted.join(known, list(keys)).where(F.rlike(F.col(name), F.col(hint)))
    return found.withColumn("_k", F.row_number().over(Window.partitionBy(*wanted.columns).orderBy(name))).where(F.col("_k") <= n).drop("_k")


def optional(df: DataFrame, **wanted) -> DataFrame:
    """Rows that agree with every wanted value that is given; a list means any of them."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    return df


def page(df: DataFrame, order: Sequence[Column], page: int = 0, size: int = 20) -> DataFrame:
    """One page of an ordered result; the order has to be total."""
    if not (0 <= page <= 100_000 and 1 <= size <= 200):
        raise ValueError("page is 0 to 100000, size 1 to 200")
    return df.orderBy(*order).offset(page * size).limit(size)


def page_with_total(df: DataFrame, order: Sequence[Column], page_: int = 0, size: int = 20, total: str = "total") -> DataFrame:
    """One page of an ordered result with the number of all its rows; a page behind the end is empty."""
    count = df.agg(F.count("*").alias(total))
    return page(df, order, page_, size).crossJoin(F.broadcast(count))  # one row


def search(df: DataFrame, name: str, text: str, n: int = 6) -> DataFrame:
    """The ``n`` best names that contain a text, those that start with it first, then shorter ones."""
    literal = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    hit = F.col(name).ilike(f"%{literal}%")
    return df.where(hit).orderBy(F.col(name).ilike(f"{literal}%").desc(), F.length(name), name).limit(n)
