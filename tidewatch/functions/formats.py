"""Numbers and amounts as people read them, and small helpers over several columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HUNDRED_MILLION, _TEN_THOUSAND = 100_000_000, 10_000


def plain(value: Column) -> Column:
    """A decimal without needless zeros: no places from 100 on, two below, thousands marked; ``-`` for null."""
    large = F.abs(value) >= 100
    rounded = F.round(value.cast("decimal(38,6)"), 2)
    small = F.regexp_replace(F.regexp_replace(rounded.cast("decimal(38,2)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    small = F.when(rounded == 0, "0").otherwise(small)
    return F.when(value.isNull(), "-").when(large, F.format_number(F.round(value.cast("decimal(38,6)"), 0), 0)).otherwise(small)


def won(value: Column) -> Column:
    """An amount in won in words: trillions and hundred millions, or ten thousands below those."""
    sign = F.when(value < 0, "-").otherwise("")
    size = F.abs(value.cast("decimal(38,4)"))
    units = F.round(size / F.lit(_HUNDRED_MILLION), 0).cast("long")
    top, rest = F.floor(units / F.lit(10_000)).cast("long"), F.pmod(units, F.lit(10_000))
    thousands = lambda x: F.format_number(x, 0)
    large = F.when(top == 0, F.concat(thousands(rest), F.lit("억원"))).otherwise(F.concat(top.cast("string"), F.lit("조"), F.when(rest == 0, "").otherwise(F.concat(F.lit(" "), thousands(rest), F.lit("억"))), F.lit("원")))
    small = F.concat(plain(F.round(size / F.lit(_TEN_THOUSAND), 0)), F.lit("만원"))
    return F.when(value.isNull(), "-").when(value == 0, "0원").otherwise(F.concat(sign, F.when(size < _HUNDRED_MILLION, small).otherwise(large)))


def known(*columns: Column | str) -> Column:
    """How many of the columns are not null."""
    return F.size(F.array_compact(F.array(*columns)))


def quarter_of(day: Column) -> Column:
    """The calendar quarter of a date, as ``2025Q3``."""
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def local_day(at: Column, zone: str = "Asia/Seoul") -> Column:
    """The day that it is in a zone at an instant, which is stored in UTC."""
    return F.to_date(F.from_utc_timestamp(at, zone))
