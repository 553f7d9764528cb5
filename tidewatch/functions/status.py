"""Values that carry a status: a metric is never a silent null or a ratio with the wrong sign."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OK, MISSING, ZERO, NEGATIVE, INCONSISTENT = "OK", "MISSING", "ZERO_DENOM", "NEG_EQUITY", "INCONSISTENT"
VALUE = "decimal(38,4)"


def _wide(x: Column) -> Column:
    return x.cast("decimal(24,4)")


def valued(value: Column, status: Column) -> Column:
    """struct(value, status); the value is null unless the status is OK."""
    return F.struct(F.when(status == OK, value).cast(VALUE).alias("value"), status.alias("status"))


def ratio(top: Column, bottom: Column, factor: int = 100, negative: str | None = None) -> Column:
    """``factor * top / bottom``: a null side is MISSING, then 0 below ZERO_DENOM, then a negative one ``negative``."""
    status = F.when(top.isNull() | bottom.isNull(), MISSING).when(bottom == 0, ZERO)
    if negative:
        status = status.when(bottom < 0, negative)
    safe = F.when(bottom != 0, _wide(bottom))
    return valued(_wide(top) * factor / safe, status.otherwise(OK))


def pct_change(now: Column, before: Column) -> Column:
    """Change in percent: nothing before is MISSING, 0 to 0 is 0, 0 to anything else ZERO_DENOM."""
    status = F.when(now.isNull() | before.isNull(), MISSING).when((before == 0) & (now != 0), ZERO).otherwise(OK)
    safe = F.when(before != 0, _wide(before))
    return valued(F.when(before == 0, F.lit(0)).otherwise((_wide(now) - _wide(before)) * 100 / safe), status)


def growth(now: Column, before: Column) -> Column:
    """Change in percent of the previous value's size, so that a shrinking loss counts as growth."""
    status = F.when(now.isNull() | before.isNull(), MISSING).when(before == 0, ZERO).otherwise(OK)
    safe = F.when(before != 0, F.abs(_wide(before)))
    return valued((_wide(now) - _wide(before)) * 100 / safe, status)


def difference(now: Column, before: Column) -> Column:
    """Plain difference; MISSING where a side is null."""
    return valued(_wide(now) - _wide(before), F.when(now.isNull() | before.isNull(), MISSING).otherwise(OK))


def known(metric: Column) -> Column:
    """The value of a metric where its status is OK, else null (unknown)."""
    return F.when(metric["status"] == OK, metric["value"])
